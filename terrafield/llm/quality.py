"""Quality rules: fixed rules on word statistics, then robust multivariate outliers per language and source.

The robust part is the minimum covariance determinant: of several starts, each improved by concentration steps until its
subset stays the same, the one with the smallest determinant gives mean and covariance, and rows far from it by
Mahalanobis distance go.  Distance and determinant are those of the statistics given the text's length, so that a text is
compared with what texts of its length look like and no length by itself is far.

Expressions are SQL text, because the twin in DuckDB needs the same ones in the same order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, forget
from .columns import let, lines, whole, words

WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = 5
#: Steps of whole numbers in a unit of logarithm.
SCALE = 200


def _log(x: str) -> str:
    return f"cast(floor({SCALE} * ln({x}) + 0.5e0) as bigint)"


#: Thousandths of the logarithms of mean word length, share of signs among the characters of words, share of distinct words in
#: runs of a hundred, and words a line; their medians over a language are its typical rates ``a1`` to ``a4``.
RATES = [
    "cast(floor(1000 * ln(word_chars / cast(n_words as double)) + 0.5e0) as bigint)",
    "cast(floor(1000 * ln((n_signs + 1) / (word_chars + 1.0e0)) + 0.5e0) as bigint)",
    "cast(floor(1000 * ln(n_distinct / cast(n_words as double)) + 0.5e0) as bigint)",
    "cast(floor(1000 * ln(n_words / cast(n_lines as double)) + 0.5e0) as bigint)",
]
#: The transformed vector: logarithms of the length in words and of the four rates, after a hundred words of the language's
#: typical rates are added to every text: the shorter a text, the more its own rates vary by chance.
VECTOR = [
    _log("n_words + 100.0e0"),
    _log("(word_chars + 100.0e0 * exp(a1 / 1000.0e0)) / (n_words + 100.0e0)"),
    _log("(n_signs + 100.0e0 * exp(a1 / 1000.0e0) * exp(a2 / 1000.0e0)) / (word_chars + 100.0e0 * exp(a1 / 1000.0e0))"),
    _log("(n_distinct + 100.0e0 * exp(a3 / 1000.0e0)) / (n_words + 100.0e0)"),
    _log("(n_words + 100.0e0) / (n_lines + 100.0e0 / exp(a4 / 1000.0e0))"),
]


@dataclass(frozen=True)
class Rules:
    """``share`` of a group that its estimate is made from; ``factor``: makes the covariance of that share consistent for normal
    data of four coordinates; ``floor``: standard deviation added to each coordinate, that of rounding and no more; ``most_steps``
    bounds the concentration steps of a start (a few are enough); rows of groups with fewer than ``least_rows`` rows are judged by
    their language's estimate, or if that has too few rows by that of all rows; ``cutoff``: largest squared distance that
    stays, the 0.999 quantile of chi-square with four degrees of freedom."""

    min_words: int = 10
    max_repeat_percent: int = 20
    share: float = 0.75
    floor: float = 1.0
    factor: float = 1.4866
    most_steps: int = 12
    least_rows: int = 40
    cutoff: float = 18.467


#: Where estimates start: medians, lower and upper quartiles of the coordinates.
STARTS = (2, 1, 3)
PAIRS = [(i, j) for i in range(1, DIMS + 1) for j in range(1, i + 1)]
SUMS = ["c", *[f"s{i}" for i in range(1, DIMS + 1)], *[f"q{i}{j}" for i, j in PAIRS]]
#: Of one row, in the order of ``SUMS``.
TERMS = ["1", *[f"v{i}" for i in range(1, DIMS + 1)], *[f"v{i} * v{j}" for i, j in PAIRS]]


def estimate(r: Rules, factor: bool = True) -> list[tuple[str, str]]:
    """Mean and Cholesky factor of the regularised covariance from the sums of a subset."""
    f = f"{r.factor}e0 * " if factor else ""
    out = [(f"m{i}", f"cast(s{i} as double) / c") for i in range(1, DIMS + 1)]
    out += [(f"k{i}{j}", f"{f}((cast(q{i}{j} as double) - cast(s{i} as double) * s{j} / c) / c)" + (f" + {r.floor}e0 * {r.floor}e0" if i == j else "")) for i, j in PAIRS]
    return out + cholesky()


def cholesky() -> list[tuple[str, str]]:
    out = []
    for j in range(1, DIMS + 1):
        out.append((f"l{j}{j}", f"sqrt(k{j}{j}" + "".join(f" - l{j}{p} * l{j}{p}" for p in range(1, j)) + ")"))
        out += [(f"l{i}{j}", f"(k{i}{j}" + "".join(f" - l{i}{p} * l{j}{p}" for p in range(1, j)) + f") / l{j}{j}") for i in range(j + 1, DIMS + 1)]
    return out


def distance() -> list[tuple[str, str]]:
    """Squared Mahalanobis distance given the first coordinate, by forward substitution."""
    out = [(f"y{i}", f"(v{i} - m{i}" + "".join(f" - l{i}{p} * y{p}" for p in range(1, i)) + f") / l{i}{i}") for i in range(1, DIMS + 1)]
    return [*out, ("d2", " + ".join(f"y{i} * y{i}" for i in range(2, DIMS + 1)))]


#: Sixteenths of a distance, up to a hundred: what a subset is chosen by.
BIN = "cast(least(1600, floor(16 * sqrt(d2))) as bigint)"
#: The determinant of the covariance given the first coordinate, up to a square.
DET = " * ".join(f"l{i}{i}" for i in range(2, DIMS + 1))
PARAMS = [*[f"m{i}" for i in range(1, DIMS + 1)], *[f"l{i}{j}" for i, j in PAIRS]]


def repeated_words(w: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of ``k`` words that occur twice or more, the first occurrence included."""

    def cover(h: Column) -> Column:
        def near(p: Column, e: Column, j: Column) -> Column:
            return F.coalesce(F.get(p, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == e["h"], F.lit(False))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(F.transform(p, lambda e, j: F.when(near(p, e, j), e["i"])), lambda x: x.isNotNull()))
        return let(F.array_sort(twice), lambda s: F.aggregate(F.transform(s, lambda e, j: F.least(F.lit(k), F.coalesce(F.get(s, j + 1) - e, F.lit(k)))), F.lit(0), lambda a, x: a + x))

    def hashes(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - k), lambda i: F.xxhash64(*[F.get(v, i + j) for j in range(k)]))

    found = let(let(F.transform(w, lambda x: F.xxhash64(x)), hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(h)))
    return F.when(F.size(w) > k, found).otherwise(F.lit(0)).cast("long")


def word_stats(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns, the five counts, ``n_lines`` (lines with a word), ``n_distinct`` (distinct words in runs of a
    hundred, added up) and ``n_signs`` (characters of words that are neither letters nor digits), all long, for every row.

    A null text has no words.  Counts are of the whole text and stay in its row: nothing is shuffled.
    """
    text = whole(F.col(text_col))
    parts = docs.select(*keep, text.alias("__text"), words(text).alias("__words"), F.filter(lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    runs = F.when(F.size("__words") > 0, F.sequence(F.lit(0), F.floor((F.size("__words") - 1) / 100).cast("int"))).otherwise(F.array().cast("array<int>"))
    return parts.select(
        *keep, F.length(F.regexp_replace("__text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("__plain"), F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("__words")).alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"),
        F.aggregate(F.transform(runs, lambda i: F.size(F.array_distinct(F.slice("__words", i * 100 + 1, 100)))), F.lit(0), lambda a, x: a + x).cast("long").alias("n_distinct"),
    ).withColumn("n_signs", F.col("word_chars") - F.col("__plain")).drop("__plain")


def base_fails(r: Rules) -> str:
    return f"n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words"


def _with(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, e in steps:
        df = df.withColumn(name, F.expr(e))
    return df


def _quartiles(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """Per group its size and, for each coordinate, the values with a quarter, half and three quarters of the rows at or
    below.  Rows are counted per value first; a coordinate has some hundred values."""
    stacked = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in range(1, dims + 1)])).alias("e")).select("g", "e.i", "e.v")
    counts = stacked.groupBy("g", "i", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "i")
    cum = counts.withColumns({"cum": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    qs = [F.min(F.when((F.col("i") == i) & (4 * F.col("cum") >= k * F.col("all")), F.col("v"))).alias(f"p{i}{k}") for i in range(1, dims + 1) for k in (1, 2, 3)]
    return cum.groupBy("g").agg(F.max("all").alias("n"), *qs)


def start(k: str, r: Rules) -> list[tuple[str, str]]:
    """The quartile ``k`` (an expression: 1, 2 or 3) of each coordinate, and quartile distances for standard deviations."""
    out = [(f"m{i}", f"cast(case {k} when 1 then p{i}1 when 2 then p{i}2 else p{i}3 end as double)") for i in range(1, DIMS + 1)]
    out += [(f"l{i}{j}", f"greatest({r.floor}e0, (p{i}3 - p{i}1) / 1.349e0)" if i == j else "0.0e0") for i, j in PAIRS]
    return out


def _next_sums(rows: DataFrame, params: DataFrame, r: Rules) -> DataFrame:
    """One concentration step: per group and start the sums over the ``share`` of its rows that is nearest now."""
    far = _with(rows.join(params, "g"), distance()).withColumn("b", F.expr(BIN))
    bins = far.groupBy("g", "st", "b").agg(*[F.sum(F.expr(f"cast({t} as bigint)")).alias(s) for s, t in zip(SUMS, TERMS)])
    w = Window.partitionBy("g", "st").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cum = bins.select("g", "st", "b", *[F.sum(s).over(w).alias(s) for s in SUMS], F.sum("c").over(Window.partitionBy("g", "st")).alias("n"))
    enough = cum.filter(F.col("c") >= r.share * F.col("n"))
    return enough.groupBy("g", "st").agg(F.min_by(F.struct("n", *SUMS), "b").alias("e")).select("g", "st", "e.*")


def robust_estimates(rows: DataFrame, r: Rules = Rules()) -> DataFrame:
    """``rows``: g, v1 .. v5 (long).  Per group of ``least_rows`` or more: g, ``PARAMS``.

    Each concentration step is one pass with partial sums per (group, start, distance bin), so that a group of any size
    arrives as its at most 1,601 bins a start.  Sums are whole numbers: no order of adding changes them, and a start is done
    when its sums stay the same.  The start with the smallest determinant wins, of equal ones the first.
    """
    starts = F.explode(F.array(*[F.lit(k) for k in STARTS]))
    first = _quartiles(rows).filter(F.col("n") >= r.least_rows).withColumn("st", starts)
    params = cut_lineage(_with(first, start("st", r)).select("g", "st", *PARAMS, *[F.lit(0).cast("long").alias(s) for s in SUMS]))
    for _ in range(r.most_steps):
        last, params = params, cut_lineage(_with(_next_sums(rows, params.drop(*SUMS), r), estimate(r)).select("g", "st", *PARAMS, *SUMS))
        moved = params.join(last.select("g", "st", *[F.col(s).alias(f"_{s}") for s in SUMS]), ["g", "st"]).filter(" or ".join(f"{s} <> _{s}" for s in SUMS))
        done = moved.isEmpty()
        forget(last)
        if done:
            break
    rank = F.expr(f"case st {' '.join(f'when {k} then {i}' for i, k in enumerate(STARTS))} end")
    best = F.min_by(F.struct(*PARAMS), F.struct(F.expr(DET).alias("det"), rank.alias("rank")))
    return params.groupBy("g").agg(best.alias("e")).select("g", "e.*")


def _params(good: DataFrame, r: Rules) -> DataFrame:
    """``good``: g, l, v1 .. v5.  Per group: g, ``PARAMS``.  Wider estimates are made only if a group needs one."""
    values = [f"v{i}" for i in range(1, DIMS + 1)]
    out = robust_estimates(good.select("g", *values), r)
    small = cut_lineage(good.groupBy("g", "l").agg(F.count("*").alias("n")).filter(F.col("n") < r.least_rows))
    if small.isEmpty():
        return out
    by_lang = robust_estimates(good.join(small.select("l").distinct(), "l", "left_semi").select(F.col("l").alias("g"), *values), r).withColumnRenamed("g", "l")
    out = out.unionByName(small.join(by_lang, "l").select("g", *PARAMS))
    rest = small.join(by_lang, "l", "left_anti")
    if rest.isEmpty():
        return out
    of_all = robust_estimates(good.select(F.lit("").alias("g"), *values), replace(r, least_rows=1))
    return out.unionByName(rest.select("g").crossJoin(F.broadcast(of_all.drop("g"))))


def _judged(docs: DataFrame, row: Column, r: Rules, text_col: str) -> DataFrame:
    """``__row`` with the counts, ``base_failed`` and ``kept``.  Counts are made once and written with the row."""
    g = F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))
    plain = docs.select(row.alias("__row"), g.alias("g"), F.to_json(F.struct(F.col("lang").alias("l"))).alias("l"), F.col(text_col).alias("__t"))
    stats = word_stats(plain, "__t", "__row", "g", "l").withColumn("base_failed", F.expr(base_fails(r)))
    table = cut_lineage(stats.withColumns({f"u{i}": F.when(~F.col("base_failed"), F.expr(e)) for i, e in enumerate(RATES, 1)}))
    vectors = with_vectors(table)
    good = cut_lineage(vectors.filter("not base_failed").select("g", "l", *[f"v{i}" for i in range(1, DIMS + 1)]))
    far = _with(vectors.join(_params(good, r), "g", "left"), distance())
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= r.cutoff, F.lit(True)))


def with_vectors(table: DataFrame) -> DataFrame:
    """Add v1 to v5 to rows with l, base_failed, u1 to u4 and the counts; nulls where the fixed rules fail."""
    rates = table.filter("not base_failed").select(F.col("l").alias("g"), *[F.col(f"u{i}").alias(f"v{i}") for i in range(1, 5)])
    typical = cut_lineage(_quartiles(rates, 4).select(F.col("g").alias("l"), *[F.col(f"p{i}2").alias(f"a{i}") for i in range(1, 5)]))
    vector = {f"v{i}": F.when(~F.col("base_failed"), F.expr(e)) for i, e in enumerate(VECTOR, 1)}
    return table.join(typical, "l", "left").withColumns(vector)


def judge_quality(docs: DataFrame, r: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` (lang, source, ``<id_col>``, ``<text_col>``): ``<id_col>``, the five counts, ``base_failed``, ``kept``.

    ``base_failed``: too few words, or too many of them in repeated windows.  Other rows are compared with the rows of
    their lang and source that did not fail (a null is a value of its own) and stay within ``cutoff``.  Rows of groups
    too small for an estimate are judged by a wider one.  A null text has no words.  No rows give no rows; other columns are not read.
    """
    return _judged(docs, F.struct(F.col(id_col)), r, text_col).select("__row.*", *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, r: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns."""
    return _judged(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), r, text_col).filter("kept").select("__row.*")


def twin_sql(r: Rules = Rules()) -> str:
    """The DuckDB statement with the rows of ``judge_quality`` over documents."""

    def nest(source: str, steps: list[tuple[str, str]]) -> str:
        for name, e in steps:
            source = f"(select *, {e} as {name} from {source})"
        return source

    sums = ", ".join(f"sum(cast({t} as bigint)) as {s}" for s, t in zip(SUMS, TERMS))
    ctes = [
        "t0 as (select doc_id, row_number() over () as rid, '{' || coalesce('l' || lang, '') || '}' || coalesce('s' || source, '') as g, coalesce('l' || lang, '') as l, coalesce(text, '') as t from documents)",
        r"t1 as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t0)",
        f"win as (select rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as x from (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from t1 where len(w) >= {WINDOW}))",
        "twice as (select rid, i from (select *, count(*) over (partition by rid, x) as c from win) where c > 1)",
        f"rep as (select rid, count(distinct i + o) as n from (select rid, i, unnest(range(0, {WINDOW})) as o from twice) group by rid)",
        "st as (select doc_id, t1.rid, g, l, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines, cast(coalesce(list_sum(list_transform(range(0, len(w), 100), lambda i: len(list_distinct(w[i + 1:i + 100])))), 0) as bigint) as n_distinct, length(array_to_string(w, '')) - length(regexp_replace(t, '[^\\p{L}\\p{N}]+', '', 'g')) as n_signs from t1 left join rep on rep.rid = t1.rid)",
        f"sb as (select *, {base_fails(r)} as base_failed from st)",
        "rates as materialized (select *, " + ", ".join(f"case when not base_failed then {e} end as u{i}" for i, e in enumerate(RATES, 1)) + " from sb)",
        "stacked as (" + " union all ".join(f"select l, {i} as i, u{i} as v from rates where not base_failed" for i in range(1, 5)) + ")",
        "typical as (select l, " + ", ".join(f"min(case when i = {i} and 4 * cum >= 2 * al then v end) as a{i}" for i in range(1, 5)) + " from (select *, sum(n) over (partition by l, i order by v) as cum, sum(n) over (partition by l, i) as al from (select l, i, v, count(*) as n from stacked group by all)) group by l)",
        "vec as materialized (select rates.*, " + ", ".join(f"case when not base_failed then {e} end as v{i}" for i, e in enumerate(VECTOR, 1)) + " from rates left join typical on typical.l = rates.l)",
        "good as (select * from vec where not base_failed)",
    ]
    q = ", ".join(f"min(case when i = {i} and 4 * cum >= {k} * al then v end) as p{i}{k}" for i in range(1, DIMS + 1) for k in (1, 2, 3))
    values = ", ".join(f"v{i}" for i in range(1, DIMS + 1))

    def level(x: str, key: str, least: int) -> None:
        """Estimates per ``key``, in the statement ``p{x}``."""
        ctes.append(f"good{x} as (select {key} as g, {values} from good)")
        stacked = " union all ".join(f"select g, {i} as i, v{i} as v from good{x}" for i in range(1, DIMS + 1))
        ctes.append(f"quart{x} as (select g, max(al) as n, {q} from (select *, sum(n) over (partition by g, i order by v) as cum, sum(n) over (partition by g, i) as al from (select g, i, v, count(*) as n from ({stacked}) group by all)) group by g)")
        states = " union all ".join(f"select *, {k} as st from quart{x} where n >= {least}" for k in STARTS)
        ctes.append(f"p{x}0 as materialized (select g, st, {', '.join(PARAMS)} from {nest(f'({states})', start('st', r))})")
        for k in range(r.most_steps):  # a step from a subset that stays the same changes nothing
            far = nest(f"(select good{x}.*, st, {', '.join(PARAMS)} from good{x} join p{x}{k} on good{x}.g = p{x}{k}.g)", distance())
            cums = ", ".join(f"cast(sum({s}) over (partition by g, st order by b) as bigint) as {s}" for s in SUMS)
            ctes.append(f"b{x}{k} as (select g, st, b, {sums} from (select *, {BIN} as b from {far}) group by g, st, b)")
            ctes.append(f"c{x}{k} as (select * from (select *, row_number() over (partition by g, st order by b) as k from (select g, st, b, n, {', '.join(SUMS)} from (select g, st, b, {cums}, sum(c) over (partition by g, st) as n from b{x}{k}) where c >= {r.share} * n)) where k = 1)")
            ctes.append(f"p{x}{k + 1} as materialized (select g, st, {', '.join(PARAMS)} from {nest(f'c{x}{k}', estimate(r))})")
        rank = f"case st {' '.join(f'when {k} then {i}' for i, k in enumerate(STARTS))} end"
        ctes.append(f"e{x} as materialized (select g, {', '.join(PARAMS)} from (select *, row_number() over (partition by g order by {DET}, {rank}) as k from p{x}{r.most_steps}) where k = 1)")

    level("s", "g", r.least_rows)
    levels = [("s", "vec.g")]
    level("l", "l", r.least_rows)
    level("a", "''", 1)
    levels += [("l", "vec.l"), ("a", "''")]
    joins = " ".join(f"left join e{x} on e{x}.g = {key}" for x, key in levels)
    used = ", ".join(f"coalesce({', '.join(f'e{x}.{p}' for x, _ in levels)}) as {p}" for p in PARAMS)
    last = nest(f"(select vec.*, {used} from vec {joins})", distance())
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, {', '.join(STATS)}, base_failed, not base_failed and coalesce(d2 <= {r.cutoff}, true) as kept from {last}"
