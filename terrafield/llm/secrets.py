"""Secret scans: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is an expression on the row: texts are neither shuffled nor handed to Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, whole

#: Kinds in the order that breaks ties, and their patterns (fixed values of the query's contract).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern equals dropping shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    name: str
    letters: str
    least_bits: float


@dataclass(frozen=True)
class Entropy:
    """Windows of ``window`` characters of one class whose entropy reaches the class's bits are secrets, unless the
    candidate matches ``allowed``.  A candidate needs a digit and a letter."""

    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "0123456789abcdefABCDEF", 3.0),
        CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
    )
    allowed: tuple[str, ...] = (r"(?i)example|sample|placeholder|dummy", r"(?i)abcdefghij|0123456789", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^(/?[A-Za-z]+[/_-])+[A-Za-z]*[0-9]{1,8}$")

    def weights(self) -> list[int]:
        """Millionths of c * log2(c): the entropy of a window is log2(window) less their sum over its counts / window."""
        return [0, *[round(c * math.log2(c) * 1e6) for c in range(1, self.window + 1)]]

    def most(self, c: CharClass) -> int:
        """The sum of weights that just reaches the class's bits."""
        return math.floor(self.window * (math.log2(self.window) - c.least_bits) * 1e6)


def running_sums(values: Column, block: int = 128) -> Column:
    """Inclusive prefix sums of an array: within blocks, then of the blocks' totals."""

    def scan(a: Column) -> Column:
        init = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(a, init, lambda c, x: F.struct((c["s"] + x).alias("s"), F.array_append(c["o"], c["s"] + x).alias("o")), lambda c: c["o"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(block)), lambda i: scan(F.slice(v, i + 1, F.lit(block))))

    def joined(b: Column) -> Column:
        totals = scan(F.transform(b, lambda x: F.element_at(x, -1)))
        return let(totals, lambda t: F.flatten(F.transform(b, lambda x, j: F.transform(x, lambda y: y + F.when(j > 0, F.get(t, j - 1)).otherwise(F.lit(0).cast("long"))))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(let(values, blocks), joined))


def matches(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Spans (start, kind, end) of all leftmost, non-overlapping matches, in code points; those whose ``group`` is
    shorter than ``least`` are dropped after they have been matched.

    What stands between the matches gives their places: lengths of gaps and matches add up.
    """
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def spans(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long"))
        all_ = let(running_sums(steps), lambda s: F.transform(found, lambda m, i: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), (F.get(s, i) + F.length(m)).alias("end"))))
        return F.filter(all_, lambda s, i: F.length(F.get(parts["values"], i)) >= least) if group is not None else all_

    fields = [F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")]
    if group is not None:
        fields.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    return F.when(text.rlike(pattern), let(F.struct(*fields), spans)).otherwise(none)


def high_windows(candidate: Column, c: CharClass, e: Entropy) -> Column:
    """Merged (from, to) of all windows of the candidate that reach the class's bits.

    One pass: a step adds a character's count and takes the one that leaves; the sum of weights follows the two counts
    that change.
    """
    n = len(c.letters)
    weight = F.array(*[F.lit(x).cast("long") for x in e.weights()])

    def gain(count: Column) -> Column:
        return F.get(weight, count + 1) - F.get(weight, count)

    def step(s: Column, at: Column) -> Column:
        new, old = at["new"], at["old"]
        before = F.when(old < 0, F.lit(0)).otherwise(F.get(s["counts"], old))
        less = F.when(old < 0, s["sum"]).otherwise(s["sum"] - gain(before - 1))
        left = F.get(s["counts"], new) - F.when(old == new, 1).otherwise(0)
        total = less + gain(left)
        counts = F.transform(s["counts"], lambda v, j: v + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
        hit = (at["i"] >= e.window - 1) & (total <= e.most(c))
        begin, end = at["i"] - e.window + 1, at["i"] + 1
        last = F.get(s["out"], F.size(s["out"]) - 1)
        grown = F.when(F.coalesce(last["to"] >= begin, F.lit(False)), F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["from"].alias("from"), end.alias("to"))))).otherwise(F.array_append(s["out"], F.struct(begin.alias("from"), end.alias("to"))))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit, grown).otherwise(s["out"]).alias("out"))

    def over(chars: Column) -> Column:
        steps = F.transform(chars, lambda x, i: F.struct(i.alias("i"), x.alias("new"), F.when(i >= e.window, F.get(chars, i - e.window)).otherwise(-1).alias("old")))
        init = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))
        return F.aggregate(steps, init, step, lambda s: s["out"])

    return let(F.transform(F.regexp_extract_all(candidate, F.lit("."), F.lit(0)), lambda x: F.instr(F.lit(c.letters), x) - 1), over)


def entropy_spans(text: Column, e: Entropy) -> Column:
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def of_class(c: CharClass) -> Column:
        run = "[" + "".join("\\" + x if x in "-/+=_" else x for x in c.letters) + "]"

        def inside(s: Column) -> Column:
            candidate = F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
            fit = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
            for pattern in e.allowed:
                fit = fit & ~candidate.rlike(pattern)
            hot = let(candidate, lambda x: high_windows(x, c, e))
            moved = F.transform(hot, lambda w: F.struct((s["start"] + w["from"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (s["start"] + w["to"]).alias("end")))
            return F.when(fit, moved).otherwise(none)

        return F.flatten(F.transform(matches(text, f"{run}{{{e.window},}}", KINDS.index("entropy")), inside))

    return F.array_distinct(F.concat(*map(of_class, e.classes)))


def find_secrets(docs: DataFrame, e: Entropy = Entropy(), text_col: str = "text", *keep: Column | str) -> DataFrame:
    """``keep`` columns, ``__base`` and ``__spans``: sorted arrays of (start, kind, end), for every row.

    Base spans are those of the three patterns, never overlapping within a kind; ``__spans`` adds entropy spans.  A
    null or empty text has none.
    """
    text = docs.select(*keep, whole(F.col(text_col)).alias("__text"))
    base = [matches(F.col("__text"), ASSIGN, 0, group=1, least=LEAST_VALUE), matches(F.col("__text"), ACCESS, 1), matches(F.col("__text"), HEX, 2)]
    found = text.select("*", *[b.alias(f"__{k}") for b, k in zip(base, KINDS)], entropy_spans(F.col("__text"), e).alias("__entropy"))
    kept = [c for c in found.columns if not c.startswith("__") or c == "__row"]
    return found.select(*kept, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.array_sort(F.concat("__assign", "__access", "__hex")).alias("__base"), F.array_sort(F.concat("__assign", "__access", "__hex", "__entropy")).alias("__spans"))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, e: Entropy = Entropy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``."""
    found = find_secrets(docs.select(F.struct(F.col(id_col)).alias("__row"), text_col), e, text_col, "__row")
    return found.select("__row.*", "n_assign", "n_access", "n_hex", F.sha2(shown(F.col("__base")), 256).alias("base_sha256"), shown(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, e: Entropy = Entropy(), text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping ones by one); a null text stays null.

    All rows and columns stay; ``n_chars``, if there is one, follows the text.
    """
    found = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__t")), e, "__t", "__row")

    def merge(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] > s["start"]), wider).otherwise(F.array_append(out, F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    spans = F.aggregate("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), merge)
    t = F.col(f"__row.`{text_col}`")

    def pieces(m: Column) -> Column:
        def gap(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
            return F.concat(F.substr(t, begin.cast("int") + 1, (s["start"] - begin).cast("int")), F.lit(mark))

        return F.concat(F.array_join(F.transform(m, gap), ""), F.substr(t, F.element_at(m, -1)["end"].cast("int") + 1, F.length(t)))

    clean = F.when(F.size("__spans") == 0, t).otherwise(let(spans, pieces))
    named = found.select("__row", clean.alias("__clean"))
    special = {text_col: F.col("__clean")} | ({"n_chars": F.when(F.col("__clean") == t, F.col("__row.n_chars")).otherwise(F.length("__clean").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return named.select(*[special.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
