"""Line dedup by deletion neighbourhoods: a line goes if an earlier one is within one edit of it.

Two texts of equal length are one substitution apart exactly if they agree once the character at one place is deleted
from both; a text is one insertion away from another exactly if deleting one character gives the other.  So variants
with one character deleted, hashed, turn the search into joins of equal keys.

Emitting every variant of every line would cost as many rows as the corpus has characters.  The same argument with
whole segments in place of characters narrows the places first: lines within one edit agree outside one of two halves,
and outside one of sixteen segments.  Only places in segments that agree with another line's get their variants.  No
step loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import SPACE_CHARS, lines
from .near_dedup import passes, row_filter

SEGMENTS = 16
MIN_CHARS = 16
#: An odd base and its inverse for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class LineHashes:
    """Hashes of one line without some stretch, from prefix sums."""

    def __init__(self, line: str, powers: Powers):
        cps = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.n = len(cps)
        self.down = powers.down
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(cps + np.uint64(1)) * powers.upto(self.n))])

    def without(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = self.sums[begin] + (self.sums[self.n] - self.sums[end]) * self.down(end - begin)
            return _mix(h + (self.n - (end - begin)).astype(np.uint64))


class Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.full((1 << n.bit_length()) - 1, BASE, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:n]

    @staticmethod
    def down(k: np.ndarray) -> np.ndarray:
        """``INVERSE ** k`` by squaring; stretches are short."""
        out, base, k = np.ones(len(k), np.uint64), np.uint64(INVERSE), k.copy()
        with np.errstate(over="ignore"):
            while k.any():
                out = np.where(k & 1, out * base, out)
                base, k = base * base, k >> 1
        return out


def frame(n: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments of a line of ``n`` characters, as the shorter or the longer of a pair.

    Segments are laid on the shorter length; the longer line has one character more somewhere in one of them.
    """
    least = n - longer
    edges = np.arange(SEGMENTS + 1) * least // SEGMENTS
    return edges[:-1], edges[1:] + longer


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int, rid: Column | None = None) -> DataFrame:
    """Per line: row (``rid``, else a new number), id, line number, ``blank``, ``n``, two hashes, and the keys of its halves (null if too short)."""
    rows = docs.select(F.col(id_col).alias("id"), lines(F.col(text_col)).alias("l")).withColumn("rid", F.monotonically_increasing_id())
    if rid is not None:
        rows = docs.select(F.col(id_col).alias("id"), lines(F.col(text_col)).alias("l"), rid.alias("rid"))
    each = rows.select("rid", "id", F.posexplode("l").alias("no", "line")).withColumns({"n": F.length("line"), "blank": F.btrim("line", F.lit(SPACE_CHARS)) == ""})

    def halves(least: Column) -> list[Column]:
        h = F.floor(least / 2).cast("int")
        return [F.xxhash64(least, F.lit(0), F.substring("line", F.lit(1), h)), F.xxhash64(least, F.lit(1), F.substring("line", F.col("n") - (least - h) + 1, least - h))]

    keys = F.when((F.col("n") >= min_chars) & ~F.col("blank"), F.array(*halves(F.col("n")), *halves(F.col("n") - 1)))
    return each.select("rid", "id", "no", "blank", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), keys.alias("halves"))


def _first() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("no"), F.col("rid"))


def _segment_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in it:
        lid, parts = batch.column(0).to_numpy(), []
        for line in batch.column(1).to_pylist():
            h = LineHashes(line, powers)
            for longer in (0, 1):
                begin, end = frame(h.n, bool(longer))
                least = np.uint64(h.n - longer)
                with np.errstate(over="ignore"):
                    parts.append(_mix(h.without(begin, end) + least * np.uint64(BASE) + np.arange(SEGMENTS, dtype=np.uint64)))
        if parts:
            key = np.concatenate(parts).view(np.int64)
            role = np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(lid))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lid, 2 * SEGMENTS)), pa.array(role), pa.array(key)], names=["lid", "role", "key"])


def _variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place`` -1: the line itself; -2: it lacks one character; from 0 on: it lacks the one at that place."""
    powers = Powers()
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            out = [[], [], []]
            for lid, line, roles in zip(*[piece.column(c).to_pylist() for c in range(3)]):
                h = LineHashes(line, powers)
                sub, ins = [], []
                for r in roles:
                    begin, end = frame(h.n, r >= SEGMENTS)
                    (ins if r >= SEGMENTS else sub).append(np.arange(begin[r % SEGMENTS], end[r % SEGMENTS]))
                sub = np.unique(np.concatenate(sub)) if sub else np.zeros(0, np.int64)
                ins = np.unique(np.concatenate(ins)) if ins else np.zeros(0, np.int64)
                zero = np.zeros(1, np.int64)
                out[0].append(np.full(len(sub) + len(ins) + 1, lid))
                out[1].append(np.concatenate([sub, np.full(len(ins), -2), [-1]]).astype(np.int32))
                out[2].append(np.concatenate([h.without(sub, sub + 1), h.without(ins, ins + 1), h.without(zero, zero)]).view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["lid", "place", "v"])


def near_lines(docs: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame:
    """``distinct``: lid, first, n, h1, h2, halves, one row per distinct line.  (lid, winner): lines with an earlier one
    within one edit, and the earliest such line.  Edit distances are checked on the lines themselves."""
    half = distinct.filter("halves is not null").select("lid", F.explode("halves").alias("key")).distinct()
    both = half.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    some = cut_lineage(distinct.join(half.join(both, "key").select("lid").distinct(), "lid", "left_semi").select("lid", "first", "h1", "h2"))
    spelled = docs.select(F.explode(lines(F.col(text_col))).alias("line")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    bitmap = row_filter(some.select(F.col("h1").alias("h"), F.col("h2").alias("k1")))

    def wanted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(passes(bitmap, batch.column(1).to_numpy(), batch.column(2).to_numpy())))

    # lines nobody asks for stay out of the shuffle; the join then is exact
    spelled = spelled.mapInArrow(wanted, "line string, h1 long, h2 long")
    text = spelled.join(some.select("h1", "h2", "lid"), ["h1", "h2"]).groupBy("lid").agg(F.first("line").alias("line"))
    text = cut_lineage(text)
    keys = cut_lineage(text.mapInArrow(_segment_keys, "lid long, role int, key long"))
    twice = keys.groupBy("key").agg((F.max("lid") != F.min("lid")).alias("more")).filter("more")
    places = keys.join(twice, "key").groupBy("lid").agg(F.collect_set("role").alias("roles"))  # at most 2 * SEGMENTS each
    rows = text.join(places, "lid").select("lid", "line", "roles").mapInArrow(_variants, "lid long, place int, v long")
    rows = cut_lineage(rows.join(some.select("lid", "first"), "lid"))
    # of the earliest lines with each key, whoever has a later one gives way
    whole, less = F.when(F.col("place") == -1, F.struct("first", "lid")), F.when(F.col("place") == -2, F.struct("first", "lid"))
    ends = rows.filter("place < 0").groupBy("v").agg(F.min(whole).alias("whole"), F.min(less).alias("less")).filter("whole is not null and less is not null")
    inserted = rows.filter("place < 0").join(ends, "v").select("lid", "first", F.when(F.col("place") == -1, F.col("less")).otherwise(F.col("whole")).alias("other"))
    same = rows.filter("place >= 0").groupBy("v", "place").agg(F.min(F.struct("first", "lid")).alias("other"), F.count("*").alias("c")).filter("c > 1").drop("c")
    changed = rows.filter("place >= 0").join(same, ["v", "place"]).select("lid", "first", "other")
    won = inserted.unionByName(changed).filter("other.first < first").groupBy("lid").agg(F.min("other").alias("other")).select("lid", F.col("other.lid").alias("winner"))
    a, b = text.select("lid", F.col("line").alias("__a")), text.select(F.col("lid").alias("winner"), F.col("line").alias("__b"))
    return won.join(a, "lid").join(b, "winner").filter(F.levenshtein("__a", "__b", 1).isin(0, 1)).select("lid", "winner")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, rid: Column | None = None) -> DataFrame:
    """One row per line of every row of ``docs``: rid (number of the row, ``rid`` if given), id, no (of the line, from 0), ``verdict``:
    ``keep``, ``exact`` (an earlier equal line exists) or ``near`` (an earlier line is within one edit).

    Lines are ordered by id (null last), line number and row.  A line with white space only stays.  Lines shorter than
    ``min_chars`` code points are held against equal ones only.  The earlier line need not be kept itself.  A null text
    is one empty line.
    """
    table = cut_lineage(line_table(docs, id_col, text_col, min_chars, rid))
    real = table.filter("not blank")
    distinct = real.groupBy("h1", "h2").agg(F.min(_first()).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves")).withColumn("lid", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct)
    near = near_lines(docs, distinct, text_col).select("lid", F.lit(True).alias("near"))
    decided = distinct.join(near, "lid", "left").select("h1", "h2", "first", "near")
    out = real.join(decided, ["h1", "h2"])
    verdict = F.when((F.col("first.rid") != F.col("rid")) | (F.col("first.no") != F.col("no")), "exact").when(F.col("near"), "near").otherwise("keep")
    return out.select("rid", "id", "no", verdict.alias("verdict")).unionByName(table.filter("blank").select("rid", "id", "no", F.lit("keep").alias("verdict")))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``n_lines``, ``n_exact``, ``n_near`` (long) and ``dropped``, the numbers
    of the lines that go, comma-joined."""
    judged = judge_lines(docs, id_col, text_col, min_chars)
    gone = F.array_sort(F.collect_list(F.when(F.col("verdict") != "keep", F.col("no"))))
    return judged.groupBy("rid", "id").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("verdict") == "exact", 1)).alias("n_exact"), F.count(F.when(F.col("verdict") == "near", 1)).alias("n_near"), F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("dropped"),
    ).select(F.col("id").alias(id_col), "n_lines", "n_exact", "n_near", "dropped")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that ``judge_lines`` drops: all rows and columns stay, null texts stay null.

    Rows are known by a number written with them, so ids may repeat or be null: each row loses its own lines only.
    """
    numbered = cut_lineage(docs.withColumn("__rid", F.monotonically_increasing_id()))
    judged = judge_lines(numbered, id_col, text_col, min_chars, F.col("__rid"))
    gone = judged.filter("verdict <> 'keep'").groupBy(F.col("rid").alias("__rid")).agg(F.collect_list("no").alias("__gone"))
    kept = F.filter(lines(F.col(text_col)), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return numbered.join(gone, "__rid", "left").select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
