"""Best-two-fit packing of token pieces into sequences of a fixed size.

Packing needs only how many pieces of each length there are.  That histogram has at most ``limit`` rows at any corpus
size, so the plan is made once for the whole corpus: bins that repeat are one pattern with a count, and every piece
finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import tidy
from .library_bpe import model, with_end

LIMIT = 2048


def _best_pair(sizes: list[int], left: Counter, room: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths that are left with the largest sum above ``more_than`` and within ``room``."""
    v = np.array(sizes)
    v = v[v < room]
    if not len(v):
        return None
    j = np.searchsorted(v, np.minimum(room - v, v), side="right") - 1
    twice = (j >= 0) & (v[j] == v)
    scarce = np.array([left[int(x)] < 2 for x in v])
    j = np.where(twice & scarce, j - 1, j)
    total = np.where(j >= 0, v + v[j], -1)
    k = len(v) - 1 - int(np.argmax(total[::-1]))  # of equal sums the one with the longest piece
    return (int(v[k]), int(v[j[k]])) if total[k] > more_than else None


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, longest first) and how many bins have them.

    A bin takes the longest piece left, then whatever longest piece still fits.  When none does, its shortest piece
    gives way to two unpacked ones if they fill the widened gap further.  The choice depends only on which lengths are
    left, so it repeats while they last.
    """
    left = Counter({n: c for n, c in counts.items() if c})
    sizes = sorted(left)
    out = []
    while sizes:
        used, gap = [], limit
        rest = Counter()  # taken for this bin

        def available(n: int) -> int:
            return left[n] - rest[n]

        at = len(sizes)
        while at:
            at = min(at, bisect_right(sizes, gap))
            if not at:
                break
            n = sizes[at - 1]
            take = min(available(n), gap // n)
            used += [n] * take
            rest[n] += take
            gap -= n * take
            at -= 1
        if gap and len(used) > 1:
            shortest = used[-1]
            free = [n for n in sizes if available(n)]
            pair = _best_pair(free, Counter({n: available(n) for n in free}), gap + shortest, shortest)
            if pair:
                rest[shortest] -= 1
                rest.update(pair)
                used = sorted([*used[:-1], *pair], reverse=True)
        k = min(left[n] // c for n, c in rest.items() if c)
        out.append((used, k))
        for n, c in rest.items():
            left[n] -= k * c
        sizes = [n for n in sizes if left[n]]
    return out


def pack(pieces: DataFrame, limit: int = LIMIT, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` (long) and ``offset`` (long): all columns kept, one row per row.

    Lengths of 1 to ``limit`` are packed; a row of any other length, or of none, gets nulls.  Places in a sequence are
    gapless from 0.  No rows give no rows.

    Ranks among equal lengths are counted per written partition and shifted by the counts of the partitions before, so
    a length that most pieces share is spread like any other.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    n = F.col(length_col).cast("long")
    rows = cut_lineage(pieces.withColumns({"__n": F.when(n.between(1, limit), n), "__part": F.spark_partition_id(), "__tie": F.monotonically_increasing_id()}))
    counts = cut_lineage(rows.filter("__n is not null").groupBy("__part", "__n").agg(F.count("*").alias("__c")))
    histogram = {r["__n"]: r["c"] for r in counts.groupBy("__n").agg(F.sum("__c").alias("c")).collect()}  # at most ``limit`` rows
    places, sequence = [], 0
    seen = Counter()
    for lengths, k in plan_bins(histogram, limit):
        offsets, at = {}, 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            places.append((x, seen[x], seen[x] + k * len(own), sequence, own))
            seen[x] += k * len(own)
        sequence += k
    table = spark.createDataFrame(places, "__n long, __lo long, __hi long, __sequence long, __offsets array<long>")
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__part", "__n", before.alias("__before"))
    ranked = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__part", "__n").orderBy("__tie"))).join(shifts, ["__part", "__n"], "left").withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")  # patterns number some limit * ln(limit) at most
    placed = r.join(t, (F.col("r.__n") == F.col("t.__n")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")), "left")
    q, per = F.col("__rank") - F.col("__lo"), F.size("__offsets")
    return placed.select(*[F.col(f"r.`{c}`") for c in columns], (F.col("__sequence") + F.floor(q / per)).cast("long").alias("sequence_id"), F.get("__offsets", (q % per).cast("int")).alias("offset"))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` ids: ``<id_col>``, ``piece``, ``start``, ``length`` and ``ids`` (binary, little-endian
    unsigned 32-bit), or ``ids_crc32`` of them when only a ``digest`` is wanted.

    Every text is encoded whole and ``end_id`` appended; a null text counts as empty and is the end id alone.  Longer
    documents are cut every ``limit`` ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    name, value, value_type = ("ids_crc32", zlib.crc32, pa.int64()) if digest else ("ids", bytes, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, bounds = with_end(*bpe.encode([t or "" for t in batch.column(1).to_pylist()]), end_id)
                ids, n = ids.astype("<u4"), np.diff(bounds)
                pieces = -(-n // limit)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(limit, n[doc] - start)
                first = bounds[doc] + start
                values = [value(ids[s : s + k].tobytes()) for s, k in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(values, value_type)],
                    names=[id_col, "piece", "start", "length", name],
                )
        tidy()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, {name} {'long' if digest else 'binary'}")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset`` of each piece."""
    return pack(cut_pieces(docs, tokenizer, end_id, limit, id_col, text_col, digest), limit)
