"""Sharding by a Feistel permutation of global row numbers, with DataFrame expressions only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import let, whole

PRIME = 2**31 - 1
ROUNDS = 6
OVERHEAD = 16


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{j}".encode()).digest()[:4], "big") % PRIME for j in range(rounds)]


def sides(n: int) -> tuple[int, int]:
    """A near-square a x b that holds n numbers; fewer than a of its cells are unused."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def over(x: Column, d: int) -> Column:
    """``x div d`` for 0 <= x < 2**53."""
    return ((x - x % d) / d).cast("long")


def feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """A permutation of 0 .. a*b-1: rounds add a fifth power modulo a prime of one half to the other half."""

    def mixed(v: Column, key: Column) -> Column:
        u = (v + key) % PRIME
        s = (u * u) % PRIME
        return (((s * s) % PRIME) * u) % PRIME

    def turn(h: Column, k: Column) -> Column:
        left = F.struct(((h["l"] + mixed(h["r"], k["key"])) % a).alias("l"), h["r"].alias("r"))
        right = F.struct(h["l"].alias("l"), ((h["r"] + mixed(h["l"], k["key"])) % b).alias("r"))
        return F.when(k["even"], left).otherwise(right)

    plan = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(j % 2 == 0).alias("even")) for j, k in enumerate(keys)])
    start = F.struct(over(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(plan, start, turn, lambda h: h["l"] * b + h["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of number ``x`` of 0 .. n-1 in a reproducible shuffle of them.

    Numbers that leave the range walk along their cycle until they are back.  A walk visits distinct unused cells, so
    it takes at most a*b - n steps more: the loop is exact, and only the rare rows outside pay for it.
    """
    a, b = sides(n)
    keys = round_keys(seed)
    unused = a * b - n
    once = feistel(x, a, b, keys)
    if not unused:
        return once
    none, steps = F.array().cast("array<int>"), F.sequence(F.lit(1), F.lit(unused))
    return let(once, lambda y: F.aggregate(F.when(y < n, none).otherwise(steps), y, lambda z, _: F.when(z < n, z).otherwise(feistel(z, a, b, keys))))


def number_rows(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``__row`` (long, gapless from 0, in the given order, nulls first) and how many there are.

    A range partitioning orders the rows; a written row id splits ranges of equal rows, so no key is one task.
    Only one count per partition is gathered.
    """
    named = cut_lineage(rows.withColumn("__tie", F.monotonically_increasing_id()))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = named.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = cut_lineage(spread.withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(counts.withColumn("__before", before))  # one row per partition
    total = starts.agg(F.coalesce(F.sum("__count"), F.lit(0))).first()[0]
    out = placed.join(F.broadcast(starts.drop("__count")), "__part").withColumn("__row", F.col("__before") + F.col("__in"))
    return out.drop("__part", "__in", "__before"), total


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Rows get numbers by id, checksum and size (a null id first; rows equal in all three are interchangeable).  The
    permuted number p gives shard ``p % n_shards`` and slot ``p div n_shards``, so shards differ by one row at most
    (law ``rows``) and slots have no gap; anyone who knows seed, count and number can compute both.  A null text has no
    bytes.  ``grown_shard`` is null: it belongs to another law.  No rows give no rows.
    """
    text = whole(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("__size"), F.crc32(text.cast("binary")).alias("__crc"))
    numbered, n = number_rows(sized, "__id", "__crc", "__size")
    place = numbered.withColumn("__place", permuted(F.col("__row"), max(1, n), seed))
    return place.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        (F.col("__place") % n_shards).cast("int").alias("shard"), over(F.col("__place"), n_shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
