"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is still ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import SPACE, whole

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, "")


def _cheap(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, carry: dict[str, Column]) -> DataFrame:
    """Every row's id, length, cheap keys and, as ``__norm``, its normalised text."""
    return (
        docs.select(F.col(id_col).alias("__id"), whole(F.col(text_col)).alias("__text"), normalised(F.col(text_col)).alias("__norm"))
        .select("__id", "__norm", F.length("__text").cast("long").alias("__chars"), F.length("__norm").alias("__len"), F.xxhash64(F.substring("__norm", 1, prefix_chars)).alias("__prefix"), *[c.alias(n) for n, c in carry.items()])
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``<id_col>``, ``keep_id``, ``group_size`` (long), ``kept`` and the ``carry`` columns.

    Texts are equal when they agree after white space is deleted.  Of equal texts the one with the most code points
    stays, then the smallest id; a null id comes after every other.  A null text counts as empty, so all blank texts
    are one group.  Of rows that repeat an id and a text exactly one is kept.  Other columns of ``docs`` are not read.
    ``carry`` holds expressions over ``__norm``, ``__chars`` and ``__id``; they decide nothing.

    The scan yields lengths and prefix hashes, a few bytes a row.  Row counts per length leave the lengths that occur
    twice, and of their (length, prefix hash) pairs those that do; only rows of those have their whole content hashed.
    All groups are counted with partial sums, so a group of any size is a handful of rows when it is shuffled.
    """
    carry = carry or {}
    names = list(carry)
    cheap = cut_lineage(_cheap(docs, id_col, text_col, prefix_chars, carry).drop("__norm"))
    pairs = cheap.groupBy("__len", "__prefix").agg(F.count("*").alias("__rows"))
    lengths = pairs.groupBy("__len").agg(F.sum("__rows").alias("__all")).filter("__all > 1").select("__len")
    keys = cut_lineage(pairs.join(lengths, "__len", "left_semi").filter("__rows > 1").select("__len", "__prefix"))
    full = cut_lineage(
        _cheap(docs, id_col, text_col, prefix_chars, {"__norm_": F.col("__norm"), **carry}).join(keys, ["__len", "__prefix"], "left_semi")
        .select("__id", "__chars", F.sha2("__norm_", 256).alias("__hash"), *names)
    )
    row = ["__hash", "__chars", "__id", *names]
    distinct = full.groupBy(*row).agg(F.count("*").alias("__n"))
    best = full.groupBy("__hash").agg(F.max(F.struct("__chars", F.bitwise_not("__id").alias("__not"))).alias("__best"), F.count("*").alias("group_size"))
    wins = (F.col("__chars") == F.col("__best.__chars")) & F.bitwise_not("__id").eqNullSafe(F.col("__best.__not"))
    ambiguous = (
        distinct.join(best, "__hash")
        .select("__id", F.bitwise_not("__best.__not").alias("keep_id"), "group_size", wins.alias("__wins"), F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k"), *names)
        .select("__id", "keep_id", "group_size", (F.col("__wins") & (F.col("__k") == 1)).alias("kept"), *names)
    )
    alone = cheap.join(keys, ["__len", "__prefix"], "left_anti").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *names)
    return alone.unionByName(ambiguous).withColumnRenamed("__id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, under the rules of ``exact_groups``.

    Rows that repeat an id and a text count as one; one of them stays.
    """
    carry = {"__g_sha": F.sha2(F.col("__norm"), 256), "__g_chars": F.col("__chars")}
    gone = exact_groups(docs, id_col, text_col, carry=carry).groupBy(F.col(id_col).alias("__gid"), "__g_sha", "__g_chars").agg(F.max("kept").alias("any")).filter("not any").drop("any")
    keyed = docs.withColumns({"__sha": F.sha2(normalised(F.col(text_col)), 256), "__n": F.length(whole(F.col(text_col))).cast("long")})
    left = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__gid")) & (F.col("__sha") == F.col("__g_sha")) & (F.col("__n") == F.col("__g_chars")), "left_anti")
    first = F.row_number().over(Window.partitionBy(id_col, "__sha", "__n").orderBy(F.col(text_col)))
    return left.withColumn("__first", first).filter("__first = 1").select(*docs.columns)
