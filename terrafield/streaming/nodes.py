"""Latest state of every node from a stream of updates.

The same aggregation serves a batch and a stream.  Every field is a maximum by some order, so partial results
combine before the shuffle and a chatty node costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators.rules import node_status
from ..session import delete_tables
from ..sources.clean import drop_null_island

POSITION = ["lng", "lat", "altitude", "pos_time", "uncertainty_m"]
NAMES = ["id", "long_name", "short_name"]
OTHERS = ["altitude", "battery", "snr", "hops", "last_heard"]


def _last(field: Column, order: Column, when: Column) -> Column:
    return F.max_by(F.when(when, field), F.when(when, order))


def latest_nodes(updates: DataFrame) -> DataFrame:
    """One row per node.

    A position is replaced only by one at least as new (no time counts as 0; a later arrival wins a tie), so a late
    relayed copy never moves a node back.  Any other field keeps its last value that was given, and an empty name
    never erases a known one.  A position without a time takes the time it was received.
    """
    have = set(updates.columns)
    u = drop_null_island(updates, [c for c in POSITION if c in have])
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    if "last_heard" in have:
        u = u.withColumn("pos_time", F.when(placed, F.coalesce("pos_time", "last_heard")).otherwise(F.col("pos_time")))
    pos = [c for c in ("lng", "lat", "pos_time", "uncertainty_m") if c in have]
    order = F.struct(F.coalesce("pos_time", F.lit(0)).alias("t"), F.col("arrival").alias("a"))
    aggs = [_last(F.struct(*pos), order, placed).alias("_pos")]
    for c in OTHERS:
        if c in have:
            aggs.append(_last(F.col(c), F.col("arrival"), F.col(c).isNotNull()).alias(c))
    for c in NAMES:
        if c in have:
            aggs.append(_last(F.col(c), F.col("arrival"), text.blank_to_null(c).isNotNull()).alias(c))
    g = u.groupBy("num").agg(*aggs)
    keep = [c for c in OTHERS + NAMES if c in have]
    return g.select("num", *[F.col("_pos")[c].alias(c) for c in pos], *keep)


def write_latest(updates: DataFrame, table_path: str, checkpoint: str, fold_every: int = 20, buckets: int = 16, **trigger) -> StreamingQuery:
    """Run :func:`latest_nodes` on a stream and keep its result in a state table (:func:`append_batch`)."""

    def upsert(changed: DataFrame, batch_id: int) -> None:
        append_batch(changed, batch_id, table_path, fold_every, buckets)

    writer = latest_nodes(updates).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(upsert).trigger(**(trigger or {"availableNow": True})).start()


# --- state table ----------------------------------------------------------------------------------------------
#
# <table>/change/<batch>   the nodes that a trigger changed
# <table>/whole/<batch>    every node as of that batch, in hash buckets
#
# A folder counts once its job has committed.  The table is the newest whole folder and all changes after it.

def _folders(spark: SparkSession, parent: str) -> list[int]:
    """Numbers of the committed folders, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path)]
    done = [f.getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit())


def _newest(spark: SparkSession, table_path: str) -> tuple[int, list[str]]:
    """Batch of the newest whole folder (-1: none) and the folders that make up the table."""
    changes, wholes = _folders(spark, f"{table_path}/change"), _folders(spark, f"{table_path}/whole")
    upto = wholes[-1] if wholes else -1
    parts = [f"{table_path}/whole/{upto}"] * bool(wholes) + [f"{table_path}/change/{c}" for c in changes if c > upto]
    return upto, parts


def _merged(spark: SparkSession, parts: list[str]) -> DataFrame:
    d = spark.read.parquet(*parts)
    cols = [c for c in d.columns if c != "num"]
    return d.groupBy("num").agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select("num", "r.*")


def append_batch(changed: DataFrame, batch_id: int, table_path: str, fold_every: int = 20, buckets: int = 16) -> None:
    """Add the nodes that one trigger changed; fold the changes into a whole table after every ``fold_every`` triggers.

    A replayed batch overwrites its own folder, or is left out if a fold already holds it, so the table stays the same.
    A fold writes a new folder beside the old ones.  It then deletes what the fold before it had already replaced, so a
    reader that began before this fold still finds its files, and the table never has more than two whole folders and some
    ``2 * fold_every`` changes.  One writer at a time, as a streaming query is.
    """
    spark = changed.sparkSession
    before, _ = _newest(spark, table_path)
    if batch_id <= before:
        return
    changed.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{table_path}/change/{batch_id}")
    _, parts = _newest(spark, table_path)
    if len(parts) - (before >= 0) < fold_every:
        return
    whole = _merged(spark, parts).repartition(buckets, "num").sortWithinPartitions("num")
    whole.write.mode("overwrite").parquet(f"{table_path}/whole/{batch_id}")
    old = [f"{table_path}/change/{c}" for c in _folders(spark, f"{table_path}/change") if c <= before]
    old += [f"{table_path}/whole/{w}" for w in _folders(spark, f"{table_path}/whole") if w < before]
    delete_tables(spark, old)


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    """Current row of every node; a table without a committed batch is an error.

    The result keeps to the folders that were there when it was made, and can be read until the fold after the next.
    """
    _, parts = _newest(spark, table_path)
    if not parts:
        raise ValueError(f"no batch has been written to {table_path}")
    return _merged(spark, parts).drop("_batch")


def status_feed(latest: DataFrame, now) -> DataFrame:
    """Status of every node at ``now``; recomputed per trigger over the table, so a silent node still ages."""
    return node_status(latest, now)
