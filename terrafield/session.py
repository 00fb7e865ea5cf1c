"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrafield")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, as operators with several state variables need; for queries started from now on."""
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-terrafield-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


_recorders: list[list[str]] = []


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Iterative jobs call this once per round: the plan stays small, a lost executor costs a re-read rather than a
    replay of every earlier round, and the next join sees real sizes.  (``checkpoint()`` carries the constraints of
    its plan along, which double with every self-join of a pointer-doubling loop.)
    """
    path = scratch_path(df.sparkSession, f"step-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    for made in _recorders:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """The list fills with the folders that ``cut_lineage`` writes meanwhile."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [r for r in _recorders if r is not made]


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``recorded_tables`` once nothing reads them any more, and empty the list."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut_lineage``; for loops, once the next round is written."""
    delete_tables(df.sparkSession, [df.scratch])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables next to the checkpoints, reachable from every executor."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"
