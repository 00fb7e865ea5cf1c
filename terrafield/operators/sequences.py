"""Interval merging and fix refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered, runs

# Fixed values.
MAX_GAP = 128 * 1024
MAX_SPAN = 4 * 1024 * 1024
GOOD_ENOUGH_M = 20.0
REFINE_S, HARD_S = 12.0, 25.0


def merge_intervals(intervals: DataFrame, key: str, seq: str, max_gap: int = MAX_GAP, max_span: int = MAX_SPAN,
                    chunk: int = ordered.CHUNK) -> DataFrame:
    """Merge ordered intervals (``start``, ``length``) while the gap and the merged span stay within limits.

    Starts need not rise; the gap counts on whichever side the next interval lies, and an overlap is no gap.  The
    open interval decides about the next one; ``runs.merge_intervals`` works out runs of intervals on their own, so that
    one long key is many tasks.  Intervals without start or length are left out.
    """
    return runs.merge_intervals(intervals, key, seq, max_gap, max_span, chunk)


def refine_fix(requests: DataFrame, fixes: DataFrame) -> DataFrame:
    """Best position of every location request.

    Fixes count until the first one of 20 m or better, or until 12 s after the first; the most accurate wins, the
    earliest among equals.  No fix within 25 s of the request is a timeout.
    """
    at = F.struct("ts", "seq")
    acc = F.coalesce("accuracy", F.lit(float("inf")))
    first = fixes.groupBy("request_id").agg(
        F.min("ts").alias("first_ts"), F.min(F.when(acc <= GOOD_ENOUGH_M, at)).alias("_good")
    )
    r = requests.join(first, "request_id", "left")
    late = (F.col("first_ts").cast("double") - F.col("started_at").cast("double")) > HARD_S
    r = r.withColumn("status", F.when(F.col("first_ts").isNull() | late, "timeout").otherwise("ok"))
    live = r.where("status = 'ok'").select("request_id", "first_ts", "_good")
    window = F.col("ts").cast("double") <= F.col("first_ts").cast("double") + REFINE_S
    used = fixes.join(live, "request_id").where(window & (F.col("_good").isNull() | (at <= F.col("_good"))))
    best = used.groupBy("request_id").agg(
        F.min_by(F.struct("seq", "lng", "lat", "accuracy"), F.struct(acc, "ts", "seq")).alias("b"), F.count(F.lit(1)).alias("fixes")
    )
    return r.join(best, "request_id", "left").select("request_id", "status", "b.seq", "b.lng", "b.lat", "b.accuracy", "fixes")
