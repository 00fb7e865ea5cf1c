"""Running totals of recordings, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo
from ..operators import paths

SCHEMA = "session_id bigint, points bigint, length_m double, duration_s double"
_STATE = "lng double, lat double, points bigint, length_m double, first bigint, last bigint"


def drop_superseded(fixes: DataFrame) -> DataFrame:
    """Ignore fixes of a recording that arrive after a newer recording of the device has begun."""
    begun = fixes.groupBy("device_id", "generation").agg(F.min("seq").alias("_begun"))
    # one row per recording, so this window is small even for a device with many fixes
    later = Window.partitionBy("device_id").orderBy("generation").rowsBetween(1, Window.unboundedFollowing)
    ends = begun.withColumn("_end", F.min("_begun").over(later)).drop("_begun")
    d = fixes.join(ends, ["device_id", "generation"])
    return d.where(F.col("_end").isNull() | (F.col("seq") < F.col("_end"))).drop("_end")


def live_track(fixes: DataFrame) -> DataFrame:
    """Length, points and duration of every recording (a recording of one point is no track)."""
    return paths.track_stats(fixes, "session_id", "seq", "ts")


class _Recordings(StatefulProcessor):
    """Running totals of one device's recordings, and the newest generation that has begun."""

    def __init__(self, ttl_ms: int | None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "generation bigint", self._ttl_ms)
        self._totals = handle.getMapState("totals", "session_id bigint", _STATE, self._ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one key arrive in several Arrow batches and in no order
        d = pd.concat(list(rows)).sort_values("seq")
        known = self._newest.get()[0] if self._newest.exists() else None
        newest = d["generation"].cummax()
        if known is not None:
            newest = newest.clip(lower=known)
        self._newest.update((int(newest.iloc[-1]),))
        d = d[d["generation"] >= newest]
        out = []
        for session, g in d.groupby("session_id", sort=False):
            old = self._totals.getValue((int(session),)) if self._totals.containsKey((int(session),)) else None
            lng, lat, t = (g[c].to_numpy() for c in ("lng", "lat", "t"))
            points, length, first, last = len(g), 0.0, t.min(), t.max()
            if old:
                lng, lat = np.append(old[0], lng), np.append(old[1], lat)
                points, length, first, last = points + old[2], old[3], min(first, old[4]), max(last, old[5])
            x, y = np.radians(lng), np.radians(lat)
            s = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.diff(x) / 2) ** 2
            length += float((2 * geo.EARTH_EQUATORIAL_M * np.arcsin(np.minimum(1.0, np.sqrt(s)))).sum())
            self._totals.updateValue((int(session),), (float(lng[-1]), float(lat[-1]), int(points), length, int(first), int(last)))
            out.append((int(session), int(points), length, float((last - first) / 1e6)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "points", "length_m", "duration_s"])

    def close(self) -> None:
        pass


def live_track_stream(fixes: DataFrame, ttl_s: float | None = None) -> DataFrame:
    """Totals of every recording that grew in a trigger, superseded fixes left out as in :func:`drop_superseded`.

    ``fixes``: device_id, generation, session_id, seq, ts, lng, lat; ``seq`` rises from trigger to trigger.  State per device
    is its newest generation and, per recording, the last point and the sums.  With ``ttl_s`` it is dropped that many
    seconds after its last change; a fix after that begins anew.  Spark then follows every batch with another one, so an
    ``availableNow`` run ends only with ``spark.sql.streaming.noDataMicroBatches.enabled`` off.  The session must use the
    RocksDB state store (:func:`terrafield.session.use_rocksdb`).
    """
    f = fixes.select("device_id", F.col("generation").cast("bigint").alias("generation"), F.col("session_id").cast("bigint").alias("session_id"),
                     "seq", "lng", "lat", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ttl_ms = None if ttl_s is None else int(ttl_s * 1000)
    return f.groupBy("device_id").transformWithStateInPandas(
        _Recordings(ttl_ms), outputStructType=SCHEMA, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")
