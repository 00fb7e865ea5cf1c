"""Fix refinement with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.sequences import GOOD_ENOUGH_M, HARD_S, REFINE_S

SCHEMA = "request_id bigint, status string, seq bigint, lng double, lat double, accuracy double"
_INF = float("inf")
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RefineFix(StatefulProcessor):
    """Keeps the best fix of a request until it is good enough or its time is up.

    Rows are the request itself (``seq`` -1, starts the 25 s timer) and its fixes (the first starts the 12 s timer).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq bigint, lng double, lat double, accuracy double, deadline double, done boolean")

    def _load(self) -> tuple:
        """(best fix or None, deadline or None, done)"""
        if not self.state.exists():
            return None, None, False
        seq, lng, lat, acc, deadline, done = self.state.get()
        return (None if seq < 0 else (seq, lng, lat, acc)), (None if deadline < 0 else deadline), done

    def _save(self, best, deadline, done: bool) -> None:
        self.state.update((*(best or (-1, 0.0, 0.0, 0.0)), -1.0 if deadline is None else deadline, done))

    def _timer(self, deadline: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int(deadline * 1000))

    def _result(self, key, best) -> pd.DataFrame:
        seq, lng, lat, acc = best if best else (None, None, None, None)
        return pd.DataFrame({
            "request_id": [key[0]], "status": ["ok" if best else "timeout"], "seq": pd.array([seq], dtype="Int64"), "lng": [lng],
            "lat": [lat], "accuracy": [None if acc == _INF else acc],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, deadline, done = self._load()
        if done:
            return
        before = deadline
        for r in pd.concat(list(rows)).sort_values(["t", "seq"]).itertuples():
            # one trigger may bring rows from both sides of the deadline
            over = deadline is not None and r.t > deadline
            if not over and r.seq < 0:
                deadline = r.t + HARD_S if deadline is None else deadline
            elif not over:
                acc = _INF if pd.isna(r.accuracy) else float(r.accuracy)
                if best is None:
                    deadline = r.t + REFINE_S
                if best is None or acc < best[3]:
                    best = (int(r.seq), float(r.lng), float(r.lat), acc)
                over = best[3] <= GOOD_ENOUGH_M
            if over:
                self._save(best, deadline, True)
                yield self._result(key, best)
                return
        self._save(best, deadline, False)
        if deadline is not None and deadline != before:
            self._timer(deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, deadline, done = self._load()
        if not done:
            self._save(best, deadline, True)
            yield self._result(key, best)

    def close(self) -> None:
        pass


def refine_fix_stream(events: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """One result per request from a stream of requests and fixes (request_id, seq, ts, lng, lat, accuracy).

    Timers need the RocksDB state store, so the session is switched to it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).withColumn("t", F.col("ts").cast("double"))
    return e.groupBy("request_id").transformWithStateInPandas(
        RefineFix(), outputStructType=StructType.fromDDL(SCHEMA), outputMode="Append", timeMode="EventTime"
    )
