"""Neighbour, running-sum and last-known lookups along ordered keys, split so that one huge key is many tasks.

A plain window sorts a whole key in one task.  Here the order column is cut into chunks: rows meet their
neighbours inside (key, chunk), and only one summary row per chunk takes part in the window over the whole key.
Summaries come from map-side aggregates, so a hot key costs no more than its share of the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 250_000  # order units per chunk
BOUNDED = None  # for keys whose rows are bounded by construction (a profile has 256 samples): one plain window


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / chunk))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    prev: dict[str, str] | None = None,
    nxt: dict[str, str] | None = None,
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Add columns of the previous / next row: ``prev={"new": "old"}`` reads ``old`` from the row before."""
    prev, nxt = prev or {}, nxt or {}
    keys = list(keys)
    if chunk is BOUNDED:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select(
            "*", *[F.lag(c).over(w).alias(n) for n, c in prev.items()], *[F.lead(c).over(w).alias(n) for n, c in nxt.items()]
        )
    d = _chunked(df, order, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    p_row = F.struct(*[F.col(c).alias(n) for n, c in prev.items()]) if prev else None
    n_row = F.struct(*[F.col(c).alias(n) for n, c in nxt.items()]) if nxt else None

    aggs, picks = [], []
    if prev:
        aggs.append(F.max_by(p_row, order).alias("_last"))
        picks.append(F.lag("_last").over(across).alias("_before"))
    if nxt:
        aggs.append(F.min_by(n_row, order).alias("_first"))
        picks.append(F.lead("_first").over(across).alias("_after"))
    edges = d.groupBy(*keys, "_chunk").agg(*aggs).select(*keys, "_chunk", *picks)

    if prev:
        d = d.withColumn("_p", F.lag(p_row).over(w))
    if nxt:
        d = d.withColumn("_n", F.lead(n_row).over(w))
    d = d.join(edges, [*keys, "_chunk"], "left")
    out = [F.col(c) for c in df.columns]
    if prev:
        p = F.coalesce(F.col("_p"), F.col("_before"))
        out += [p[n].alias(n) for n in prev]
    if nxt:
        n_ = F.coalesce(F.col("_n"), F.col("_after"))
        out += [n_[n].alias(n) for n in nxt]
    return d.select(*out)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column | str, out: str, chunk: int | None = CHUNK
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    if chunk is BOUNDED:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(F.coalesce(v, F.lit(0))).over(w))
    d = _chunked(df, order, chunk).withColumn("_v", F.coalesce(v, F.lit(0)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t")).select(
        *keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")
    )
    d = d.withColumn("_run", F.sum("_v").over(w)).join(base, [*keys, "_chunk"], "left")
    return d.select(*[F.col(c) for c in df.columns], (F.col("_run") + F.col("_base")).alias(out))


def with_known(
    df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: int | None = CHUNK
) -> DataFrame:
    """Add the nearest non-null value at or before (``_pv`` at ``_pp``) and at or after (``_nv`` at ``_np``)."""
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("p")))
    if chunk is BOUNDED:
        w = Window.partitionBy(*keys).orderBy(order)
        b = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        a = F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        d = df.withColumn("_k", known).withColumn("_b", b).withColumn("_a", a)
        return d.select(
            *[F.col(c) for c in df.columns],
            F.col("_b.v").alias("_pv"), F.col("_b.p").alias("_pp"), F.col("_a.v").alias("_nv"), F.col("_a.p").alias("_np"),
        )
    d = _chunked(df, order, chunk).withColumn("_k", known)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    back, ahead = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    known_at = F.when(F.col("_k").isNotNull(), F.col(order))
    edges = d.groupBy(*keys, "_chunk").agg(
        F.max_by("_k", known_at).alias("_last"), F.min_by("_k", known_at).alias("_first")
    )
    edges = edges.select(
        *keys,
        "_chunk",
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    d = (
        d.withColumn("_b", F.last("_k", ignorenulls=True).over(inside.rowsBetween(*back)))
        .withColumn("_a", F.first("_k", ignorenulls=True).over(inside.rowsBetween(*ahead)))
        .join(edges, [*keys, "_chunk"], "left")
    )
    b, a = F.coalesce(F.col("_b"), F.col("_before")), F.coalesce(F.col("_a"), F.col("_after"))
    return d.select(
        *[F.col(c) for c in df.columns],
        b["v"].alias("_pv"), b["p"].alias("_pp"), a["v"].alias("_nv"), a["p"].alias("_np"),
    )


def scan_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make_state: Callable[[], dict],
    step: Callable[[dict, tuple, dict[str, list], list], None],
    finish: Callable[[dict, tuple, list], None],
    schema: str,
) -> DataFrame:
    """Feed every key's rows, in order, through ``step`` one Arrow batch at a time.

    For folds whose next value depends on the whole past.  Spark shuffles and sorts (spilling to disk); a task
    holds one batch and one ``state``, never a whole key.  ``step`` and ``finish`` append output tuples.
    """
    keys, order = list(keys), list(order)
    columns = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            change = np.zeros(len(batch), dtype=bool)
            for k in keys:
                v = batch[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
            values = {c: batch[c].tolist() for c in batch.columns}
            out: list[tuple] = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(values[k][lo] for k in keys)
                if key != current:
                    if current is not None:
                        finish(state, current, out)
                    current, state = key, make_state()
                step(state, key, {c: v[lo:hi] for c, v in values.items()}, out)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if current is not None:
            out = []
            finish(state, current, out)
            if out:
                yield pd.DataFrame(out, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
