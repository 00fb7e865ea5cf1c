"""Ordered folds over keys of any size: each sorted run becomes a transfer function, the fold then goes from run to run.

A fold whose next value depends on all before it looks sequential.  But where it jumps from one event to the next and
an event alone decides where its successor lies, a run of consecutive rows can be worked out without its past: the
successor of every row is found by descending a table of block minima and maxima, and chains of successors are summed by
pointer doubling.  What the past decides is only where the run is entered, and few rows can be entered: those that set a
new extreme of the run.  So a run leaves its task as the list of such rows, each with what follows from it.  One key is
many tasks; the pass over its runs holds one run's list at a time.

Runs never cross an Arrow batch or an order chunk; the results do not depend on where they are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ordered


def _block_table(values: np.ndarray, combine: np.ufunc, neutral) -> list[np.ndarray]:
    """``table[k][i]`` combines rows i to i + 2**k - 1; beyond the end lies ``neutral``."""
    table, width = [np.append(values, neutral)], 1
    while width < len(values):
        last = table[-1]
        ahead = np.full_like(last, neutral)
        ahead[: len(last) - width] = last[width:]
        table.append(combine(last, ahead))
        width *= 2
    return table


def _first(pos: np.ndarray, n: int, levels: int, quiet: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """First row at or after ``pos`` that is not ``quiet``, else n; ``quiet(k, pos)`` speaks of the block of 2**k rows at pos."""
    for k in reversed(range(levels)):
        pos = np.where(quiet(k, pos), np.minimum(pos + (1 << k), n), pos)
    return pos


def _chain_ends(successor: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Last row of every row's chain (an end is its own successor) and, of each of ``sums``, the total along it."""
    at, totals = successor, list(sums)
    while True:
        far = at[at]
        if np.array_equal(far, at):
            return at, *totals
        totals = [t + t[at] for t in totals]
        at = far


def _cut(batch: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal ``columns`` in a batch, and the end of each row's run."""
    change = np.ones(len(batch), dtype=bool)
    change[1:] = False
    for c in columns:
        v = batch[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    bounds = np.append(np.flatnonzero(change), len(batch))
    return bounds, np.repeat(bounds[1:], np.diff(bounds))


def _running(v: np.ndarray, combine: np.ufunc, first) -> np.ndarray:
    """``combine`` over ``first`` and all rows before each row."""
    return combine.accumulate(np.append(first, v[:-1]))


def _running_rows(v: np.ndarray, combine: np.ufunc, first) -> np.ndarray:
    """``_running`` along every row of a matrix."""
    return combine.accumulate(np.concatenate([np.full_like(v[:, :1], first), v[:, :-1]], axis=1), axis=1)


def _by_length(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the runs of each length, a matrix with one run a row, so that many short runs take a few steps."""
    first, width = bounds[:-1], np.diff(bounds)
    for n in np.unique(width):
        yield first[width == n, None] + np.arange(n)


def _sorted_chunks(rows: DataFrame, key: str, seq: str, chunk: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(seq) / chunk)).repartition(key, "_chunk")


# --- climb ----------------------------------------------------------------------------------------------------

def climb(samples: DataFrame, key: str, seq: str, value: str, threshold: float, chunk: int = ordered.CHUNK) -> DataFrame:
    """Lowest, highest, total rise and fall of ``value`` per key (key, lo, hi, up, down).

    Rise and fall count against a reference that only moves once a value is ``threshold`` away from it.  ``seq`` is a
    number; null values and NaN are left out, and a key with none else has no row.
    """
    d = samples.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(seq).alias("_seq"), F.col(value).cast("double").alias("_v"))
    types = dict(d.dtypes)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            v, n = b["_v"].to_numpy(), len(b)
            bounds, end = _cut(b, [key, "_chunk"])
            most, least = _block_table(v, np.maximum, -np.inf), _block_table(v, np.minimum, np.inf)
            nxt = _first(np.arange(1, n + 1), n, len(most),
                         lambda k, p: (most[k][p] - v < threshold) & (least[k][p] - v > -threshold))
            nxt = np.where(nxt < end, nxt, np.arange(n))
            move = v[nxt] - v
            last, up, down = _chain_ends(nxt, np.maximum(move, 0.0), np.maximum(-move, 0.0))
            out = []
            for a, z in zip(bounds[:-1], bounds[1:]):
                run = v[a:z]
                hi, lo = _running(run, np.maximum, -np.inf), _running(run, np.minimum, np.inf)
                # once the run spans twice the threshold, every reference has been left; a little more is safe from rounding
                open_ = ~(hi - lo > 2.001 * threshold)
                rows = a + np.flatnonzero(((run > hi) | (run < lo)) & open_)
                out.append((b[key].iat[a], b["_seq"].iat[a], run.min(), run.max(), v[rows], v[last[rows]], up[rows], down[rows]))
            yield pd.DataFrame(out, columns=[key, "_seq", "lo", "hi", "at", "leave", "up", "down"])

    arrays = ", ".join(f"{c} array<double>" for c in ("at", "leave", "up", "down"))
    runs = _sorted_chunks(d, key, "_seq", chunk).sortWithinPartitions(key, "_chunk", "_seq").mapInPandas(
        summaries, f"{key} {types[key]}, _seq {types['_seq']}, lo double, hi double, {arrays}")

    def step(s: dict, k: tuple, rows: dict[str, list], out: list) -> None:
        for lo, hi, at, leave, up, down in zip(*(rows[c] for c in ("lo", "hi", "at", "leave", "up", "down"))):
            if not s:
                s.update(ref=at[0], lo=lo, hi=hi, up=0.0, down=0.0)
                move, i = 0.0, 0
            else:
                s.update(lo=min(s["lo"], lo), hi=max(s["hi"], hi))
                away = np.flatnonzero(np.abs(at - s["ref"]) >= threshold)
                if not len(away):
                    continue
                i = away[0]
                move = at[i] - s["ref"]
            s.update(ref=leave[i], up=s["up"] + max(move, 0.0) + up[i], down=s["down"] + max(-move, 0.0) + down[i])

    def finish(s: dict, k: tuple, out: list) -> None:
        out.append((k[0], s["lo"], s["hi"], s["up"], s["down"]))

    return ordered.scan_sorted(runs, [key], ["_seq"], dict, step, finish,
                               f"{key} {types[key]}, lo double, hi double, up double, down double")


# --- interval merging -----------------------------------------------------------------------------------------

FAR = 1 << 62


def _breaks(start, end, lo, hi, max_gap: int, max_span: int):
    """Whether an interval breaks the batch that spans ``lo`` to ``hi`` before it."""
    gap = np.maximum(start - hi, lo - end)
    return (gap > max_gap) | (np.maximum(end, hi) - np.minimum(start, lo) > max_span)


def _next_breaks(start: np.ndarray, end: np.ndarray, max_gap: int, max_span: int) -> np.ndarray:
    """For a batch that begins at a row: the row that breaks it, else n.

    The span grows along the rows, so its first excess is found by descent.  Row j lies beyond the gap of a batch begun
    at i if all of i to j - 1 do, that is if i comes after the last row near j: a table of those last rows is descended.
    """
    n, own = len(start), np.arange(len(start))
    starts, ends = _block_table(start, np.minimum, FAR), _block_table(end, np.maximum, -FAR)
    pos, lo, hi = own + 1, start, end
    for k in reversed(range(len(starts))):
        h, l = np.maximum(hi, ends[k][pos]), np.minimum(lo, starts[k][pos])
        ok = h - l <= max_span
        pos, hi, lo = np.where(ok, np.minimum(pos + (1 << k), n), pos), np.where(ok, h, hi), np.where(ok, l, lo)
    back = n - own  # the row before row j, counted from the other end
    late, early = _block_table(end[::-1], np.maximum, -FAR), _block_table(start[::-1], np.minimum, FAR)
    below = n - 1 - _first(back, n, len(late), lambda k, p: late[k][p] < start - max_gap)
    above = n - 1 - _first(back, n, len(early), lambda k, p: early[k][p] > end + max_gap)
    near = _block_table(np.minimum(below, above), np.minimum, FAR)
    return np.minimum(pos, _first(own + 1, n, len(near), lambda k, p: near[k][p] >= own))


def merge_intervals(intervals: DataFrame, key: str, seq: str, max_gap: int, max_span: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """Batches (key, batch_no, start, length, members) of ordered intervals, as ``sequences.merge_intervals`` says.

    A first pass sums up runs, the pass over runs tells each order chunk which batch is open when it begins, and a second
    pass over the intervals forms the batches' parts.  ``seq`` is a number, unique within its key.
    """
    d = intervals.where(F.col("start").isNotNull() & F.col("length").isNotNull()).select(
        key, F.col(seq).alias("_seq"), F.col("start").cast("bigint").alias("_lo"), (F.col("start") + F.col("length")).cast("bigint").alias("_hi"))
    types = dict(d.dtypes)
    of_key, of_seq = f"{key} {types[key]}", types["_seq"]
    d = d.withColumn("_chunk", F.floor(F.col("_seq") / chunk))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            chunks, start, end, seqs = (b[c].to_numpy() for c in ("_chunk", "_lo", "_hi", "_seq"))
            bounds, run_end = _cut(b, [key, "_chunk"])
            nxt = _next_breaks(start, end, max_gap, max_span)
            (last,) = _chain_ends(np.where(nxt < run_end, nxt, np.arange(len(b))))
            enters = np.empty(len(b), dtype=bool)
            least, most = np.empty_like(start), np.empty_like(end)
            for at in _by_length(bounds):  # runs of one length at a time, a row each
                s, e = start[at], end[at]
                hi, lo = _running_rows(e, np.maximum, -FAR), _running_rows(s, np.minimum, FAR)
                beyond = (s - np.maximum(hi, -FAR // 2) > max_gap) | (np.minimum(lo, FAR // 2) - e > max_gap)
                open_ = hi - lo <= max_span  # a wider run breaks every batch before it
                open_[:, 0] = True
                enters[at] = ((e > hi) | (s < lo) | beyond) & open_
                least[at], most[at] = np.minimum.accumulate(s[:, ::-1], axis=1)[:, ::-1], np.maximum.accumulate(e[:, ::-1], axis=1)[:, ::-1]
            rows = np.flatnonzero(enters)
            leave, cut = last[rows], np.searchsorted(rows, bounds).tolist()
            lists = {"at_lo": start[rows], "at_hi": end[rows], "leave": seqs[leave], "leave_lo": least[leave], "leave_hi": most[leave]}
            first = bounds[:-1]
            yield pd.DataFrame({key: b[key].take(first).reset_index(drop=True), "_chunk": chunks[first], "_seq": seqs[first]}
                               | {c: [v[i:j] for i, j in zip(cut, cut[1:])] for c, v in lists.items()})

    longs = ", ".join(f"{c} array<bigint>" for c in ("at_lo", "at_hi", "leave_lo", "leave_hi"))
    in_order = lambda rows: rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_mark", "_seq")
    marked = d.select(key, "_chunk", F.lit(1).alias("_mark"), "_seq", "_lo", "_hi")
    runs = in_order(marked).mapInPandas(
        lambda it: (t[[key, "_chunk", "_seq", "at_lo", "at_hi", "leave_lo", "leave_hi", "leave"]] for t in summaries(it)),
        f"{of_key}, _chunk bigint, _seq {of_seq}, {longs}, leave array<{of_seq}>")

    def step(s: dict, k: tuple, rows: dict[str, list], out: list) -> None:
        names = ("_chunk", "at_lo", "at_hi", "leave", "leave_lo", "leave_hi")
        for c, at_lo, at_hi, leave, leave_lo, leave_hi in zip(*(rows[x] for x in names)):
            if not s:
                i = 0
            else:
                if c != s["chunk"]:
                    out.append((k[0], c, 0, s["seq"], s["lo"], s["hi"]))
                lo, hi = _running(at_lo, np.minimum, s["lo"]), _running(at_hi, np.maximum, s["hi"])
                broken = np.flatnonzero(_breaks(at_lo, at_hi, lo, hi, max_gap, max_span))
                if not len(broken):
                    s.update(chunk=c, lo=min(s["lo"], int(at_lo.min())), hi=max(s["hi"], int(at_hi.max())))
                    continue
                i = broken[0]
            s.update(chunk=c, seq=leave[i], lo=int(leave_lo[i]), hi=int(leave_hi[i]))

    at_chunks = ordered.scan_sorted(runs, [key], ["_seq"], dict, step, lambda s, k, out: None,
                                    f"{of_key}, _chunk bigint, _mark int, _seq {of_seq}, _lo bigint, _hi bigint")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for b in batches:
            if b.empty:
                continue
            keys, chunks, start, end, seqs, mark = (b[c].to_numpy() for c in (key, "_chunk", "_lo", "_hi", "_seq", "_mark"))
            bounds, _ = _cut(b, [key, "_chunk", "_mark"])
            nxt = _next_breaks(start, end, max_gap, max_span).tolist()
            runs_of, out = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                at = (keys[a], chunks[a])
                if at != group:
                    group, state = at, None
                if mark[a] == 0:
                    state = (seqs[a], start[a], end[a])
                    continue
                cut, i = [a], a
                if state:
                    lo, hi = _running(start[a:z], np.minimum, state[1]), _running(end[a:z], np.maximum, state[2])
                    broken = np.flatnonzero(_breaks(start[a:z], end[a:z], lo, hi, max_gap, max_span))
                    i = a + broken[0] if len(broken) else z
                    cut = [a] if i > a else []
                named = [state[0]] if state and i > a else []
                if i > a:
                    cut.append(i)
                elif not cut:
                    cut = [i]
                while i < z:
                    i = nxt[i]
                    cut.append(min(i, z))
                cut = np.array(cut)
                named = np.append(np.array(named, dtype=seqs.dtype), seqs[cut[len(named):-1]])
                lo, hi = np.minimum.reduceat(start[a:z], cut[:-1] - a), np.maximum.reduceat(end[a:z], cut[:-1] - a)
                runs_of.append(a)
                out.append((named, lo, hi, np.diff(cut)))
                same = state is not None and named[-1] == state[0]
                state = (named[-1], min(lo[-1], state[1]) if same else lo[-1], max(hi[-1], state[2]) if same else hi[-1])
            if out:
                # one frame a batch: a key may have a few intervals only
                of = b[key].take(np.repeat(runs_of, [len(o[0]) for o in out])).reset_index(drop=True)
                yield pd.DataFrame({key: of} | {c: np.concatenate(v) for c, v in zip(("_seq", "lo", "hi", "n"), zip(*out))})

    found = in_order(marked.unionByName(at_chunks)).mapInPandas(parts, f"{of_key}, _seq {of_seq}, lo bigint, hi bigint, n bigint")
    whole = found.groupBy(key, "_seq").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo")).alias("length"), F.sum("n").alias("members"))
    whole = cut_lineage(whole)  # read twice
    # inside a struct a null key equals itself in the join
    no = ordered.running_sum(whole.withColumn("_key", F.struct(key)), ["_key"], "_seq", F.lit(1), "_no", chunk)
    return no.select(key, (F.col("_no") - 1).cast("bigint").alias("batch_no"), "start", "length", "members")
