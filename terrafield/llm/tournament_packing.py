"""First-fit-decreasing packing by a tournament tree of bin capacities, in randomised groups of documents.

Documents may be cut anywhere, so every group packs without padding: what is longer than a sequence fills sequences of
its own, the remainders are packed first-fit-decreasing, the emptiest bins are then cut up to fill the gaps of the
others, and the one bin that is left is cut into sequences of a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import tidy
from .library_bpe import model, with_end

LIMIT = 2048
#: Sequences of a group are numbered within so many.
SPAN = 1 << 32


class BinTree:
    """Capacities of ``n`` bins under a tournament: every inner node holds the larger of its two children."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes ``size`` from the first bin that has room for it, and gives the bin's number."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        out = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            m = max(best[2 * at], best[2 * at + 1])
            if best[at] == m:
                break
            best[at] = m
        return out


def first_fit_decreasing(sizes: list[int], limit: int) -> list[list[int]]:
    """``sizes`` descending, each of 1 to ``limit``: per bin the positions of its sizes."""
    tree, bins = BinTree(len(sizes), limit), []
    for i, size in enumerate(sizes):
        b = tree.first_fit(size)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def _cut(pieces: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Takes pieces (document, start, length) of together ``size`` ids off the end of ``pieces``."""
    out = []
    while size:
        doc, start, length = pieces.pop()
        take = min(size, length)
        if take < length:
            pieces.append((doc, start, length - take))
        out.append((doc, start + length - take, take))
        size -= take
    return out


def plan_group(lengths: list[int], limit: int) -> list[list[tuple[int, int, int]]]:
    """``lengths`` of at least 1: sequences as lists of pieces (document, start, length).

    Every sequence has ``limit`` ids, but for those that the last bin makes, at most one of each smaller power of two
    that adds up to it (``limit`` itself a power of two).
    """
    full = [[(d, s, limit)] for d, n in enumerate(lengths) for s in range(0, n - n % limit, limit)]
    rest = sorted(((n % limit, d) for d, n in enumerate(lengths) if n % limit), key=lambda x: (-x[0], x[1]))
    if not rest:
        return full
    bins = [[(rest[i][1], lengths[rest[i][1]] - rest[i][0], rest[i][0]) for i in b] for b in first_fit_decreasing([r for r, _ in rest], limit)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    i, j = 0, len(order) - 1
    while i < j:  # the emptiest bin gives to the fullest one that has a gap
        to, giver = order[i], order[j]
        move = min(limit - fill[to], fill[giver])
        bins[to] += _cut(bins[giver], move)
        fill[to], fill[giver] = fill[to] + move, fill[giver] - move
        i += fill[to] == limit
        j -= fill[giver] == 0
    out = full + [bins[b] for b in order if fill[b] == limit]
    last = next((b for b in order if 0 < fill[b] < limit), None)
    while last is not None and fill[last]:
        part = 1 << (fill[last].bit_length() - 1)
        out.append(_cut(bins[last], part))
        fill[last] -= part
    return out


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Written: ``__id``, ``__row`` (its own number per row), ``__n`` and ``__ids`` (little-endian, 16 bits each if none needs more)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, bounds = with_end(*bpe.encode([t or "" for t in batch.column(1).to_pylist()]), end_id)
                ids = ids.astype("<u2" if bpe.size <= 1 << 16 and end_id < 1 << 16 else "<u4")
                values = [ids[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(values, pa.binary())], names=["__id", "__n", "__ids"])
        tidy()

    rows = docs.select(id_col, text_col).mapInArrow(run, f"__id {kind}, __n long, __ids binary")
    return cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()), "zstd")


def pack_freely(
    docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, group_docs: int = 256, group_ids: int = 1 << 19
) -> DataFrame:
    """One row per piece: ``<id_col>``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit; or ``ids_crc32``
    of them with ``digest``), ``doc_tokens``, ``sequence_id`` and ``offset``.

    Every text is encoded whole and ``end_id`` appended; a null text counts as empty and is the end id alone.  Each id
    lies in exactly one piece.  Rows are dealt at random into groups of about ``group_docs`` rows or ``group_ids`` ids,
    whichever gives more groups, and each is packed by itself: rows that repeat an id or a text are rows like any
    other.  All sequences are full, but for a few of a smaller power of two a group.  No rows give no rows; other columns are not read.

    Ids are written once (jobs run when this is called), so that a lost executor costs a read and rows keep their group.
    """
    if limit & (limit - 1):
        raise ValueError("limit has to be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    name, value, value_type = ("ids_crc32", zlib.crc32, pa.int64()) if digest else ("ids", bytes, pa.binary())
    rows = _encoded(docs, tokenizer, end_id, id_col, text_col)
    n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-tokens // group_ids))
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups))).repartition("__group").sortWithinPartitions("__group", "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lengths, ids = table.column(1).to_numpy(), table.column(2)
            out = [(d, s, k, q, o) for q, sequence in enumerate(plan_group(lengths.tolist(), limit)) for (d, s, k), o in zip(sequence, np.cumsum([0, *(p[2] for p in sequence)]).tolist())]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*out))
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)  # of bytes
            width = (at[1] - at[0]) // lengths[0]
            data = np.frombuffer(ids.buffers()[2], "<u2" if width == 2 else "<u4").astype("<u4")
            first = at[doc] // width + start
            values = [value(data[f : f + k].tobytes()) for f, k in zip(first.tolist(), length.tolist())]
            return pa.RecordBatch.from_arrays(
                [table.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(values, value_type), pa.array(lengths[doc]), pa.array(group * SPAN + sequence), pa.array(offset)],
                names=[id_col, "start", "length", name, "doc_tokens", "sequence_id", "offset"],
            )

        current, held = None, []  # rows arrive sorted by group
        for batch in batches:
            group = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if held and group[s] != current:
                    yield close(current, held)
                    held = []
                current = int(group[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield close(current, held)
        held.clear()
        tidy()

    schema = f"`{id_col}` {kind}, start long, length long, {name} {'long' if digest else 'binary'}, doc_tokens long, sequence_id long, offset long"
    return dealt.select("__id", "__n", "__ids", "__group").mapInArrow(run, schema)
