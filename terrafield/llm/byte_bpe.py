"""Byte-level BPE: encoding by a rank file and decoding, without the libraries that usually do it."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import SliceEncoder, Splitter


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the neighbours of lowest rank, leftmost first, until none are left to join: O(n log n) with a heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
    alive = [True] * n

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heap.append((r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue  # one of the two has been joined meanwhile
        j = end[i]
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
        for k in (before[i], i):
            if k >= 0 and end[k] < n and (r := ranks.get(piece[k : end[end[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.encoder = SliceEncoder(lambda pieces: [merge_bytes(p, ranks) for p in pieces], Splitter())
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.decimal = [str(i) for i in range(len(self.vocabulary))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_models: dict[str, ByteBpe] = {}


def model(path: str) -> ByteBpe:
    """One per Python worker, so that its cache lasts over batches and tasks."""
    if path not in _models:
        _models[path] = ByteBpe(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``ids`` (array<int>), ``n_tokens`` (long).

    A null text counts as empty and has no ids.  Slices equal those of the usual pattern; each is merged on its own.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids, bounds = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(bounds))], names=[id_col, "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded`` (``<id_col>``, ``ids``): ``<id_col>``, ``bytes`` (binary); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_texts`` then the decoder, as digests: ``<id_col>``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Both run in one pass over the batches, so that neither ids nor bytes leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids, bounds = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            of_ids, of_bytes = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = ids[s:e].tolist()
                of_ids.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, own)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
