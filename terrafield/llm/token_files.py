"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of how many bits they hold.

A file is a folder of chunks.  A chunk holds the ids of consecutive documents:

    'S8B1' | counts: blocks, documents (2 x u32) | blocks: ids, words, escapes (3 x u32 each)
    | documents: ids (u32 each) | words of all blocks (u64) | escapes of all blocks: place in block, id (2 x u64 each)

All numbers are little-endian.  A block has ``BLOCK_IDS`` ids, the last one fewer; a block's words and escapes follow
from the counts of the blocks before it, so any block can be decoded alone and all can be decoded at once.  A word has
its selector in the top four bits and the first id lowest.  Ids of more than 60 bits stand as 0 and are escapes.

Chunks are rows of Parquet files, which give atomic task commits on any store that Spark writes to; ``part`` and
``chunk`` order them, ``first`` is the number of ids before the chunk within its part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import tidy
from .library_bpe import model, with_end

MAGIC = b"S8B1"
BLOCK_IDS = 1024
CHUNK_IDS = 1 << 20
#: Ids in a word and bits of each, by selector.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks' counts (ids, words, escapes), words, and escapes (place, id) of ``ids`` (uint64).

    All blocks take their words side by side: at each step every block takes the selector that holds most of what is
    left of it.
    """
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    size = np.full(blocks, BLOCK_IDS, np.int64)
    if n:
        size[-1] = n - (blocks - 1) * BLOCK_IDS
    width = BLOCK_IDS + SELECTORS[0][0]
    grid = np.zeros((blocks, width), np.uint64)
    grid[:, :BLOCK_IDS].ravel()[:0]  # rows are padded with zeros, which fit any selector
    padded = np.zeros(blocks * BLOCK_IDS, np.uint64)
    padded[:n] = ids
    grid[:, :BLOCK_IDS] = padded.reshape(blocks, BLOCK_IDS)
    out = np.argwhere(grid >> np.uint64(60))
    escapes = np.stack([out[:, 1].astype(np.uint64), grid[out[:, 0], out[:, 1]]], axis=1) if len(out) else np.zeros((0, 2), np.uint64)
    n_escapes = np.bincount(out[:, 0], minlength=blocks) if len(out) else np.zeros(blocks, np.int64)
    grid[out[:, 0], out[:, 1]] = 0
    best = np.full((blocks, BLOCK_IDS), len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):  # from few ids in a word to many; the last that fits stays
        count, bits = SELECTORS[s]
        wide = np.zeros((blocks, width + 1), np.int32)
        np.cumsum(grid >> np.uint64(bits) != 0, axis=1, out=wide[:, 1:])
        fits = wide[:, count : count + BLOCK_IDS] == wide[:, :BLOCK_IDS]
        if not fits.any():
            break  # what does not fit with few ids does not fit with more of fewer bits
        best[fits] = s
    taken = np.array([c for c, _ in SELECTORS])
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    rows, starts, chosen = [], [], []
    while True:
        row = row[at[row] < size[row]]
        if not len(row):
            break
        s = best[row, at[row]]
        rows.append(row)
        starts.append(at[row])
        chosen.append(s)
        at[row] += taken[s]
    if not rows:
        return np.zeros((0, 3), np.uint32), np.zeros(0, np.uint64), escapes
    rows_, starts_, chosen_ = np.concatenate(rows), np.concatenate(starts), np.concatenate(chosen)
    order = np.lexsort((starts_, rows_))
    rows_, starts_, chosen_ = rows_[order], starts_[order], chosen_[order]
    words = chosen_.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen_):
        count, bits = SELECTORS[s]
        w = np.flatnonzero(chosen_ == s)
        for j in range(count):
            words[w] |= grid[rows_[w], starts_[w] + j] << np.uint64(j * bits)
    table = np.stack([size, np.bincount(rows_, minlength=blocks), n_escapes], axis=1).astype(np.uint32)
    return table, words, escapes


def unpack_ids(table: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of all blocks, one selector at a time."""
    size, n_words = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
    first = np.cumsum(size) - size
    block = np.repeat(np.arange(len(table)), n_words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([c for c, _ in SELECTORS])[selector]
    before = np.cumsum(count) - count
    block_start = np.cumsum(n_words) - n_words
    place = before - (before[np.minimum(block_start, max(0, len(words) - 1))] if len(words) else before[:0])[block]  # in the block
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(selector):
        c, bits = SELECTORS[s]
        w = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(c):
            inside = place[w] + j < size[block[w]]
            v = w[inside]
            out[first[block[v]] + place[v] + j] = (words[v] >> np.uint64(j * bits)) & mask
    if len(escapes):
        of = np.repeat(np.arange(len(table)), table[:, 2].astype(np.int64))
        out[first[of] + escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def write_chunk(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    table, words, escapes = pack_ids(ids.astype(np.uint64))
    return b"".join([MAGIC, struct.pack("<II", len(table), len(lengths)), table.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the number of ids of each document."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    blocks, docs = struct.unpack_from("<II", data, 4)
    table = np.frombuffer(data, "<u4", blocks * 3, 12).reshape(blocks, 3)
    lengths = np.frombuffer(data, "<u4", docs, 12 + blocks * 12)
    at = 12 + blocks * 12 + docs * 4
    words = np.frombuffer(data, "<u8", int(table[:, 1].sum()), at)
    escapes = np.frombuffer(data, "<u8", 2 * int(table[:, 2].sum()), at + 8 * len(words)).reshape(-1, 2)
    return unpack_ids(table, words, escapes), lengths


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the ids, ``end_id`` after each document, in ascending order of ``<id_col>``.

    A null text counts as empty (its document is the end id alone); null ids come first; rows of equal id are ordered
    by text.  Texts are range-partitioned by id and encoded after that, so ids are written where they arise.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    ordered = docs.select(F.col(id_col).alias("__id"), text).repartitionByRange(parts, "__id", F.xxhash64("__text")).sortWithinPartitions("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        chunk, first, held, ids_held, n_held = 0, 0, [], [], 0
        schema = ["chunk", "first", "n_ids", "doc_ids", "data"]

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first, held, ids_held, n_held
            lengths = np.concatenate([np.diff(b) for _, b in held])
            doc_ids = pa.concat_arrays(ids_held)
            data = write_chunk(np.concatenate([i for i, _ in held]), lengths)
            row = [pa.array([chunk], pa.int32()), pa.array([first]), pa.array([n_held]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([data], pa.binary())]
            chunk, first, held, ids_held, n_held = chunk + 1, first + n_held, [], [], 0
            return pa.RecordBatch.from_arrays(row, names=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                ids, bounds = with_end(*bpe.encode(piece.column(1).to_pylist()), end_id)
                held.append((ids, bounds))
                ids_held.append(piece.column(0))
                n_held += len(ids)
                if n_held >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()
        tidy()

    out = ordered.mapInArrow(run, f"chunk int, first long, n_ids long, doc_ids array<{kind}>, data binary").withColumn("part", F.spark_partition_id())
    out.write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``<id_col>``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary,
    little-endian unsigned 32-bit)."""
    return _read(spark, folder, id_col, "ids binary", lambda x: x.tobytes(), pa.binary())


def read_token_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """As ``read_token_files`` with ``ids_crc32`` (long, of the same bytes) in place of the ids."""
    return _read(spark, folder, id_col, "ids_crc32 long", lambda x: zlib.crc32(x.tobytes()), pa.int64())


def _read(spark: SparkSession, folder: str, id_col: str, column: str, value, value_type) -> DataFrame:
    chunks = spark.read.parquet(folder)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(totals.select("part", before.alias("before")))  # a row per range partition, so small enough to send

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = read_chunk(batch.column(2)[row].as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                values = [value(ids[s:e]) for s, e in zip(begins.tolist(), ends.tolist())]
                doc_ids = batch.column(1).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(begins + batch.column(0)[row].as_py()), pa.array(lengths.astype(np.int64)), pa.array(values, value_type)], names=[id_col, "start", "n_tokens", column.split()[0]])

    placed = chunks.join(F.broadcast(starts), "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "data")
    return placed.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, {column}")
