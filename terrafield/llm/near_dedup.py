"""Near-dedup by HyperMinHash: compressed registers, banding, corrected Jaccard estimates, exact links, components.

A text's set is its distinct five-word shingles, as 64-bit fingerprints.  One hash of a shingle picks a bucket and a
value; a bucket's register keeps the smallest value's count of leading zeros and the mantissa bits after them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import components
from ..session import cut_lineage, forget
from .columns import tidy, whole
from .pretokens import Fingerprints

SHINGLE = 5
VALUE_BITS = 52
#: The factor of expected register collisions in the published estimator (a fixed value).
COLLISIONS = 0.169919487159739093975315012348
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts that a worker has in arrays at once.
BATCH = 128
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Sketch:
    """``bands`` bands of ``rows`` registers find a pair at the threshold with probability 1 - (1 - 0.75**rows)**bands,
    2.4e-8 short of certain.  Sets of up to ``small`` shingles are too few for that and are also keyed by their smallest
    shingles, as many as any set similar enough must share one of (prefix filtering), which is exact.

    ``deviations``: a pair is verified unless its estimate lies so many standard deviations below the threshold.
    Groups are compared in blocks of ``block_rows`` rows and ``block_shingles`` shingles at most.
    """

    percent: int = 75
    bands: int = 32
    rows: int = 3
    mantissa: int = 16
    small: int = 32
    deviations: float = 6.0
    block_rows: int = 1500
    block_shingles: int = 1_500_000
    #: Bands that are compared together; later rounds leave out what is connected by then.
    rounds: tuple[tuple[int, int], ...] = ((0, 1), (1, 3), (3, 10), (10, 1 << 30))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_WEIGHTS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_PRINTS = Fingerprints(seed=11)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of every text.  Fewer words than a shingle has make one; no word makes none."""
    data = [t.encode().translate(_LOWER) + b"\n" for t in texts]
    size = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    space = _IS_SPACE[flat]
    edge = np.diff(space.astype(np.int8), prepend=1)  # every text ends with a space
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(flat) and space[0]:
        ends = ends[ends > 0]
    word = _PRINTS.of(flat, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    bound = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
    with np.errstate(over="ignore"):
        n = max(0, len(word) - SHINGLE + 1)
        sums = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            sums += word[j : j + n] * _WEIGHTS[j]
        sums = _mix(sums)
        out = []
        for s, e in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if e - s >= SHINGLE:
                out.append(np.unique(sums[s : e - SHINGLE + 1]))
            elif e > s:
                out.append(_mix((word[s:e] * _WEIGHTS[: e - s]).sum(keepdims=True) + np.uint64(e - s)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], k: Sketch) -> np.ndarray:
    """One row per set: per bucket 0 if it is empty, else 1 + (leading zeros, mantissa) of its smallest value."""
    out = np.zeros(len(sets) * k.registers, np.int64)
    n = np.array([len(s) for s in sets])
    if n.sum():
        h = np.concatenate(sets)
        value = (h >> np.uint64(64 - VALUE_BITS)).astype(np.int64)
        bucket = ((h & np.uint64(0xFFF)) % np.uint64(k.registers)).astype(np.int64) + np.repeat(np.arange(len(sets)), n) * k.registers
        out[bucket[::-1]] = value[::-1] + 1  # sets are sorted, so the smallest value of a bucket is written last
    filled = out > 0
    v = out[filled] - 1
    zeros = VALUE_BITS - np.frexp(v.astype(np.float64))[1]
    fraction = ((v << zeros) >> (VALUE_BITS - 1 - k.mantissa)) & ((1 << k.mantissa) - 1)
    out[filled] = 1 + ((zeros << k.mantissa) | fraction)
    return out.reshape(len(sets), k.registers).astype(np.int32)


def keys(sets: list[np.ndarray], regs: np.ndarray, k: Sketch) -> list[list[tuple[int, int]]]:
    """Per set its (band, key) pairs; keys of small sets have band numbers from ``bands`` on."""
    triples = regs.reshape(len(sets), k.bands, k.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, k.bands + 1, dtype=np.uint64)[None].repeat(len(sets), axis=0)
        for j in range(k.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + triples[:, :, j])
    some = triples.any(axis=2)
    key = key.view(np.int64)
    out = []
    for i, s in enumerate(sets):
        b = np.flatnonzero(some[i])
        own = list(zip(b.tolist(), key[i, b].tolist()))
        if 0 < len(s) <= k.small:
            first = _mix(s[: len(s) + (-k.percent * len(s)) // 100 + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)
            own += [(k.bands, x) for x in first.tolist()]
        out.append(own)
    return out


def _by_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(id_col).alias("h"))


def _identity(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    with np.errstate(over="ignore"):
        k1 = np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        k2 = np.array([_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return k1.view(np.int64), k2.view(np.int64)


def sketch_table(rows: DataFrame, k: Sketch) -> DataFrame:
    """Per row: ``__id``, ``h``, ``n``, ``k1``, ``k2`` and ``keys``.  Sets and registers are made again for the few rows
    that need them: they are larger than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
                own = keys(sets, registers(sets, k), k)
                k1, k2 = _identity(sets)
                pairs = pa.array([[{"band": b, "key": x} for b, x in o] for o in own], pa.list_(pa.struct([("band", pa.int32()), ("key", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pairs], names=["__id", "h", "n", "k1", "k2", "keys"])
        tidy()

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, h long, n long, k1 long, k2 long, keys array<struct<band:int,key:long>>")


FILTER_BITS = 26


def _bit_of(h: np.ndarray, k1: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k1.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def row_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the rows (h, k1) in ``wanted``, of 8 MB at any size; a full one only lets more rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = wanted.select("h", "k1").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, h: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Which of the rows a bitmap of ``row_filter`` lets pass."""
    bit = _bit_of(h, k1)
    return ((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def content_table(rows: DataFrame, passing: np.ndarray, k: Sketch) -> DataFrame:
    """``h``, ``n``, ``k1``, ``k2``, ``regs`` and ``set`` (binary) of the rows that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
                k1, k2 = _identity(sets)
                h = batch.column(2).to_numpy()
                bit = _bit_of(h, k1)
                take = np.flatnonzero((passing[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                sets = [sets[i] for i in take.tolist()]
                regs = registers(sets, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[take]), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1[take]), pa.array(k2[take]), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["h", "n", "k1", "k2", "regs", "set"],
                )
        tidy()

    return rows.mapInArrow(run, "h long, n long, k1 long, k2 long, regs binary, set binary")


#: Rows of a group that are held against all others at once.
SLAB = 256


def estimates(regs: np.ndarray, n: np.ndarray, k: Sketch, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows ``lo`` to ``hi`` with all rows, corrected for chance collisions, and the registers they
    rest on."""
    some = regs[lo:hi]
    hits = np.zeros((len(some), len(regs)), np.int16)
    for column, own in zip(regs.T, some.T):
        hits += (own[:, None] == column[None]) & (own[:, None] != 0)
    filled = (regs != 0).astype(np.float32)
    count = filled.sum(axis=1)
    either = count[lo:hi, None] + count[None] - filled[lo:hi] @ filled.T
    ratio = n[lo:hi, None].astype(np.float32) / n[None].astype(np.float32)
    chance = np.float32(COLLISIONS * k.registers * 2.0**-k.mantissa * 4) * ratio / (1 + ratio) ** 2
    return (hits - chance) / np.maximum(either, 1), either


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (float32, exact), by products of slices of the incidence matrix."""
    g = len(sets)
    owner = np.repeat(np.arange(g, dtype=np.int32), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1, dtype=np.int32) - 1)[at[shared]]
    out = np.zeros((g, g), np.float32)
    width = max(1, min(int((times > 1).sum()), 1_000_000 // g))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int((times > 1).sum()), width):
        s, e = np.searchsorted(at, [lo, lo + width])
        slab = np.zeros((g, width), np.float32)
        slab[owner[s:e], at[s:e] - lo] = 1
        for i in range(0, g, SLAB):
            out[i : i + SLAB] += slab[i : i + SLAB] @ slab.T
    return out


def linked(ids: np.ndarray, comps: np.ndarray, n: np.ndarray, regs: np.ndarray, sets, k: Sketch) -> list[tuple[int, int]]:
    """Edges that connect all rows of one group which confirmed links connect.

    Pairs within one component need no look; others are estimated, then counted on their full sets.
    """
    g, t = len(ids), k.percent / 100
    likely = np.zeros((g, g), bool)
    for lo in range(0, g, SLAB):
        hi = min(g, lo + SLAB)
        est, rests_on = estimates(regs, n, k, lo, hi)
        least = t - k.deviations * np.sqrt(t * (1 - t) / np.maximum(rests_on, 1))
        own, all_ = n[lo:hi, None], n[None]
        likely[lo:hi] = (est >= least) & (100 * np.minimum(own, all_) >= k.percent * np.maximum(own, all_)) & (comps[lo:hi, None] != comps[None])
    rows = np.flatnonzero(likely.any(axis=1))
    if not len(rows):
        return []
    links, m = likely[np.ix_(rows, rows)], n[rows]
    both = common([sets(i) for i in rows.tolist()])
    for lo in range(0, len(rows), SLAB):
        part = both[lo : lo + SLAB].astype(np.int64)
        links[lo : lo + SLAB] &= 100 * part >= k.percent * (m[lo : lo + SLAB, None] + m[None] - part)
    edges, todo = [], np.ones(len(rows), bool)
    for i in range(len(rows)):
        if not todo[i]:
            continue
        todo[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & todo)
            todo[front] = False
            edges += [(int(ids[rows[i]]), int(ids[rows[j]])) for j in front.tolist()]
    return edges


def _group_links(k: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive sorted by group; a group's rows are held until the next begins.
        held: list[tuple] = []
        current = None

        def close(held: list[tuple]) -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, comps, n, regs, sets = zip(*held)
            return linked(np.array(ids), np.array(comps), np.array(n), np.stack([np.frombuffer(r, np.int32) for r in regs]), lambda i: np.frombuffer(sets[i], np.uint64), k)

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["src", "dst"])

        for batch in batches:
            edges = []
            groups = list(zip(*[batch.column(c).to_pylist() for c in range(3)]))
            columns = [batch.column(c) for c in range(3, 8)]
            ids, comps, n = (c.to_pylist() for c in columns[:3])
            for i, g in enumerate(groups):
                if g != current:
                    edges += close(held)
                    held, current = [], g
                held.append((ids[i], comps[i], n[i], columns[3][i].as_py(), columns[4][i].as_py()))
            yield batch_of(edges)
        yield batch_of(close(held))
        held.clear()
        tidy()

    return run


def shared_keys(reps: DataFrame) -> DataFrame:
    """``reps``: cid, n, keys, one row per distinct set.  cid, n, band, key of the keys that two or more have."""
    members = reps.select("cid", "n", F.explode("keys").alias("e")).select("cid", "n", "e.band", "e.key")
    shared = members.groupBy("band", "key").agg(F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    return members.join(shared, ["band", "key"])


def near_links(members: DataFrame, content: DataFrame, k: Sketch) -> DataFrame:
    """Labels (node_id, comp) of the members, by links confirmed on ``content`` (cid, regs, set).

    A key's members are compared with each other inside the task that gets them, and only edges leave it.  Keys with
    the same members count once, keys within one component not at all.  Keys with many members are dealt out in pairs
    of blocks.  Where one component has most members of a key, these are dealt to the blocks of the others only, so
    stragglers of a group that is connected already cost its rows once, not its rows times its blocks.
    """
    spark = members.sparkSession
    edges = spark.createDataFrame([], "src long, dst long")
    nodes = members.select(F.col("cid").alias("node_id")).distinct()
    labels = nodes.withColumn("comp", F.col("node_id"))
    written = []
    for lo, hi in k.rounds:
        now = members.filter((F.col("band") >= lo) & (F.col("band") < hi)).join(labels.withColumnRenamed("node_id", "cid"), "cid")
        per = now.groupBy("band", "key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("all"), F.bit_xor(F.xxhash64("cid")).alias("who"))
        most = F.max(F.struct("c", "comp", "all"))
        keys_ = per.groupBy("band", "key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("all").alias("all"), F.bit_xor("who").alias("who"), most.alias("most")).filter("comps > 1")
        once = keys_.groupBy("who", "c").agg(F.min(F.struct("band", "key")).alias("k"), F.first("all").alias("all"), F.first("most").alias("most"))
        apart = F.col("most.c") > k.block_rows // 2

        def blocks(c, n):
            return F.ceil(F.greatest(c / k.block_rows, n / k.block_shingles)).cast("int")

        of_rest = F.when(apart, blocks(F.col("c") - F.col("most.c"), F.col("all") - F.col("most.all"))).otherwise(blocks(F.col("c"), F.col("all")))
        of_most = F.when(apart, blocks(F.col("most.c"), F.col("most.all"))).otherwise(0)
        once = once.select("k.band", "k.key", F.when(apart, F.col("most.comp")).alias("big"), of_rest.alias("rest"), of_most.alias("most"))
        placed = now.join(once, ["band", "key"]).withColumn("in_big", F.col("comp").eqNullSafe(F.col("big")))
        h = F.xxhash64("cid")
        own = F.when(F.col("in_big"), F.col("rest") + F.pmod(h, F.greatest("most", F.lit(1)))).otherwise(F.pmod(h, F.greatest("rest", F.lit(1)))).cast("int")
        last = F.when(F.col("in_big"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
        dealt = placed.select("cid", "comp", "n", "band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        dealt = dealt.select("cid", "comp", "n", F.xxhash64("band", "key").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        rows = dealt.join(content, "cid").select("g", "i", "j", "cid", "comp", "n", "regs", "set")
        found = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_group_links(k), "src long, dst long")
        edges = cut_lineage(edges.unionByName(found).distinct())
        labels = cut_lineage(components(nodes, edges))
        for done in written:
            forget(done)
        written = [edges, labels]
    forget(edges)
    return labels


def near_groups(docs: DataFrame, k: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``n_shingles``, ``component_id``, ``kept``, ``first``.

    Texts with 100 * common >= 75 * all shingles are linked; ``component_id`` is the smallest id that links reach, the
    row's own included, and ``kept`` whether the row has it.  ``first`` marks one row of each component (it differs
    from ``kept`` only when rows share an id).  Ids that are null come after all others.  A null text, or one without
    words, is linked with nothing.

    Equal sets are one class, so copies are never paired.  Links are exact once a pair shares a key; ``Sketch`` says
    how surely it does.
    """
    rows = _by_row(docs, id_col, text_col)
    table = cut_lineage(sketch_table(rows, k).withColumn("rid", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("rid").alias("rid"), F.col("h").alias("h")))
    classes = cut_lineage(table.filter("n > 0").groupBy("n", "k1", "k2").agg(best.alias("best")).withColumn("cid", F.col("best.rid")))
    reps = table.select(F.col("rid").alias("cid"), "n", "keys").join(classes.select("cid"), "cid", "left_semi")
    members = cut_lineage(shared_keys(reps))
    needed = cut_lineage(classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "k1", "k2", F.col("best.h").alias("h")))
    content = content_table(rows, row_filter(needed), k).join(needed, ["n", "k1", "k2", "h"]).dropDuplicates(["cid"]).select("cid", "regs", "set")
    content = cut_lineage(content)
    labels = near_links(members, content, k)
    for done in (members, needed, content):
        forget(done)
    named = classes.join(labels.withColumnRenamed("node_id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    tops = named.groupBy("comp").agg(F.min("best").alias("top"))
    of_class = named.join(tops, "comp").select("n", "k1", "k2", "top")
    out = table.select("rid", "__id", "n", "k1", "k2").join(of_class, ["n", "k1", "k2"], "left")
    component = F.when(F.col("top").isNull(), F.col("__id")).otherwise(F.col("top.id"))
    return out.select(
        F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"),
        F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("first"),
    )


def drop_near_copies(docs: DataFrame, k: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Rows are known by id and text; of rows that repeat both one stays.
    """
    key = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.sha2(whole(F.col(text_col)), 256).alias("sha"))
    groups = near_groups(docs.select(key.alias("key"), F.col(text_col).alias("text")), k, "key", "text")
    gone = groups.groupBy("key").agg(F.max("first").alias("any")).filter("not any").select(F.col("key.id").alias("__gid"), F.col("key.sha").alias("__gsha"))
    keyed = docs.withColumn("__sha", F.sha2(whole(F.col(text_col)), 256))
    left = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__gid")) & (F.col("__sha") == F.col("__gsha")), "left_anti")
    once = F.row_number().over(Window.partitionBy(id_col, "__sha").orderBy("__sha"))
    return left.withColumn("__once", once).filter("__once = 1").select(*docs.columns)
