"""The prefix trie of conversations: range-partitioned shards around a skeleton of splitter paths.

A conversation is a path of turn keys.  Paths are sorted into shards at splitters taken from a sample.  A node that is
no prefix of a splitter has all its members in one shard and is finished there, by one pass over sorted paths with a
stack.  The prefixes of splitters are the skeleton, which every task gets; shards only add to its nodes, and the
partial sums are reduced, joined up the skeleton and added to.

Long conversations are cut every ``segment`` turns.  The trie of later segments, rooted at what came before, is made
first and hands its sums to the node that it hangs on.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import tidy, whole

#: Bytes of a turn's key.
KEY = 16
_CHUNK = 1 << 16


@dataclass(frozen=True)
class Shape:
    """``segment`` turns at most are one row; a splitter is picked from about ``sample`` sampled rows a shard; the skeleton has
    at most shards * ``segment`` nodes.  ``borrow`` and ``cycle`` say how conversations are rebuilt."""

    segment: int = 1024
    sample: int = 40
    shards: int | None = None  # spark.sql.shuffle.partitions
    borrow: int = 5
    cycle: int = 9


# --- conversations as rows of paths ------------------------------------------------------------------------------

def numbered_turns(turns: DataFrame) -> DataFrame:
    """Written: ``c``, ``o`` (1, 2, ... in the order of turn, role and key), ``key`` and ``size`` (bytes of the text).

    Order comes from a range partitioning of short rows, and numbers from counts per (conversation, partition), so that a
    conversation may be any share of all rows.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    short = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("u"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "key", "u"]
    placed = short.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "key", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = cut_lineage(placed)
    runs = rows.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("c", "part", (F.col("first") - before).alias("zero"))
    return cut_lineage(rows.join(starts, ["c", "part"]).select("c", (F.col("at") - F.col("zero") + 1).alias("o"), "key", "size"))


def rebuilt_turns(numbered: DataFrame, s: Shape) -> tuple[DataFrame, DataFrame]:
    """Conversations (``c``), and their rebuilt turns ``c``, ``p`` (1, 2, ...), ``key``, ``size``."""
    convs = numbered.groupBy("c").agg(F.max("o").alias("n"))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % s.cycle
    named = convs.select("c", (F.col("c") - F.col("c") % s.borrow).alias("b"), head.alias("h"))
    known = named.join(convs.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b", "left")
    lent = numbered.filter(F.col("o") < s.cycle).withColumnRenamed("c", "b").join(named, "b").filter("o <= h").select("c", F.col("o").alias("p"), "key", "size")
    from_base = F.least("h", F.coalesce("nb", F.lit(0)))
    own = numbered.join(known, "c").filter("o > h").select("c", (from_base + F.col("o") - F.col("h")).alias("p"), "key", "size")
    return convs.select("c"), own.unionByName(lent)


def segments(convs: DataFrame, turns: DataFrame, s: Shape) -> DataFrame:
    """Written: ``c``, ``level``, ``path`` (binary), ``sizes``, ``ends`` and, from level 1 on, ``root``: what came before."""
    last = turns.groupBy("c").agg(F.max("p").alias("depth"))
    part = turns.withColumn("level", F.floor((F.col("p") - 1) / s.segment).cast("int")).groupBy("c", "level").agg(F.sort_array(F.collect_list(F.struct("p", "key", "size"))).alias("t"))
    empty = convs.join(last, "c", "left_anti").select("c", F.lit(0).alias("level"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("sizes"), F.lit(True).alias("ends"))
    path = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["key"]))
    rows = part.join(last, "c").select("c", "level", path.alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"), (F.col("depth") <= (F.col("level") + 1) * s.segment).alias("ends")).unionByName(empty)
    before = Window.partitionBy("c").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    mark = [F.bit_xor(F.xxhash64(F.lit(i), F.col("level"), F.col("path"))).over(before) for i in (0, 1)]
    root = F.unhex(F.concat(*[F.lpad(F.hex(m), 16, "0") for m in mark]))
    return cut_lineage(rows.withColumn("root", F.coalesce(root, F.lit(b""))))


# --- one level's trie --------------------------------------------------------------------------------------------

def _splitters(rows: DataFrame, n: int, s: Shape) -> list[tuple[bytes, int]]:
    """At most ``n - 1`` (path, c) that cut the rows into shards of about equal size."""
    total = rows.count()
    share = min(1.0, s.sample * n / max(1, total))
    drawn = sorted((bytes(r["path"]), r["c"]) for r in rows.select("path", "c").sample(share, seed=7).collect())  # some ``sample * n`` rows
    return sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Numbers of all prefixes of the splitters' paths, shorter ones before longer ones."""
    nodes = {p[:i] for p, _ in splitters for i in range(0, len(p) + 1, KEY)} | {b""}
    return {p: i for i, p in enumerate(sorted(nodes, key=lambda p: (len(p), p)))}


class _Open:
    """A node on the stack, with the sums of its members and finished children so far."""

    __slots__ = ("place", "size", "n", "least", "children", "leaves", "saved", "digest", "ids", "held")

    def __init__(self, place: int | None, size: int):
        self.place, self.size = place, size  # number in the skeleton, or None
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.digest, self.ids, self.held = None, [], []

    def join(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def end(self, c: int) -> None:
        self.join(1, c)
        self.ids.append(c)

    def flush(self) -> None:
        """Ids of members that end here come in ascending order."""
        if self.ids:
            text = ",".join(map(str, self.ids)).encode()
            self.digest, first = (hashlib.sha256(), True) if self.digest is None else (self.digest, False)
            self.digest.update(text if first else b"," + text)
            self.ids = []


NODE = "conv_id long, depth int, parent long, parent_place int, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, hangs long"
PART = "place int, size long, n long, least long, children long, leaves long, saved long, first_id long, ids string, hangs long"
_NAMES = [x.split()[0] for x in f"{NODE}, {PART}".split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in f"{NODE}, {PART}".split(", ")]
_NAMES[len(NODE.split(", ")) :] = [f"s_{x}" for x in _NAMES[len(NODE.split(", ")) :]]
_SCHEMA = ", ".join(f"{n} {t.split()[1]}" for n, t in zip(_NAMES, f"{NODE}, {PART}".split(", ")))


def _scan(skeleton: dict[bytes, int]):
    """Rows shard, path, c, sizes, ends, x (sums of what hangs on the path's last node: hangs, children, leaves, saved), sorted
    by shard, path and c -> finished nodes, and parts of skeleton nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Open] = []
        hangs: dict[int, int] = {}
        path, shard = b"", None
        n_node, n_part = len(NODE.split(", ")), len(PART.split(", "))

        def part_of(v: _Open, depth: int, ids: list[int], sums: bool) -> None:
            text = ",".join(map(str, ids)) if ids else None
            own = (v.size, v.n, v.least, v.children, v.leaves, v.saved) if sums else (v.size, 0, None, 0, 0, 0)
            out.append((*[None] * n_node, v.place, *own, ids[0] if ids else None, text, hangs.pop(id(v), None) if sums else None))

        def close() -> None:
            v, depth = stack.pop(), len(stack)
            up = stack[-1] if stack else None
            if up is not None:
                up.join(v.n, v.least)
            if v.place is not None:
                part_of(v, depth, v.ids, True)
            else:
                v.flush()
                leaves = v.leaves if v.children else 1
                saved = v.saved + (v.n - 1) * v.size
                sha = (v.digest or hashlib.sha256()).hexdigest()
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
                row = (v.least, depth, None, None, v.n, v.children, leaves, saved, sha, hangs.pop(id(v), None), *[None] * n_part)
                if up.place is not None:
                    out.append((*row[:3], up.place, *row[4:]))
                else:
                    up.held.append(row)  # at most the nodes of one shard
            out.extend((*row[:2], v.least, *row[3:]) for row in v.held)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(_NAMES)
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES)], names=_NAMES)
            out.clear()
            return done

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                for row in whole_batch.slice(at, 2048).to_pylist():
                    p, same = row["path"], 0
                    if row["shard"] != shard:
                        while stack:
                            close()
                        path, shard = b"", row["shard"]
                        stack.append(_Open(skeleton[b""], 0))
                    while same < min(len(p), len(path)) and p[same : same + KEY] == path[same : same + KEY]:
                        same += KEY
                    while len(stack) > same // KEY + 1:
                        close()
                    for i in range(same // KEY, len(p) // KEY):
                        stack.append(_Open(skeleton.get(p[: (i + 1) * KEY]), row["sizes"][i]))
                    path, top = p, stack[-1]
                    if row["ends"]:
                        top.end(row["c"])
                        if len(top.ids) >= _CHUNK:
                            if top.place is None:
                                top.flush()
                            else:
                                part_of(top, len(stack) - 1, top.ids, False)
                                top.ids = []
                    else:
                        top.join(1, row["c"])
                    if row["x"] is not None:
                        x = row["x"]
                        top.children, top.leaves, top.saved = top.children + x["children"], top.leaves + x["leaves"], top.saved + x["saved"]
                        hangs[id(top)] = x["hangs"]
                yield batch()
        while stack:
            close()
        yield batch()
        tidy()

    return run


def _long_digests(ids: DataFrame) -> DataFrame:
    """``place``, ``first_id``, ``ids`` -> ``place``, ``sha``: chunks of a node follow each other through the hash, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([digest.hexdigest()])], names=["place", "sha"])

        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if place != current:
                    if digest is not None:
                        yield row()
                    current, digest = place, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
        if digest is not None:
            yield row()

    return ids.repartition("place").sortWithinPartitions("place", "first_id").mapInArrow(run, "place int, sha string")


def level_trie(rows: DataFrame, s: Shape) -> DataFrame:
    """``rows``: path, c, sizes, ends, x.  One row per node, by its depth in these paths: ``conv_id``, ``depth``, ``parent``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved``, ``ends_sha256``, ``hangs``."""
    session = rows.sparkSession
    n = s.shards or max(1, int(session.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(rows, n, s)
    skeleton = skeleton_of(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(splitters, k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    kind = "shard int, path binary, c long, sizes array<long>, ends boolean, x struct<hangs:long,children:long,leaves:long,saved:long>"
    dealt = rows.select("path", "c", "sizes", "ends", "x").mapInArrow(deal, kind)
    done = cut_lineage(dealt.repartition(n, "shard").sortWithinPartitions("shard", "path", "c").mapInArrow(_scan(skeleton), _SCHEMA))
    parts = done.filter("s_place is not null")
    sums = parts.groupBy("s_place").agg(F.max("s_size").alias("size"), *[F.sum(f"s_{x}").alias(x) for x in ("n", "children", "leaves", "saved")], F.min("s_least").alias("least"), F.max("s_hangs").alias("hangs"))
    own = {r["s_place"]: r.asDict() for r in sums.collect()}  # the skeleton: bounded by the splitters
    paths = sorted(skeleton, key=len, reverse=True)
    for p in paths:  # children first
        v = own.get(skeleton[p])
        if v is None:
            continue  # the root, when there are no rows
        v["depth"], v["leaves"] = len(p) // KEY, v["leaves"] if v["children"] else 1
        v["saved"] += (v["n"] - 1) * v["size"]
        if p:
            up = own[skeleton[p[:-KEY]]]
            v["parent"] = up["least"]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + v["leaves"], up["saved"] + v["saved"]
    kept = [(k, v["least"], v["depth"], v.get("parent"), v["n"], v["children"], v["leaves"], v["saved"], v["hangs"]) for k, v in own.items()]
    table = session.createDataFrame(kept, "place int, conv_id long, depth int, parent long, n_convs long, n_children long, n_leaves long, saved long, hangs long")
    digests = _long_digests(parts.filter("s_ids is not null").select(F.col("s_place").alias("place"), F.col("s_first_id").alias("first_id"), F.col("s_ids").alias("ids")))
    nodes = ["conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", "hangs"]
    upper = table.join(digests, "place", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))).select(*nodes)
    least = F.broadcast(table.select(F.col("place").alias("parent_place"), F.col("conv_id").alias("__up")))
    lower = done.filter("conv_id is not null").join(least, "parent_place", "left").withColumn("parent", F.coalesce("parent", "__up")).select(*nodes)
    return upper.unionByName(lower)


# --- the whole trie ----------------------------------------------------------------------------------------------

def conversation_trie(turns: DataFrame, s: Shape = Shape()) -> DataFrame:
    """One row per distinct sequence of first turns (role, text) of the rebuilt conversations, the empty one included:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns``: conv_id, turn, role, text; other columns are not read.  Turns are in the order of turn (null first), equal ones
    by role and a digest of role and text; a null role or text counts as empty; rows that repeat all four are turns of their own; rows without a
    conv_id belong to no conversation.  Turns are known by 128-bit digests.  No rows give no rows.  Jobs run when this is called.
    """
    convs, rebuilt = rebuilt_turns(numbered_turns(turns), s)
    table = segments(convs, rebuilt, s)
    top = table.agg(F.max("level")).first()[0]
    none = F.lit(None).cast("struct<hangs:long,children:long,leaves:long,saved:long>")
    nodes = {}
    if top is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    below = None
    for level in range(top, -1, -1):
        rows = table.filter(F.col("level") == level)
        if below is None:
            rows = rows.withColumn("x", none)
        else:
            rows = rows.join(below.withColumnRenamed("conv_id", "c"), "c", "left").withColumn("x", F.when(~F.col("ends"), F.col("x")))
        if level:  # under its root, as one more turn without text
            rows = rows.withColumns({"path": F.concat("root", "path"), "sizes": F.concat(F.array(F.lit(0).cast("long")), "sizes")})
        nodes[level] = cut_lineage(level_trie(rows, s))
        hanging = nodes[level].filter("depth = 1") if level else None
        below = hanging.select("conv_id", F.struct(F.col("conv_id").alias("hangs"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), "saved").alias("saved_x")).withColumnRenamed("saved_x", "x") if level else None
    out = None
    for level in range(top + 1):
        own = nodes[level].filter("depth > 1") if level else nodes[0]
        if level:
            roots = nodes[level - 1].filter("hangs is not null").select(F.col("hangs").alias("parent"), F.lit(2).alias("depth"), F.col("conv_id").alias("__up"))
            own = own.join(roots, ["parent", "depth"], "left").withColumn("parent", F.coalesce("__up", "parent"))
        depth: Column = F.col("depth").cast("long") + (level * s.segment - 1 if level else 0)
        own = own.select("conv_id", depth.alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
        out = own if out is None else out.unionByName(own)
    return out
