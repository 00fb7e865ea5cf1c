"""Ranked lexical search by exact inner products: sparse ball trees with centroid-radius bounds.

A document is a sparse vector of saturated term counts, an item one of term weights, a score their inner product.  Tasks
build ball trees over blocks of documents.  A ball has a centroid and, for each block of coordinates, the largest
distance of its documents from the centroid there; by Cauchy-Schwarz in every block

    score <= item . centroid + sum over blocks of |item in block| * radius in block

Subtrees are taken best bound first until the bound falls below the item's worst score so far; leaves are scored in
64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import cut_lineage
from .columns import tidy
from .pretokens import Fingerprints

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_TERM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_PRINTS = Fingerprints(seed=13)
#: Texts that a worker has in arrays at once.
BATCH = 256
#: Bounds are raised by this share and one, far above what double rounding can take from them.
SAFE = 1e-9


@dataclass(frozen=True)
class Search:
    """``k`` results an item.  Items are searched in passes of at most ``item_rows`` rows and about ``item_bytes`` of text, so
    that what is sent to the workers is bounded.  A tree has leaves of ``leaf`` documents, radii over ``radii`` blocks of
    coordinates, and as many documents as ``tree_bytes`` of centroids allow.  Candidates of ``salts`` groups of tasks are
    merged before those of all."""

    k: int = 20
    item_rows: int = 512
    item_bytes: int = 1 << 16
    leaf: int = 32
    radii: int = 1024
    tree_bytes: int = 1 << 24
    salts: int = 64


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Fingerprint and text number of every term, the lower-cased bytes, starts and ends."""
    data = b"".join(t.encode().translate(_LOWER) + b" " for t in texts)
    inside = _IN_TERM[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prints = _PRINTS.of(np.frombuffer(data, np.uint8), starts, ends)
    bounds = np.cumsum([len(t.encode()) + 1 for t in texts])
    return prints, np.searchsorted(bounds, starts, side="right"), data, starts, ends


def item_vectors(texts: list[str | None]) -> tuple[np.ndarray, list[dict[int, int]]]:
    """The sorted fingerprints of all terms, and per text how often it has each, by place among them."""
    prints, owner, *_ = _terms([t or "" for t in texts])
    vocabulary = np.unique(prints)
    counts = [Counter() for _ in texts]
    for i, t in zip(owner.tolist(), np.searchsorted(vocabulary, prints).tolist()):
        counts[i][t] += 1
    return vocabulary, [dict(c) for c in counts]


def count_terms(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row with a term: ``__id``, ``n`` (all its terms, with repeats), and ``terms`` and ``tf`` (array<int>) of the
    vocabulary's.  Terms are known by 64-bit fingerprints."""
    kind = docs.schema[id_col].dataType.simpleString()
    v = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                prints, owner, *_ = _terms([t or "" for t in batch.column(1).to_pylist()])
                n = np.bincount(owner, minlength=batch.num_rows)
                place = np.minimum(np.searchsorted(vocabulary, prints), v - 1)
                known = vocabulary[place] == prints
                pair, tf = np.unique(owner[known] * v + place[known], return_counts=True)
                size = np.bincount(pair // v, minlength=batch.num_rows)
                bounds = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(bounds, pa.array((pair % v).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                    names=["__id", "n", "terms", "tf"],
                )
                yield out.filter(pa.array(n > 0))
        tidy()

    return docs.select(id_col, text_col).mapInArrow(run, f"__id {kind}, n long, terms array<int>, tf array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_values(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated counts: ``tf`` of documents with ``n`` terms, as 64-bit integers."""
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class BallTree:
    """Documents in sparse rows: document i has ``values`` at ``terms`` from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, s: Search):
        self.width, self.s = width, s
        # blocks of coordinates: even runs of the vocabulary, which is in the order of fingerprints, so at random
        self.block_starts = np.unique(np.linspace(0, width, min(width, s.radii), endpoint=False).astype(np.int64))
        order = self._order(bounds, terms, values, len(bounds) - 1)
        self.docs = np.concatenate(order)
        size = (bounds[1:] - bounds[:-1])[self.docs]
        at = np.repeat(bounds[:-1][self.docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.bounds, self.terms, self.values = np.concatenate([[0], np.cumsum(size)]), terms[at], values[at]
        self.leaves = np.concatenate([[0], np.cumsum([len(own) for own in order])])
        self._measure(len(order))

    def _order(self, bounds, terms, values, n) -> list[np.ndarray]:
        """Leaves from left to right.  Nodes are halved along the line between two documents far apart, in a random
        projection: which documents meet in a ball decides how tight it is, never what is found."""
        rng = np.random.default_rng(1)
        axes = rng.standard_normal((self.width, 12)).astype(np.float32)
        flat = np.zeros((n, 12), np.float32)
        owner = np.repeat(np.arange(n), bounds[1:] - bounds[:-1])
        for d in range(12):
            flat[:, d] = np.bincount(owner, weights=axes[terms, d] * values, minlength=n)
        level = [np.arange(n)]
        while max(map(len, level)) > self.s.leaf:
            below = []
            for own in level:
                x = flat[own]
                a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
                b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
                cut = len(own) // 2
                halves = own[np.argpartition(x @ (b - a), cut)] if len(own) > 1 else own
                below += [halves[:cut], halves[cut:]]
            level = below
        return level

    def _measure(self, n_leaves: int) -> None:
        """Centroids and radii, children first; node 1 is the root, leaf i is node ``n_leaves + i``."""
        self.n_leaves = n_leaves
        self.centre = np.zeros((2 * n_leaves, self.width))
        self.radius = np.zeros((2 * n_leaves, len(self.block_starts)))
        for i in range(n_leaves):
            lo, hi = self.leaves[i], self.leaves[i + 1]
            if lo == hi:
                continue
            s, e = self.bounds[lo], self.bounds[hi]
            dense = np.zeros((hi - lo, self.width))
            dense[np.repeat(np.arange(hi - lo), self.bounds[lo + 1 : hi + 1] - self.bounds[lo:hi]), self.terms[s:e]] = self.values[s:e]
            node = n_leaves + i
            self.centre[node] = dense.mean(axis=0)
            dense -= self.centre[node]
            np.square(dense, out=dense)
            self.radius[node] = np.sqrt(np.add.reduceat(dense, self.block_starts, axis=1)).max(axis=0) * (1 + SAFE) + 1e-3
        for node in range(n_leaves - 1, 0, -1):
            kids = self.centre[2 * node : 2 * node + 2]
            self.centre[node] = kids.mean(axis=0)
            away = np.sqrt(np.add.reduceat((kids - self.centre[node]) ** 2, self.block_starts, axis=1))
            self.radius[node] = (self.radius[2 * node : 2 * node + 2] + away).max(axis=0) * (1 + SAFE) + 1e-3

    def bounds_for(self, items: np.ndarray) -> np.ndarray:
        """Upper bounds of every item (row of weights) in every node."""
        spread = np.sqrt(np.add.reduceat(items * items, self.block_starts, axis=1))
        return (items @ self.centre.T + spread @ self.radius.T) * (1 + SAFE) + 1

    def scores(self, leaf: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of a leaf's documents that have a term, and which documents they are."""
        lo, hi = self.leaves[leaf], self.leaves[leaf + 1]
        s, e = self.bounds[lo], self.bounds[hi]
        return np.add.reduceat(weights[self.terms[s:e]] * self.values[s:e], self.bounds[lo:hi] - s), self.docs[lo:hi]


class Best:
    """The ``k`` best documents of an item: highest score, then lowest id (null last), then first row."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this can't enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, doc_id, row: int) -> None:
        insort(self.rows, (-score, doc_id is None, 0 if doc_id is None else doc_id, row))
        del self.rows[self.k :]


def search_tree(tree: BallTree, ids: list, first_row: int, items: np.ndarray, best: list[Best]) -> int:
    """Best-first search for all items; gives the number of leaves that were scored."""
    upper, opened = tree.bounds_for(items.astype(np.float64)), 0
    for bound, weights, own in zip(upper, items, best):
        heap = [(-bound[1], 1)]
        while heap:
            high, node = heapq.heappop(heap)
            if -high < own.least:
                break
            if node < tree.n_leaves:
                for kid in (2 * node, 2 * node + 1):
                    if bound[kid] >= own.least:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            leaf = node - tree.n_leaves
            if tree.leaves[leaf] == tree.leaves[leaf + 1]:
                continue
            opened += 1
            scores, docs = tree.scores(leaf, weights)
            for i in np.flatnonzero(scores >= own.least).tolist():
                if scores[i] >= own.least:
                    own.offer(int(scores[i]), ids[docs[i]], first_row + int(docs[i]))
    return opened


def _search(table: DataFrame, weights: list[dict[int, int]], width: int, n_docs: int, n_terms: int, s: Search) -> DataFrame:
    """``q`` (place in ``weights``), ``doc``, ``row``, ``score`` and ``task``: each task's best documents of every item."""
    kind = table.schema["__id"].dataType.simpleString()
    size = max(s.leaf, s.tree_bytes // (16 * width) * s.leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, n_held, row = [Best(s.k) for _ in weights], [], 0, 0
        items = np.zeros((len(weights), width), np.int64)
        for q, own in enumerate(weights):
            items[q, list(own)] = list(own.values())

        def close() -> None:
            nonlocal held, n_held, row
            block = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, block.num_rows, size):
                part = block.slice(at, size).combine_chunks().to_batches()[0]
                terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(part.column(2).value_lengths().to_numpy())]).astype(np.int64)
                values = term_values(tf, np.repeat(part.column(1).to_numpy(), bounds[1:] - bounds[:-1]), n_docs, n_terms)
                search_tree(BallTree(bounds, terms, values, width, s), part.column(0).to_pylist(), row, items, best)
                row += part.num_rows
            held, n_held = [], 0

        for batch in batches:
            held.append(batch)
            n_held += batch.num_rows
            if n_held >= size:
                close()
        if held:
            close()
        found = [(q, d if not no else None, r, -score) for q, b in enumerate(best) for score, no, d, r in b.rows]
        tidy()
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], table_type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["q", "doc", "row", "score"]
        )

    table_type = to_arrow_type(table.schema["__id"].dataType)
    rows = table.filter(F.size("terms") > 0).mapInArrow(run, f"q int, doc {kind}, row long, score long")
    return rows.withColumn("task", F.spark_partition_id())


def _item_blocks(items: DataFrame, s: Search) -> tuple[DataFrame, int]:
    """Written: the items with a row number ``__q`` and the pass ``__pass`` in which each is searched; and the passes."""
    size = F.length(F.encode(F.coalesce("__text", F.lit("")), "UTF-8")) + 1
    rows = cut_lineage(items.withColumns({"__q": F.monotonically_increasing_id(), "__bytes": size}))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    passes = max(1, -(-n // (s.item_rows // 2)), -(-total // (s.item_bytes // 2)))
    return rows.withColumn("__pass", F.pmod(F.xxhash64("__q"), F.lit(passes)) if passes > 1 else F.lit(0)), passes


def rank_documents(docs: DataFrame, items: DataFrame, s: Search = Search(), id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per row of ``items`` its at most ``k`` best rows of ``docs``: ``<item_col>``, ``rank`` (int, from 1), ``<id_col>``, ``score``.

    A score adds, over the item's terms (repeats included), weight times saturated count in the document; only scores
    above 0 are given, highest first, equal ones by ascending id (nulls last, then rows as read).  Null texts have no
    terms.  Rows that repeat an id or a text are documents, and items, of their own.  Without documents or terms there
    are no rows; other columns are not read.  Jobs run when this is called.
    """
    session = docs.sparkSession
    asked, passes = _item_blocks(items.select(F.col(item_col).alias("__item"), F.col(text_col).alias("__text")), s)
    found = []
    for number in range(passes):
        block = asked.filter(F.col("__pass") == number).select("__q", "__text").collect()  # bounded by ``Search``
        vocabulary, counts = item_vectors([r["__text"] for r in block])
        if not len(vocabulary):
            continue
        table = cut_lineage(count_terms(docs, vocabulary, id_col, text_col))
        n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = {r["t"]: r["c"] for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()}  # the vocabulary's size at most
        weights = [{t: c * term_weight(n_docs, df.get(t, 0)) for t, c in own.items()} for own in counts]
        names = session.createDataFrame([(i, r["__q"]) for i, r in enumerate(block)], "q int, __q long")
        found.append(_search(table, weights, len(vocabulary), n_docs, n_terms, s).join(F.broadcast(names), "q").drop("q"))
    if not found:
        return session.createDataFrame([], f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("task"), F.col("row")]
    salt = F.pmod(F.col("task"), F.lit(s.salts))
    few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__q", salt).orderBy(*order))).filter(F.col("__r") <= s.k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy(*order))).filter(F.col("rank") <= s.k)
    return ranked.join(asked.select("__q", "__item"), "__q").select(F.col("__item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
