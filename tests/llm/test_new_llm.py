"""Operators 11 to 13 of ``terrafield.llm`` against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrafield.llm import ball_tree, prefix_trie, queries, tournament_packing
from tools.compare_with_sql import compare


# --- packing by a tournament tree --------------------------------------------------------------------------------

def plain_first_fit(sizes, limit):
    gaps, bins = [], []
    for i, s in enumerate(sizes):
        b = next((b for b, g in enumerate(gaps) if g >= s), len(gaps))
        if b == len(gaps):
            gaps.append(limit)
            bins.append([])
        gaps[b] -= s
        bins[b].append(i)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_tree_is_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    assert tournament_packing.first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_group_packs_without_padding(lengths):
    sequences = tournament_packing.plan_group(lengths, 64)
    sizes = [sum(p[2] for p in s) for s in sequences]
    short = [s for s in sizes if s < 64]
    assert all(s & (s - 1) == 0 and 0 < s <= 64 for s in sizes) and len(set(short)) == len(short)
    got = defaultdict(list)
    for s in sequences:
        for d, start, n in s:
            got[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got[d]):
            assert start == at and k > 0
            at += k
        assert at == n


EDGES = [(1, "", "a"), (2, None, "b"), (3, "tie", "c"), (3, "tie", "c"), (None, "tie", None), (None, None, None), (4, "<|endoftext|> é 中", None), (5, " ".join(f"w{i % 700}" for i in range(30_000)), "d"), (-(2**63), " \n", "e")] + [(100 + i, "some words " * (i % 90), "x") for i in range(400)]


@pytest.mark.parametrize("group_docs", [50, 1024])
def test_pack_freely(spark, sf_dir, group_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    edges = spark.createDataFrame(EDGES, "doc_id long, text string, length string").repartition(3)
    for df in (edges, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        source = df.select("doc_id", "text").collect()
        rows = tournament_packing.pack_freely(df, path, group_docs=group_docs).collect()
        bins, docs = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.length
            bins[r.sequence_id].append((r.offset, r.length))
            docs[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0  # nothing is padded
        assert len(bins) <= sum(r.length for r in rows) // 2048 + 11 * (len(source) // group_docs + 1)
        want = defaultdict(list)
        for r, e in zip(source, library.encode_batch([r.text or "" for r in source], add_special_tokens=False)):
            want[r.doc_id, len(e.ids) + 1].append(np.array([*e.ids, 1], "<u4").tobytes())
        assert set(docs) == set(want)
        for key, pieces in docs.items():
            if len(want[key]) == 1:  # rows that repeat an id and a length can't be told apart
                assert b"".join(p[2] for p in sorted(pieces)) == want[key][0]
            assert sum(p[1] for p in pieces) == key[1] * len(want[key])
    digests = tournament_packing.pack_freely(edges, path, group_docs=group_docs, digest=True).collect()
    plain = tournament_packing.pack_freely(edges, path, group_docs=group_docs).collect()
    assert sorted(zlib.crc32(r.ids) for r in plain) == sorted(r.ids_crc32 for r in digests)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tournament_packing.pack_freely(empty, path).count() == 0


# --- ranked search by ball trees ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    nd, nt = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + 25 * n * nd // nt
            score = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def ranks(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("search", [ball_tree.Search(), ball_tree.Search(leaf=4, radii=7, tree_bytes=1 << 12, item_rows=20, item_bytes=4000, salts=2)])
def test_search_equals_brute_force(spark, sf_dir, search):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs += [(7000 - i, "copy of one page, Über ÜBER x1 x1") for i in range(60)] + [(None, "copy of one page x1"), (None, None), (8000, ""), (8001, "..."), (7000, "copy of one page, Über ÜBER x1 x1"), (8002, "naïve page " * 3000), (8003, "\x00nul\x7fdel_x")]
    items += [(1000, "page x1 x1 page Über"), (1001, None), (1002, ""), (1003, "nosuchterm"), (1000, "page x1"), (None, "NUL del naïve")]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    assert ranks(ball_tree.rank_documents(d, q, search)) == plain_ranks(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.rank_documents(docs.filter("false"), items).count() == 0
    assert ball_tree.rank_documents(docs, items.filter("false")).count() == 0
    assert ball_tree.rank_documents(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows, s = [], ball_tree.Search(leaf=8, radii=16)
    for topic in range(16):
        for _ in range(40):
            rows.append(np.unique(np.concatenate([rng.choice(np.arange(topic * 20, topic * 20 + 20), 8), rng.integers(0, 400, 3)])))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows)
    values = rng.integers(1, 1_000_000, len(flat))
    tree = ball_tree.BallTree(bounds, flat, values, 400, s)
    items = np.zeros((16, 400), np.int64)
    for q in range(16):
        items[q, q * 20 : q * 20 + 20] = rng.integers(0, 9000, 20)
    upper = tree.bounds_for(items.astype(float))
    for q in range(16):
        for leaf in range(tree.n_leaves):
            most, node = tree.scores(leaf, items[q])[0].max(), tree.n_leaves + leaf
            while node:
                assert upper[q, node] >= most
                node //= 2
    best = [ball_tree.Best(5) for _ in items]
    opened = ball_tree.search_tree(tree, list(range(len(rows))), 0, items, best)
    assert opened < 16 * tree.n_leaves // 2  # most leaves are never scored
    for q in range(16):
        every = sorted((-int((items[q, r] * values[bounds[i] : bounds[i + 1]]).sum()), i) for i, r in enumerate(rows))
        assert [(x[0], x[2]) for x in best[q].rows] == [x for x in every[:5] if x[0] < 0]


# --- prefix trie -------------------------------------------------------------------------------------------------

def plain_trie(rows, borrow=5, cycle=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role or "", key, text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % cycle
        rebuilt[c] = turns.get(c - int(math.fmod(c, borrow)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def nodes_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (1, x) for x in r))


def sort_nodes(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (1, x) for x in r))


ODD = [(None, 1, "user", "x"), (7, None, "user", "hi"), (7, None, None, None), (7, 3, "user", "hi"), (7, 3, "user", "hi"), (7, 1, "assistant", "é" * 9000), (-3, 1, "user", "hi"), (-1, None, None, None),
       (0, 0, "user", "first"), (0, 1, "assistant", "second"), (0, 2, "user", ""), (2, 0, None, "first"), (10**15, 5, "user", "first"), (23, 0, "user", "hi")]
HOT = [(100 + 5 * (i // 5) + i % 5, t, "user", "same") for i in range(300) for t in range(3)] + [(5000, t, "user", f"turn {t % 3}") for t in range(500)] + [(5001 + i, t, "user", f"turn {t % 3}") for i in range(3) for t in range(40 * i)]


@pytest.mark.parametrize("shape", [prefix_trie.Shape(), prefix_trie.Shape(segment=2, shards=5, sample=3), prefix_trie.Shape(segment=3, shards=40, sample=2), prefix_trie.Shape(shards=1)])
def test_trie_equals_brute_force(spark, sf_dir, shape):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    # every third conversation repeats another one's turns
    table += [(c + 100_000, t, r, x) for c, t, r, x in table if c % 3 == 0] + [(c + 200_000, t, r, x) for c, t, r, x in table if c % 4 == 0 and t < 3]
    for rows in (ODD, HOT if shape.segment > 3 else [r for r in HOT if r[0] < 5000 or r[1] < 21], table):
        df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth string, n_convs int, key int").repartition(4)
        assert nodes_of(prefix_trie.conversation_trie(df, shape)) == sort_nodes(plain_trie(rows))
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), shape).count() == 0


def test_chunks_of_ids_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 3)
    rows = [(i, 0, "user", "hello") for i in range(500)]
    got = nodes_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), prefix_trie.Shape(shards=7)))
    assert got == sort_nodes(plain_trie(rows))


@pytest.mark.parametrize("name", [n for n in ("op12_prefix_trie", "op13_ball_tree_search") if n in queries.QUERIES])
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    build, sql = queries.QUERIES[name]
    df = build(spark, sf_dir)
    cur = con.execute(sql)
    assert compare(name, [tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
