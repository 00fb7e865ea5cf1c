"""Routes of pairs, each on its own corridor's roads, against plain Python."""

import heapq
import math
import random

import pytest

from terrafield.operators import graph

R = 6371000.0
SEGS = "z int, seg_id bigint, kind string, detail string, name string, ref string, oneway boolean, coords array<struct<lng:double,lat:double>>"
PAIRS = "od_id bigint, from struct<lng:double,lat:double>, to struct<lng:double,lat:double>"


def hav(a, b):
    s = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(s)))


def half_away(v):
    return int(math.copysign(math.floor(abs(v) * 1e6 + 0.5), v))


def key(p):
    return (half_away(p[0]) + 180_000_000) * 268_435_456 + half_away(p[1]) + 90_000_000


def plain_graph(segs, tol):
    """Nodes {id: (lng, lat)}, components {id: label} and edges {id: [(to, cost, metres, kind)]} with stitches."""
    at, mask, out, ends = {}, {}, {}, set()
    usable = sorted((s for s in segs if s[2] in graph.CLASS_COST and len(s[7]) >= 2), key=lambda s: s[1])
    for s in usable:
        for p in s[7]:
            at.setdefault(key(p), p)
            mask[key(p)] = mask.get(key(p), 0) | graph.NODE_MASK.get(s[2], 4)
        ends |= {key(s[7][0]), key(s[7][-1])}
    for s in usable:
        mult = graph.DETAIL_COST.get(s[3]) or graph.CLASS_COST[s[2]]
        for a, b in zip(map(key, s[7]), map(key, s[7][1:])):
            if a != b:
                m = hav(at[a], at[b])
                out.setdefault(a, []).append((b, m * mult, m, s[2]))
                if not s[6]:
                    out.setdefault(b, []).append((a, m * mult, m, s[2]))

    def labels():
        parent = {n: n for n in at}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, es in out.items():
            for b, *_ in es:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        return {n: root(n) for n in at}

    comp, links = labels(), {}
    for a in ends:
        near = []
        for b in at:
            m = hav(at[a], at[b])
            limit = max(tol, 250.0) if mask[a] & mask[b] & 1 else tol
            if comp[a] != comp[b] and m <= limit:
                near.append((m, b))
        for m, b in sorted(near)[:4]:
            links[min(a, b), max(a, b)] = m
    for (a, b), m in links.items():
        out.setdefault(a, []).append((b, m, m, None))
        out.setdefault(b, []).append((a, m, m, None))
    return at, labels(), out


def plain_route(pair, segs, tol, snap):
    at, comp, out = plain_graph(segs, tol)

    def side(p):
        near = sorted((hav(p, q), n) for n, q in at.items() if hav(p, q) <= snap)[:60]
        if not near:
            return {}
        slack = max(60.0 if near[0][0] <= 25 else 250.0, 4 * near[0][0])
        best = {}
        for d, n in near:
            if d <= min(snap, slack):
                best.setdefault(comp[n], (d, n))
        return best

    a, b = side(pair[1]), side(pair[2])
    both = sorted((a[c][0] + b[c][0], a[c], b[c]) for c in a if c in b)
    if not both or both[0][1][1] == both[0][2][1]:
        return None
    (df, start), (dt, goal) = both[0][1:]
    dist, heap = {start: (0.0, 0.0, False, 0)}, [(0.0, start)]
    while heap:
        c, n = heapq.heappop(heap)
        if c > dist[n][0]:
            continue
        for d, w, m, kind in out.get(n, ()):
            if c + w < dist.get(d, (math.inf,))[0]:
                dist[d] = (c + w, dist[n][1] + m, dist[n][2] or kind == "path", dist[n][3] + 1)
                heapq.heappush(heap, (c + w, d))
    return (*dist[goal][1:], df, dt) if goal in dist else None


def plain_fallback(pair, segs, zooms, max_tiles):
    (fl, fa), (tl, ta) = pair[1:]
    direct = hav(pair[1], pair[2])
    pad = min(max(3000.0, direct * 0.35), 15000.0)
    pl, pa = pad / (111320.0 * max(0.2, math.cos(math.radians((fa + ta) / 2)))), pad / 111320.0
    if abs(tl - fl) > 180:
        tl += 360 if tl < fl else -360
    plans = 0
    for z in zooms:
        n = 1 << z
        tx = lambda v: math.floor((v + 180) / 360 * n)
        ty = lambda v: math.floor((1 - math.log(math.tan(math.radians(v)) + 1 / math.cos(math.radians(v))) / math.pi) / 2 * n)
        x0, x1, y0, y1 = tx(min(fl, tl) - pl), tx(max(fl, tl) + pl), ty(max(fa, ta) + pa), ty(min(fa, ta) - pa)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > max_tiles:
            continue
        plans += 1
        own = [s for s in segs if s[0] == z and any((tx(p[0]) - x0) % n <= x1 - x0 and y0 <= ty(p[1]) <= y1 for p in s[7])]
        for factor in (1, 4):
            r = plain_route(pair, own, math.floor(25 * 2 ** (14 - z) + 0.5) * factor, 2000.0) if own else None
            if r:
                return "routed", z, factor != 1, r, direct
    return "no route" if plans else "too far", None, None, None, None


def world(rnd, lng, lat):
    """A jittered lattice, thinner at finer zooms, with gaps of several widths at its joints."""
    turn = lambda x: (x + 180) % 360 - 180
    spot = {(i, j): (turn(lng + i * 0.012 + rnd.uniform(-0.002, 0.002)), lat + j * 0.009 + rnd.uniform(-0.002, 0.002)) for i in range(10) for j in range(10)}
    segs, n = [], 0
    for (i, j), a in spot.items():
        for other in ((i + 1, j), (i, j + 1)):
            if other in spot and rnd.random() < 0.8:
                b = spot[other]
                gap = rnd.choice([0.0, 0.0, 0.0, 0.0002, 0.0009, 0.003])
                mid = ((a[0] if abs(a[0] - b[0]) < 1 else b[0]), b[1])
                line = [a, mid, (turn(b[0] + gap), b[1])]
                kind = rnd.choice(["major_road", "minor_road", "minor_road", "path", "rail"])
                row = (n, kind, rnd.choice(["track", "residential", None]), f"r{n % 5}", None, rnd.random() < 0.2, line)
                n += 1
                segs += [(z, *row) for z in (14, 13, 12, 11, 10) if rnd.random() < {14: 0.35, 13: 0.5, 12: 0.7, 11: 0.9, 10: 1.0}[z]]
    return segs, spot


def test_fallback_on_corridors_equals_brute_force(spark):
    rnd, zooms = random.Random(7), [14, 12, 10]
    segs, spot = world(rnd, 179.95, 44.0)  # across the antimeridian
    near = lambda: (lambda p: (((p[0] + rnd.uniform(-0.002, 0.002) + 180) % 360) - 180, p[1] + rnd.uniform(-0.002, 0.002)))(rnd.choice(list(spot.values())))
    pairs = [(i, near(), near()) for i in range(14)] + [(20, near(), (10.0, 10.0)), (21, (60.0, 10.0), (60.01, 10.0)), (22, near(), near())]
    pairs[-1] = (22, pairs[0][1], pairs[0][2])  # the same corridor twice
    got = graph.route_with_fallback(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(segs, SEGS), zooms, block_deg=0.03, pairs_per_task=3)
    got = {r.od_id: r for r in got.collect()}
    levels = set()
    for p in pairs:
        status, z, approx, r, direct = plain_fallback(p, segs, zooms, graph.MAX_TILES)
        row = got[p[0]]
        assert (row.status, row.z, row.approx) == (status, z, approx), p
        levels.add(z)
        if r:
            assert (row.meters, row.used_trail, row.hops, row.snapped_from_m, row.snapped_to_m, row.direct_m) == (pytest.approx(r[0]), r[1], r[2], pytest.approx(r[3]), pytest.approx(r[4]), pytest.approx(direct))
    assert len(got) == len(pairs) and len(levels - {None}) >= 2


def test_routes_over_one_graph_equal_brute_force(spark):
    rnd = random.Random(3)
    segs, spot = world(rnd, -121.5, 44.0)
    own = [s for s in segs if s[0] == 11]
    pairs = [(i, *(tuple(v + rnd.uniform(-0.001, 0.001) for v in rnd.choice(list(spot.values()))) for _ in range(2))) for i in range(12)]
    routes, path = graph.route(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(own, SEGS).drop("z"), 100.0, 1000.0, block_deg=0.03)
    got = {r.od_id: r for r in routes.collect()}
    assert len(got) > 5
    for p in pairs:
        r = plain_route(p, own, 100.0, 1000.0)
        assert (r is not None) == (p[0] in got)
        if r:
            row = got[p[0]]
            assert (row.meters, row.used_trail, row.hops, row.snapped_from_m, row.snapped_to_m) == (pytest.approx(r[0]), r[1], r[2], pytest.approx(r[3]), pytest.approx(r[4]))
    for r in path.groupBy("od_id").agg({"hop": "max", "node": "count"}).collect():
        assert r["count(node)"] == r["max(hop)"] + 1
