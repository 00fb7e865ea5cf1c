"""Operators on small literal inputs and against brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafield.functions import cells, geo, text
from terrafield.operators import geodesy, graph, ordered, paths, places, quality, rules, sequences, spatial, terrain

R = 6378137.0


def hav(a, b, r=R):
    (x1, y1), (x2, y2) = a, b
    s = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * r * math.asin(min(1, math.sqrt(s)))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- expressions ---

def test_null_coordinates_have_no_distance_or_direction(spark):
    n = F.lit(None).cast("double")
    r = one(spark, geo.haversine(n, n, F.lit(1.0), F.lit(2.0)).alias("d"), geo.cardinal(n).alias("c"))
    assert r.d is None and r.c is None


def test_cardinals(spark):
    got = [geo.cardinal(F.lit(float(d))) for d in (0, 11.25, 100, 348.75, 359, -90)]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(got)])) == ["N", "NNE", "E", "N", "N", "W"]


def test_hilbert_ids(spark):
    tiles = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)]
    d = spark.createDataFrame(tiles, "z int, x bigint, y bigint")
    assert [r[0] for r in d.select(cells.hilbert_tile_id("z", "x", "y")).collect()] == [0, 1, 2, 3, 4, 5]
    z5 = spark.range(32).withColumnRenamed("id", "x").crossJoin(spark.range(32).withColumnRenamed("id", "y"))
    ids = sorted(r[0] for r in z5.select(cells.hilbert_tile_id(F.lit(5), "x", "y")).collect())
    assert ids == list(range(341, 341 + 1024))


def test_title_case_and_dates(spark):
    names = ["CHINA HAT RD", "GIBSON CR. RD.", "B.P.A 12", "4600-471 SPUR", "c.g road"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in d.select(text.title_case("n")).collect()] == ["China Hat Rd", "Gibson Cr. Rd.", "B.P.A 12", "4600-471 Spur", "C.G Road"]
    raw = ["01/01-12/31", "06/01-10/15", "13/01-02/02", "by permit", None]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(raw)], "i int, n string").orderBy("i")
    assert [r[0] for r in d.select(rules.format_dates("n")).collect()] == ["year-round", "Jun 1 – Oct 15", "13/01-02/02", "by permit", ""]


def test_fold(spark):
    assert one(spark, text.fold(F.lit("Cañon ÉSPAÑOLA Ｘ")).alias("f")).f.startswith("canon espanola")


# --- ordered helpers: many chunks give what one window gives ---

@pytest.mark.parametrize("chunk", [3, 7])
def test_chunks_equal_a_window(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(k, s, rnd.choice([None, float(rnd.randint(0, 9))])) for k in (1, 2) for s in sorted(rnd.sample(range(60), 25))]
    d = spark.createDataFrame(rows, "k int, s bigint, v double")
    w = Window.partitionBy("k").orderBy("s")
    want = d.select("k", "s", F.lag("s").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("run"))
    got = ordered.with_neighbours(d, ["k"], "s", {"p": "s"}, {"n": "v"}, chunk)
    got = ordered.running_sum(got, ["k"], "s", "v", "run", chunk).select("k", "s", "p", "n", "run")
    assert sorted(got.collect()) == sorted(want.collect()) or {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    a = terrain.fill_gaps(d, "k", "s", "v", chunk).select("k", "s", F.round("filled", 9))
    b = terrain.fill_gaps(d, "k", "s", "v", ordered.BOUNDED).select("k", "s", F.round("filled", 9))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


# --- spatial joins ---

@pytest.mark.parametrize("where", ["plain", "antimeridian", "pole"])
def test_radius_join_equals_brute_force(spark, where):
    rnd = random.Random(5)
    lng = {"plain": lambda: rnd.uniform(-121, -120), "antimeridian": lambda: rnd.choice([179.6, -179.9]) + rnd.uniform(0, 0.3),
           "pole": lambda: rnd.uniform(-180, 180)}[where]
    lat = {"plain": lambda: rnd.uniform(44, 45), "antimeridian": lambda: rnd.uniform(-1, 1), "pole": lambda: rnd.uniform(89.2, 90)}[where]
    p, t = [(i, lng(), lat()) for i in range(60)], [(i, lng(), lat()) for i in range(60)]
    a = spark.createDataFrame(p, "id int, lng double, lat double")
    b = spark.createDataFrame(t, "tid int, t_lng double, t_lat double")
    got = {(r.id, r.tid) for r in spatial.within_radius(a, b, 20000.0).collect()}
    assert got == {(i, j) for i, x, y in p for j, u, v in t if hav((x, y), (u, v)) <= 20000.0}


def test_polygon_with_hole(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    areas = spark.createDataFrame([(1, "park", [sq(0.0, 10.0), sq(4.0, 6.0)])], "area_id int, kind string, rings array<array<struct<lng:double,lat:double>>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 9.9, 0.1)], "pid int, lng double, lat double")
    assert sorted(r.pid for r in spatial.points_in_areas(pts, areas).collect()) == [1, 4]


def test_gap_between_parts_is_not_matched(spark):
    parts = [[(-121.0, 44.0), (-121.0, 44.001)], [(-121.0, 44.01), (-121.0, 44.011)]]
    lines = spark.createDataFrame([(7, parts), (8, [[(-120.9, 44.0)]])], "line_id int, parts array<array<struct<lng:double,lat:double>>>")
    seg = spatial.line_segments(lines, "line_id")
    pts = spark.createDataFrame([(1, -121.0001, 44.0005), (2, -121.0001, 44.005), (3, -120.9, 44.0002)], "pid int, lng double, lat double")
    got = {r.pid: r.line_id for r in spatial.nearest_line_within(pts, seg, "pid", "line_id").collect()}
    assert got == {1: 7, 3: 8}


def test_copies_do_not_change_the_answer(spark):
    pts = spark.createDataFrame([(i, -121.0001, 44.0005) for i in range(300)], "pid int, lng double, lat double")
    seg = spark.createDataFrame([(100 - i, -121.0, 44.0, -121.0, 44.001, False) for i in range(90)], "line_id int, alng double, alat double, blng double, blat double, single boolean")
    got = spatial.nearest_line_within(pts, seg, "pid", "line_id").collect()
    assert len(got) == 300 and {r.line_id for r in got} == {11}


def test_runs_of_any_length(spark):
    rnd = random.Random(1)
    runs, at = [], 0
    for i in range(40):
        at += rnd.randint(0, 50)
        n = rnd.choice([1, 3, 70, 5000, 3_000_000])
        runs.append((i, at, n))
        at += n
    ids = [rnd.randrange(at) for _ in range(300)] + [r[1] for r in runs] + [r[1] + r[2] - 1 for r in runs]
    a = spark.createDataFrame([(i,) for i in ids], "id bigint").distinct()
    b = spark.createDataFrame(runs, "run_id int, start bigint, run_length bigint")
    got = {(r.id, r.run_id) for r in spatial.run_range_join(a, b).collect()}
    assert got == {(i, k) for i in set(ids) for k, s, n in runs if s <= i < s + n}


# --- paths and terrain ---

def test_resample_keeps_both_ends(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.001, 0.0), (1, 3, 0.002, 0.0), (2, 0, 5.0, 5.0)]
    d = spark.createDataFrame(rows, "p int, s bigint, lng double, lat double")
    got = sorted(paths.resample_every(d, "p", "s", 60.0).collect())
    first = [r for r in got if r.p == 1]
    assert (first[0].lng, first[-1].lng) == (0.0, 0.002) and len(first) == 2 + int(hav((0, 0), (0.002, 0)) // 60)
    assert [(r.lng, r.lat) for r in got if r.p == 2] == [(5.0, 5.0)]
    share = paths.sample_share(paths.resample_every(d, "p", "s"), "p").where("p = 1").agg(F.sum("share_m")).first()[0]
    assert share == pytest.approx(hav((0, 0), (0.002, 0)), rel=1e-9)


def test_climb_has_hysteresis(spark):
    feet = [100, 105, 111, 113, 108, 100, 90]
    d = spark.createDataFrame([(1, i, f / 3.28084) for i, f in enumerate(feet)], "k int, s bigint, filled double")
    r = terrain.profile_stats(d, "k", "s").first()
    assert (round(r.climb_ft, 6), round(r.descent_ft, 6), round(r.min_ft), round(r.max_ft)) == (13.0, 13.0, 90, 113)


def test_hill_hides_what_lies_behind(spark):
    ground = {1: 0.0, 2: 50.0, 3: 40.0, 4: None, 5: 400.0}
    d = spark.createDataFrame([(1, 0.0, 0, s, s * 50.0, g) for s, g in ground.items()], "o int, obs_m double, ray int, step int, d_m double, ground_m double")
    assert [r.visible for r in terrain.sweep(d, "o").orderBy("step").collect()] == [True, True, False, False, True]


def test_unwrapped_needle(spark):
    d = spark.createDataFrame([(1, i, float(h)) for i, h in enumerate([350, 10, 30, 350])], "k int, o bigint, heading double")
    got = [r.needle for r in paths.unwrap_heading(d, "k", "o").orderBy("o").collect()]
    assert got == [10.0, -10.0, -30.0, 10.0]


# --- places ---

def test_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice(["locality", "water", "road", "poi", "odd"]), rnd.choice(["lake", "river"]), rnd.choice([0, 0, 50]),
             rnd.uniform(-124, -117), rnd.uniform(42, 46)) for i in range(160)]
    d = spark.createDataFrame(rows, "place_id bigint, name string, kind string, detail string, pop bigint, lng double, lat double")
    got = {r.place_id for r in places.merge_duplicates(d.withColumn("folded", text.fold("name"))).collect()}
    rank = {"locality": 2, "water": 4, "poi": 5, "road": 8}
    reach = lambda p: (120 if p[2] == "road" else 60 if p[2] == "water" and p[3] == "river" else 10) * 1609.344
    want = set()
    for n in "ab":
        kept = []
        for p in sorted((r for r in rows if r[1] == n), key=lambda r: (rank.get(r[2], 9), -r[4], r[5], r[6], r[0])):
            far = max([reach(p)] + [reach(q) for q in kept])
            if all(hav((q[5], q[6]), (p[5], p[6])) >= far for q in kept):
                kept.append(p)
        want |= {p[0] for p in kept}
    assert got == want


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    items, needles = [(i, word(rnd.randint(0, 9))) for i in range(80)], [(i, word(rnd.randint(1, 5))) for i in range(30)]
    got = places.substring_pairs(spark.createDataFrame(needles, "q int, needle string"), spark.createDataFrame(items, "i int, hay string"), "q", "i")
    assert {(r.q, r.i) for r in got.collect()} == {(q, i) for q, n in needles for i, h in items if n in h}


def test_search_order_of_regions_and_nodes(spark):
    regions = spark.createDataFrame([(0, "AA", "Alpha"), (1, "BA", "Beta"), (2, "CA", "Gamma")], "ordinal int, abbr string, name string")
    packs = spark.createDataFrame([("AA", 5), ("CA", 9)], "abbr string, modified bigint")
    asked = spark.createDataFrame([(1, "a"), (2, "")], "query_id int, text string")
    got = [(r.query_id, r.abbr) for r in places.search_regions(asked, regions, packs).collect()]
    assert got == [(1, "CA"), (1, "AA"), (1, "BA"), (2, "CA"), (2, "AA"), (2, "BA")]
    nodes = spark.createDataFrame([(1, 1, None, None, 9), (2, 1, 1.0, 0.0, 1), (3, 1, 0.5, 0.0, 2), (4, 1, None, None, 10)], "num int, g int, lng double, lat double, last_heard int")
    viewer = spark.createDataFrame([(1, 0.0, 0.0)], "g int, lng double, lat double")
    assert [r.num for r in places.sort_nodes(nodes, viewer, "g").collect()] == [3, 2, 4, 1]


def test_name_labels(spark):
    rows = [("Clear Lake", "water", "water", "lake"), ("Lake Billy", "water", "water", "lake"), ("Mallard", "poi", "camp_site", "campground"),
            ("Tire Junction", "locality", "locality", "place"), ("Mt. Hood", "earth", "bare_rock", "peak"), ("Odd", "poi", "odd_thing", "odd thing")]
    d = spark.createDataFrame(rows, "name string, kind string, detail string, want string")
    for r in d.withColumn("got", rules.place_label("name", "kind", "detail")).collect():
        assert r.got == r.want


# --- intervals and geodesy ---

def test_intervals(spark):
    gap = sequences.MAX_GAP
    rows = [(1, 0, 0, 100), (1, 1, 1100, 100), (1, 2, gap + 5000, 100), (1, 3, gap + 4000, 2000), (2, 0, 500, 100), (2, 1, 0, 100)]
    d = spark.createDataFrame(rows, "k bigint, s bigint, start bigint, length bigint")
    got = [tuple(r) for r in sequences.merge_intervals(d, "k", "s").orderBy("k", "batch_no").collect()]
    assert got == [(1, 0, 0, 1200, 2), (1, 1, gap + 4000, 2000, 2), (2, 0, 0, 600, 2)]


def test_utm_round_trip(spark):
    pts = [(-121.31, 44.06), (151.2, -33.9), (-0.1, 51.5), (179.9, 0.5)]
    d = geodesy.utm_points(spark.createDataFrame(pts, "lng double, lat double"))
    lng, lat = geodesy.from_utm("easting", "northing", "zone", "north")
    for r in d.withColumn("a", lng).withColumn("b", lat).collect():
        assert r.a == pytest.approx(r.lng, abs=1e-6) and r.b == pytest.approx(r.lat, abs=1e-6)


def test_dipole_field(spark):
    coef = spark.createDataFrame([(1, 0, -30000.0, 0.0, 0.0, 0.0)], "n int, m int, g double, h double, gdot double, hdot double")
    pts = spark.createDataFrame([(0.0, 0.0, 0.0, 2026.0), (10.0, 45.0, 0.0, 2026.0), (0.0, 0.0, 0.0, 2031.0)], "lng double, lat double, alt_km double, year double")
    got = geodesy.field_model(pts, coef).orderBy("lat").collect()
    assert len(got) == 2  # outside the model's years there is no answer
    assert got[0].intensity == pytest.approx(30000 * (6371.2 / 6378.137) ** 3, rel=1e-9) and abs(got[0].inclination) < 1e-9
    assert math.tan(math.radians(got[1].inclination)) == pytest.approx(2.0, rel=0.02) and abs(got[1].declination) < 1e-9


# --- graph ---

def roads(spark, rnd, n):
    pt = lambda: (round(-121.5 + rnd.randrange(7) * 0.01, 6), round(44 + rnd.randrange(7) * 0.01, 6))
    rows = []
    for i in range(n):
        a = pt()
        b = (round(a[0] + rnd.choice([0.01, 0.0]), 6), round(a[1] + rnd.choice([0.01, 0.0]), 6))
        rows.append((i, rnd.choice(["major_road", "minor_road", "path", "rail"]), "residential", f"r{i % 5}", None, rnd.random() < 0.3, [a, b]))
    return spark.createDataFrame(rows, "seg_id bigint, kind string, detail string, name string, ref string, oneway boolean, coords array<struct<lng:double,lat:double>>")


def test_components_and_paths_equal_brute_force(spark):
    rnd = random.Random(11)
    nodes, edges = graph.build_graph(roads(spark, rnd, 60))
    nodes, edges = nodes.cache(), edges.cache()
    e = edges.collect()
    parent = {r.node_id: r.node_id for r in nodes.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in e:
        a, b = root(r.src), root(r.dst)
        parent[max(a, b)] = min(a, b)
    labelled = graph.components(nodes, edges).collect()
    assert {r.node_id: r.comp for r in labelled} == {n: root(n) for n in parent}

    ids = sorted(parent)
    pairs = [(i, rnd.choice(ids), rnd.choice(ids)) for i in range(12)]
    od = spark.createDataFrame([p for p in pairs if p[1] != p[2]], "od_id bigint, start bigint, goal bigint")
    costs = graph.shortest_costs(od, nodes, edges, block_deg=0.025, pairs_per_task=3)
    got = {r.od_id: r.cost for r in od.join(costs.select("od_id", F.col("node").alias("goal"), "cost"), ["od_id", "goal"]).collect()}
    out = {}
    for r in e:
        out.setdefault(r.src, []).append((r.dst, r.cost))
    want = {}
    for i, s, g in pairs:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            c, n = heapq.heappop(heap)
            if c > dist[n]:
                continue
            for d, w in out.get(n, ()):
                if c + w < dist.get(d, math.inf):
                    dist[d] = c + w
                    heapq.heappush(heap, (c + w, d))
        if s != g and g in dist:
            want[i] = dist[g]
    assert got == pytest.approx(want)
    # the traced edges add up to the cost
    mult = {(r.src, r.dst): r.cost for r in graph.cheapest_edges(edges).collect()}
    hops = graph.trace_paths(od, costs, edges).orderBy("od_id", "hop").collect()
    for i in want:
        seq = [r.node for r in hops if r.od_id == i]
        assert sum(mult[a, b] for a, b in zip(seq, seq[1:])) == pytest.approx(want[i])


# --- quality ---

def test_pairing_problems(spark):
    plants = spark.createDataFrame([(1, "A", "deadly", "t"), (2, "B", "edible-with-care", " "), (3, "C", "edible-with-care", "t")], "plant_no int, symbol string, verdict string, tell string")
    pairs = spark.createDataFrame([("A", "b"), ("A", "zz")], "symbol string, other string")
    got = {(r.symbol, r.problem, r.other) for r in quality.check_pairing(plants, pairs).collect()}
    assert got == {("B", "no tell", None), ("A", "dangling", "zz"), ("A", "one-way", "b"), ("B", "no lookalike", None), ("C", "no lookalike", None)}


def _small_net(spark, shift=0.0):
    """A straight way of two legs far apart and a cheap detour whose middle node lies outside the pair's box."""
    turn = lambda x: ((x + shift + 180.0) % 360.0) - 180.0
    at = {1: (10.0, 0.0), 2: (10.05, 0.0), 3: (10.1, 0.0), 4: (10.05, 0.25)}
    nodes = spark.createDataFrame([(i, turn(x), y) for i, (x, y) in at.items()], "node_id long, lng double, lat double")
    way = [(1, 2, 30_000.0), (2, 3, 30_000.0), (1, 4, 28_500.0), (4, 3, 28_500.0)]
    rows = [(a, b, c, c, 1, None, "minor_road") for u, v, c in way for a, b in ((u, v), (v, u))]
    edges = spark.createDataFrame(rows, "src long, dst long, cost double, meters double, seg_id long, name string, kind string")
    west = turn(9.9)
    od = spark.createDataFrame([(1, 1, 3, west, -0.2, west + 0.3, 0.2)], "od_id long, start long, goal long, west double, south double, east double, north double")
    return od, nodes, edges


def test_box_holds_whatever_the_blocks_and_across_the_antimeridian(spark):
    for shift in (0.0, 169.95):
        od, nodes, edges = _small_net(spark, shift)
        for block in (1.0, 0.1, 0.015):
            assert [r.cost for r in graph.shortest_paths(od, nodes, edges, block_deg=block).collect()] == [60_000.0]
        assert [r.cost for r in graph.shortest_paths(od.drop("west", "south", "east", "north"), nodes, edges).collect()] == [57_000.0]


def test_components_of_a_long_path(spark):
    n = 400
    nodes = spark.range(n).select(F.col("id").alias("node_id"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.components(nodes, edges).select("comp").distinct().count() == 1


def test_common_name_of_a_long_text(spark):
    plants = spark.createDataFrame([(1, "A", "fir, noble fir"), (2, "B", "oak")], "plant_no long, symbol string, common string")
    texts = spark.createDataFrame([(1, "noble fir" + " x" * 50_000), (2, "oa"), (3, "pine")], "text_id long, text string")
    assert {(r.text_id, r.symbol) for r in quality.match_common_name(texts, plants).collect()} == {(1, "A"), (2, "B")}
