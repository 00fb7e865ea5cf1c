"""Findings of round 3, fourth part."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafield.operators import places, runs, sequences, spatial


def miles(a, b, c, d):
    s = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(s)))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_water_of_every_name_equals_brute_force(spark):
    """nearest of every name, by brute force, at the antimeridian and near a pole too; one row a point and name leaves the search."""
    rnd = random.Random(3)
    centres = [(-121.3, 44.0), (179.99, 10.0), (20.0, 89.5)]
    near = lambda s: [((x + rnd.gauss(0, s) / max(0.02, math.cos(math.radians(y))) + 180) % 360 - 180, min(90.0, y + rnd.gauss(0, s))) for x, y in centres]
    water = [(i * 3 + k, f"w{rnd.randint(0, 3)}", rnd.choice(["lake", "river"]), *p) for i in range(40) for k, p in enumerate(near(1.5))]
    water += [(900 + i, "w0", "lake", -121.3, 44.2) for i in range(3)] + [(990, "w1", "lake", None, 1.0)]
    points = [(i * 3 + k, *p) for i in range(12) for k, p in enumerate(near(1.0))] + [(500, None, 3.0)]
    points.append((501, *points[0][1:]))
    d = spatial.nearby_water(spark.createDataFrame(points, "p int, lng double, lat double"),
                             spark.createDataFrame(water, "water_id int, name string, kind string, t_lng double, t_lat double"), "p")
    assert "FlatMapCoGroupsInArrow" in executed(d)
    want = {}
    for p, x, y in points:
        for w, name, _, tx, ty in water:
            if x is not None and tx is not None and miles(x, y, tx, ty) <= 80:
                want[p, name] = min(want.get((p, name), (1e9, 0)), (miles(x, y, tx, ty), w))
    got = {(r.p, r.name): (r.dist_mi, r.water_id) for r in d.collect()}
    assert {k: w for k, (_, w) in got.items()} == {k: w for k, (_, w) in want.items()} and len(want) > 60
    assert [got[k][0] for k in want] == pytest.approx([m for m, _ in want.values()], abs=1e-6)


def test_cell_without_water():
    p = pa.table({"lng": [1.0], "lat": [2.0], "_cell": [1]})
    w = pa.table({"name": ["a"], "water_id": [1], "kind": ["lake"], "t_lng": [1.0], "t_lat": [2.0], "_cell": [1]})
    assert spatial._nearest_of_each_name(p, w.slice(0, 0), 80.0).num_rows == 0 == spatial._nearest_of_each_name(p.slice(0, 0), w, 80.0).num_rows


def test_regions_are_sorted_without_an_exchange_of_pairs(spark):
    """askers are dealt by range before they meet what their text finds; the pairs are not shuffled for the sort."""
    regions = spark.createDataFrame([(i, f"R{i}", f"Name {i % 7}") for i in range(200)], "ordinal int, abbr string, name string")
    packs = spark.createDataFrame([(f"R{i}", 100 - i % 5) for i in range(0, 200, 3)], "abbr string, modified bigint")
    texts = ["", "r1", "NAME 3", "zz", "e 5"]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "query_id int, text string")
    d = places.search_regions(asked, regions, packs)
    got = [(r.query_id, r.ordinal) for r in d.collect()]
    key = lambda i: (i % 3 > 0, -(100 - i % 5) if i % 3 == 0 else 0, i)
    hit = lambda t: sorted((i for i in range(200) if t.lower() in f"r{i}" or t.lower() in f"name {i % 7}"), key=key)
    assert got == [(q, i) for q in range(50) for i in hit(texts[q % 5])]
    plan = executed(d)
    assert plan.index("BroadcastHashJoin") < plan.index("rangepartitioning(query_id")


def test_short_runs_of_one_length_are_one_matrix(spark):
    """runs of one length are worked out together; keys of all lengths give what the plain fold gives."""
    assert [m.tolist() for m in runs._by_length(np.array([0, 1, 3, 4, 6]))] == [[[0], [3]], [[1, 2], [4, 5]]]
    rnd = random.Random(8)
    rows = [(k, i, rnd.randint(0, 90), rnd.randint(1, 9)) for k in range(120) for i in range(1 + k % 9)]
    want = {}
    for k, i, s, n in rows:
        b = want.setdefault(k, [])
        lo, hi, m = b[-1] if b else (s, s + n, 0)
        if b and max(s - hi, lo - (s + n)) <= 12 and max(hi, s + n) - min(lo, s) <= 40:
            b[-1] = (min(lo, s), max(hi, s + n), m + 1)
        else:
            b.append((s, s + n, 1))
    d = sequences.merge_intervals(spark.createDataFrame(rows, "k int, i long, start long, length long"), "k", "i", 12, 40, 3)
    got = {}
    for r in d.orderBy("k", "batch_no").collect():
        got.setdefault(r.k, []).append((r.start, r.start + r.length, r.members))
    assert got == want


def test_hits_of_one_needle_are_many_tasks(spark):
    """one needle with thousands of hits is not one task's work."""
    items = spark.range(5000).select("id", F.concat(F.lit("ring "), F.col("id").cast("string")).alias("hay"))
    items = items.unionByName(items.limit(100))
    d = places.substring_pairs(spark.createDataFrame([(1, "ring"), (2, "g 49")], "q int, needle string"), items, "q", "id")
    assert "_share" in executed(d)
    d = d.groupBy("q").count().collect()
    assert {r.q: r["count"] for r in d} == {1: 5000, 2: 111}


def test_points_are_dealt_before_they_are_listed(spark):
    """a small file of points is not listed under its levels in one task."""
    points = spark.range(50).select("id", (F.col("id") * 0.1).alias("lng"), (F.col("id") * 0.1).alias("lat"))
    boxes = spark.createDataFrame([(1, 0.95, 0.95, 2.05, 2.05), (2, 1.45, 0.0, 1.65, 9.0)], "box int, west double, south double, east double, north double")
    d = spatial.points_in_boxes(points, boxes)
    assert executed(d).split("RoundRobinPartitioning")[0].count("Generate explode") == 2  # levels and copies
    assert sorted((r.id, r.box) for r in d.collect()) == sorted([(i, 1) for i in range(10, 21)] + [(15, 2), (16, 2)])
