"""More cases of the third review."""

import math

from pyspark.sql import functions as F

from terrafield.operators import graph, terrain
from terrafield.session import recorded_tables

DEM = "z int, x long, y long, width int, data array<double>"


def hills(x, y, width):
    return [None if (x * 7 + y * 3 + i) % 23 == 0 else 300 * math.sin(x + i / 5) + 200 * math.cos(y * 2 + i / 3) + 900 for i in range(width * width)]


def lands(spark, lng, lat, z=12, reach=5, width=lambda x, y: 6):
    n = 1 << z
    cx, cy = int((lng + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    at = [((cx + i) % n, cy + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j) % 7 or not (i or j)]
    return spark.createDataFrame([(z, x, y, width(x, y), hills(x, y, width(x, y))) for x, y in at], DEM)


def test_viewsheds_are_swept_where_tiles_lie_side_by_side(spark, monkeypatch):
    """No ray leaves a task but close to a pole; both ways, and tiles of several widths, give the plain result."""
    dem = lands(spark, -121.5, 44.2, width=lambda x, y: 4 + (x + y) % 3)
    obs = spark.createDataFrame([(i, -121.5 + i * 0.004, 44.2 + i % 3 * 0.007) for i in range(9)], "o int, lng double, lat double")
    rows = lambda df: sorted(tuple(r) for r in df.select("o", "ray", "step", F.round("lng", 9), F.round("lat", 9)).collect())
    rays, step = 36, 150.0
    samples = terrain.viewshed_samples(obs, dem, "o", 5, rays, step)
    want = rows(terrain.sweep(samples, "o").where("visible"))
    seen = terrain.viewshed(obs, dem, "o", 5, rays, step)
    assert rows(seen) == want and len(want) > 100
    near, far = terrain._near_and_far(obs, dem, "o", 54, step, 12)
    assert near.count() == 9 and far.count() == 0
    sights = terrain._sights(near, dem, "o", 54, rays, step, 12, True)
    assert sights.count() == 9  # a row per observer, where a row per ray and tile was shuffled
    cover = lambda: sorted(tuple(r) for r in terrain.viewshed_coverage(obs, dem, "o", 5, rays, step).collect())
    report = sorted(tuple(r) for r in terrain.coverage_report(samples, "o").collect())
    assert cover() == report
    monkeypatch.setattr(terrain, "MOSAIC_TILES", 1)
    assert rows(terrain.viewshed(obs, dem, "o", 5, rays, step)) == want and cover() == report


def test_rounds_of_a_long_way_do_not_count_small_blocks(spark):
    """A road of 30 small blocks, with a dear shortcut and a dead end, is settled in a few rounds; a given side gives the same costs."""
    nodes = spark.range(301).select(F.col("id").alias("node_id"), (F.col("id") * 0.01 - 121.5).alias("lng"), F.lit(44.0).alias("lat"))
    a = F.col("id")
    e = spark.range(300).select(F.explode(F.array(F.struct(a.alias("src"), (a + 1).alias("dst")), F.struct((a + 1).alias("src"), a.alias("dst")))).alias("d"))
    e = e.select("d.*", F.when(F.col("d.src") % 7 == 0, 1000.0).otherwise(900.0).alias("cost"))
    e = e.unionByName(spark.createDataFrame([(10, 200, 190 * 950.0)], "src long, dst long, cost double"))
    none = F.lit(None).cast("string")
    e = e.select("src", "dst", "cost", F.col("cost").alias("meters"), F.lit(1).cast("bigint").alias("seg_id"), none.alias("name"), none.alias("kind"))
    od = spark.createDataFrame([(1, 0, 300), (2, 300, 0), (3, 12, 17), (4, 5, 5)], "od_id long, start long, goal long")
    cost = lambda s, g: sum(1000.0 if (i if s < g else i + 1) % 7 == 0 else 900.0 for i in range(min(s, g), max(s, g)))
    want = {1: cost(0, 300), 2: cost(300, 0), 3: cost(12, 17), 4: 0.0}
    with recorded_tables() as made:
        got = graph.shortest_paths(od, nodes, e).collect()
    assert {r.od_id: r.cost for r in got} == want
    assert len(made) <= 8  # before: a table for each of 30 crossings
    near = graph.shortest_costs(od.where("od_id = 3"), nodes, e)
    assert near.count() <= 12  # labels that cannot beat the way to the goal stay out
