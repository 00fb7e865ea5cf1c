"""Polygon index and viewsheds over tiles against plain counterparts."""

import math
import random

import pytest

from terrafield.operators import polygons, spatial, terrain

RINGS = "array<array<struct<lng:double,lat:double>>>"


def odd(ring, x, y):
    inside = False
    for i in range(len(ring)):
        (ax, ay), (bx, by) = ring[i], ring[i - 1]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def holds(rings, x, y):
    return odd(rings[0], x, y) and not any(odd(h, x, y) for h in rings[1:])


def star(rnd, x, y, r, n, jag=0.5):
    return [(x + r * (1 - jag * rnd.random()) * math.cos(2 * math.pi * i / n), y + r * (1 - jag * rnd.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def scribble(rnd, x, y, r, n):
    return [(x + r * rnd.uniform(-1, 1), y + r * rnd.uniform(-1, 1)) for _ in range(n)]


def steps(x, y, w, n):
    """A staircase whose corners lie on cell borders of many levels, closed explicitly."""
    top = [(x + w * i / n, y + w * (i // 2 * 2) / n) for i in range(n + 1)]
    return [*top, (x + w, y), (x, y), top[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    areas = [
        (1, [star(rnd, -121, 44, 1.3, 900), star(rnd, -121, 44, 0.3, 80), star(rnd, -120.8, 44.2, 0.25, 40), star(rnd, -119, 44, 0.4, 50)]),  # overlapping holes, one outside
        (2, [scribble(rnd, -121, 44, 0.8, 120)]),  # crosses itself
        (3, [steps(-121.5, 43.59375, 1.40625, 64), steps(-121.25, 43.8, 0.3, 8)]),
        (4, [star(rnd, -121, 44, 0.02, 5)]), (4, [star(rnd, -120.9, 44, 0.02, 50)]), (5, []), (6, None), (7, [[]]), (8, [[(-121.0, 44.0)] * 40]),
        (9, [star(rnd, 10, 10, 9, 400, 0.9)]), (9, [star(rnd, 10, 10, 9, 400, 0.9)]),
    ]
    pts = [(rnd.uniform(-122.4, -119.6), rnd.uniform(42.6, 45.4)) for _ in range(1500)] + [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(500)]
    pts += [p for _, rs in areas if rs for r in rs for p in r[:40]]  # on the vertices themselves
    pts += [(-121.5 + 1.40625 * i / 64, 43.59375 + 1.40625 * j / 64) for i in range(0, 65, 4) for j in range(0, 65, 4)]  # on cell borders
    a = spark.createDataFrame([(i, "clash", rs) for i, rs in areas], f"area_id int, pid string, rings {RINGS}")
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)] + [(-1, None, 44.0), (-2, -121.0, None)], "point int, lng double, lat double")
    got = sorted((r.point, r.area_id) for r in spatial.points_in_areas(p, a).collect())
    want = sorted((i, k) for i, (x, y) in enumerate(pts) for k, rs in areas if rs and rs[0] and holds(rs, x, y))
    assert got == want and len(got) > 1000


def test_index_of_a_very_long_ring(spark):
    rnd = random.Random(5)
    rings = [star(rnd, -121, 44, 1.0, 100_000, 0.1), star(rnd, -121, 44, 0.4, 20_000, 0.1)]
    a = spark.createDataFrame([(1, rings)], f"area_id int, rings {RINGS}")
    index = polygons.polygon_index(a)
    assert "rings" not in index.columns
    most = index.selectExpr("max(aggregate(_rings, 0, (n, r) -> n + size(r.edges))) as most", "count(*) as n", "count_if(forall(_rings, r -> size(r.edges) = 0)) as inside").first()
    assert most.most < 2500 and most.inside > most.n // 3  # of 120,000 edges
    pts = [(rnd.uniform(-122.1, -119.9), rnd.uniform(42.9, 45.1)) for _ in range(60)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "point int, lng double, lat double")
    assert sorted(r.point for r in polygons.points_in_index(p, index).collect()) == [i for i, (x, y) in enumerate(pts) if holds(rings, x, y)]
    assert polygons.points_in_index(p, polygons.polygon_index(a.where("false"))).count() == 0


# --- viewsheds ---------------------------------------------------------------------------------------------------

def hills(x, y, width):
    return [None if (x * 7 + y * 3 + i) % 23 == 0 else 300 * math.sin(x + i / 5) + 200 * math.cos(y * 2 + i / 3) + 900 for i in range(width * width)]


@pytest.mark.parametrize("lng, lat, z, miles", [(-121.5, 44.2, 12, 5), (179.99, -3.0, 12, 5), (20.0, 84.9, 9, 15), (-121.5, 44.2, 12, 30), (0.001, 0.001, 4, 30)])
def test_viewshed_over_tiles_equals_sweep(spark, lng, lat, z, miles):
    n = 1 << z
    cx, cy = int((lng + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    tiles = [(z, (cx + i) % n, cy + j, 6, hills(cx + i, cy + j, 6)) for i in range(-4, 5) for j in range(-4, 5) if (i * i + j) % 7 and 0 <= cy + j < n]
    if not any(t[1] == cx and t[2] == cy for t in tiles):
        tiles.append((z, cx, cy, 6, hills(cx, cy, 6)))
    dem = spark.createDataFrame(tiles, "z int, x long, y long, width int, data array<double>")
    obs = spark.createDataFrame([(1, lng, lat), (2, lng - 0.003, lat + 0.001), (3, 100.0, -50.0)], "o int, lng double, lat double")
    rays, step = (24, 200.0) if miles == 30 else (36, 100.0)
    samples = terrain.sweep(terrain.viewshed_samples(obs, dem, "o", miles, rays, step, z), "o")
    want = sorted((r.o, r.ray, r.step) for r in samples.where("visible").collect())
    got = terrain.viewshed(obs, dem, "o", miles, rays, step, z).collect()
    assert sorted((r.o, r.ray, r.step) for r in got) == want and len(want) > 20
    report = lambda df: sorted(tuple(r) for r in df.select("o", "samples", "no_data_pct", "warn").collect())
    assert report(terrain.viewshed_coverage(obs, dem, "o", miles, rays, step, z)) == report(terrain.coverage_report(samples, "o", "ground_m"))
