"""More cases of the third review."""

from pyspark.sql import functions as F

from terrafield.functions import cells, geo
from terrafield.operators import graph, polygons, rules, spatial


def test_latitudes_beyond_a_pole_meet_few_cells(spark):
    """A lattice whose rows run on past 90 degrees: a circle touches a few cells there, and every pair is found."""
    at = spark.range(2400).select(
        F.col("id").alias("node_id"), F.lit(7).cast("bigint").alias("comp"), (F.col("id") % 8 * 0.004 - 121.5).alias("lng"),
        (F.floor(F.col("id") / 8) * 0.6 + 89.0 + F.col("id") % 3 * 0.002).alias("lat"))
    over = at.where("lat between 94 and 95").limit(2).select(F.size(cells.cells_around("lng", "lat", 0.009, 0.009)).alias("n"))
    assert over.agg(F.max("n")).first()[0] <= 20  # before: every cell from there back to the pole
    p = at.select(F.col("node_id").alias("od_id"), (F.col("lng") + 0.0011).alias("lng"), (F.col("lat") + 0.0007).alias("lat")).localCheckpoint()
    d = geo.haversine("lng", "lat", "t_lng", "t_lat", geo.EARTH_MEAN_M)
    t = at.select("node_id", F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"))
    pairs = p.join(t, F.abs(F.col("lat") - F.col("t_lat")) <= 1000 / 110000).withColumn("dist_m", d).where("dist_m <= 1000")
    want = sorted((r.od_id, r.node_id) for r in pairs.collect())
    assert sorted((r.od_id, r.node_id) for r in spatial.within_radius(p, t, 1000.0, geo.EARTH_MEAN_M).collect()) == want and len(want) > 5000
    best = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.dist_m, r.node_id)):
        best.setdefault(r.od_id, []).append(r.node_id)
    got = {}
    for r in graph.knn_nodes(p, at, "od_id", k=3).orderBy("od_id", "rank").collect():
        got.setdefault(r.od_id, []).append(r.node_id)
    assert got == {k: v[:3] for k, v in best.items()}


def test_rectangles_need_no_edges(spark):
    """Rectangles carry no ring into the join and few cells; other shapes and both kinds of corner agree with the plain count."""
    pt = lambda x, y: {"lng": float(x), "lat": float(y)}
    box = [pt(0, 0), pt(3, 0), pt(3, 2), pt(0, 2)]
    shapes = {1: [box + box[:1]], 2: [box[::-1]], 3: [[pt(0, 0), pt(3, 0), pt(1.5, 2)]], 4: [[pt(0, 0), pt(0, 2), pt(3, 0), pt(3, 2)]],
              5: [box, [pt(1, 0.5), pt(2, 0.5), pt(2, 1.5), pt(1, 1.5)]], 6: [[pt(0, 0), pt(3, 0), pt(3, 2), pt(1, 2), pt(1, 1), pt(0, 1)]],
              7: [[pt(0, 0), pt(1.5, 0), pt(3, 0), pt(3, 2), pt(0, 2)]], 8: [[pt(0, 0), pt(0, 2)]]}
    areas = spark.createDataFrame(list(shapes.items()), "area_id long, rings array<array<struct<lng:double,lat:double>>>")
    at = [(i, x / 4, y / 4) for i, (x, y) in enumerate((x, y) for x in range(-1, 14) for y in range(-1, 10))]
    p = spark.createDataFrame(at, "p long, lng double, lat double")
    index = polygons.polygon_index(areas)
    assert {r.area_id for r in index.where("_plain").collect()} == {1, 2, 7}
    assert index.where("_plain and size(_rings) > 0").count() == 0 and index.groupBy("area_id").count().agg(F.max("count")).first()[0] <= 25

    def inside(ring, x, y):
        odd = False
        for a, b in zip(ring, ring[-1:] + ring[:-1]):
            if (a["lat"] > y) != (b["lat"] > y) and x < (b["lng"] - a["lng"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]:
                odd = not odd
        return odd

    want = {(i, k) for i, x, y in at for k, (outer, *holes) in shapes.items() if inside(outer, x, y) and not any(inside(h, x, y) for h in holes)}
    assert {(r.p, r.area_id) for r in polygons.points_in_index(p, index).collect()} == want


def test_land_at_is_best_land_of_all_pairs(spark):
    """The lowest id of each class gives the answer of all pairs, and the pairs are not joined with what is known of an area."""
    info = spark.range(1, 49).select(
        F.col("id").alias("area_id"), F.lit("t").alias("title"), F.when(F.col("id") % 3 > 0, "n").otherwise("").alias("name"),
        F.when(F.col("id") % 5 == 0, "d").alias("designation"), F.when(F.col("id") % 7 == 0, "closed").otherwise("open").alias("access"))
    box = spark.range(1, 53).select(F.col("id").alias("area_id"), (F.col("id") % 12 * 0.1).alias("west"), F.lit(0.0).alias("south"),
                                    (F.col("id") % 12 * 0.1 + 0.15).alias("east"), F.lit(1.0).alias("north"))
    areas = box.withColumn("rings", spatial.box_ring())
    p = spark.range(60).select(F.col("id").alias("place_id"), (F.col("id") * 0.025).alias("lng"), F.lit(0.5).alias("lat"))
    pairs = spatial.points_in_areas(p, areas).select("place_id", "area_id")
    want = rules.best_land(pairs.join(info, "area_id"), "place_id")
    got = rules.land_at(p, areas, info, "place_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40
