"""Cases of the third review."""

from pyspark.sql import functions as F

from terrafield.functions import geo
from terrafield.operators import places, quality, spatial
from terrafield.sources import tables


def test_only_time_zero_is_undated(spark):
    packs = spark.createDataFrame([(1, "A", 10, 0), (1, "B", 10, -500), (1, "C", 10, 1_699_990_000), (2, "D", 10, -1)],
                                  "device_id long, abbr string, bytes long, modified long")
    none = spark.createDataFrame([], "device_id long, kind string, backup_at long")
    d = quality.readiness(packs, none, none, 1_700_000_000)
    got = {(r.device_id, r.check): r.detail for r in d.where(F.col("check").startswith("Pack")).collect()}
    assert got == {(1, "Pack freshness"): "Oldest pack (C) downloaded today.", (1, "Pack age unknown"): "1 undated",
                   (2, "Pack freshness"): "Unknown."}


def test_nearest_town_meets_few_towns(spark):
    """Thousands of towns in reach of every place: a place meets a handful of each rank, and the best one is the brute-force one."""
    kinds = F.array(*[F.lit(k) for k in ("city", "town", "village", "hamlet", "lake")])
    p = spark.range(6000).select(
        F.col("id").alias("place_id"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < 4500, "locality").otherwise("poi").alias("kind"),
        F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("detail"),
        (F.rand(1) * 0.7 + F.when(F.col("id") >= 5990, 0.75).otherwise(0.0) - 121).alias("lng"), (F.rand(2) * 0.5 + 44).alias("lat")).localCheckpoint()
    towns = p.where("kind = 'locality' and detail <> 'lake'").select(
        F.col("place_id").alias("town_id"), F.col("name").alias("town"), spatial.lookup("detail", spatial.SETTLEMENT_RANK).alias("t_rank"),
        F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"))
    asked = p.where("kind = 'poi'").select("place_id", "lng", "lat")
    plain = spatial.within_radius(asked, towns, 40 * 1609.344).where("abs(t_lng - lng) <= 0.8 and abs(t_lat - lat) <= 0.6")
    want = spatial.nearest(plain, ["place_id"], [F.col("dist_m") / (1 + 2 * F.col("t_rank")), F.col("town_id")],
                           {"town_id": F.col("town_id"), "town": F.col("town"), "dist_m": F.col("dist_m")})
    assert sorted(tuple(r) for r in spatial.nearest_town(p).collect()) == sorted(tuple(r) for r in want.collect())
    pairs = spatial.near_by_density(asked.where("place_id < 5990"), towns, 1, 40 * 1609.344, finest_m=1000.0, box=spatial.TOWN_BOX_DEG, step=2.0)
    assert plain.where("place_id < 5990").count() > 1000 * 1490 and pairs.count() < 200 * 1490


def test_places_are_ranked_once_per_text_and_by_density(spark):
    """Ties of position, positions that are missing and copies of a text give the plain ranking."""
    names = F.array(*[F.lit(n) for n in ("Old Ring", "ring road", "spring", "Ringing", "bolt")])
    p = spark.range(3000).select(
        F.col("id").alias("place_id"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("name"),
        F.lit("poi").alias("kind"), F.lit("peak").alias("detail"), ((F.col("id") * 37) % 5000).alias("pop"),
        F.when(F.col("id") % 50 != 0, F.rand(3) * 7 - 124).alias("lng"), (F.rand(4) * 4 + 42).alias("lat")).localCheckpoint()
    asks = [(i, t, x, y) for i, (t, x, y) in enumerate(
        [("ring", -121.0, 44.0), ("ring", -123.9, 45.9), ("Old Ring", -120.0, 43.0), ("rin ", None, 44.0), ("bolt", -121.0, None), ("none", -121.0, 44.0), ("ring", 60.0, -44.0)])]
    q = spark.createDataFrame(asks, "query_id long, text string, lng double, lat double")
    got = {}
    for r in places.rank_places(q, p).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.place_id, r.score))
    d = q.withColumn("needle", F.lower(F.trim("text"))).withColumnsRenamed({"lng": "ql", "lat": "qa"}).join(p, F.instr(F.lower("name"), F.col("needle")) > 0)
    near = F.when(F.col("ql").isNull(), 0.0).otherwise(F.log10(geo.haversine("ql", "qa", "lng", "lat") / geo.METRES_PER_MILE + 1) * -8.0)
    score = places._position_score(F.lower("name"), F.col("needle"), 2, 1, 0) * 1e6 + F.when(F.col("pop") > 0, F.log10(F.col("pop") + 1.0)).otherwise(0.0) + near - F.length("name") * 0.01
    want = {}
    for r in d.withColumn("score", score).orderBy("query_id", F.desc("score"), "place_id").collect():
        if len(want.setdefault(r.query_id, [])) < 20:
            want[r.query_id].append((r.place_id, r.score))
    assert got == want
    t = p.where("name = 'Ringing'").select("place_id", F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"), F.log10(F.col("pop") + 1.0).alias("worth"))
    assert spatial.best_by_density(q.where("query_id < 2"), t, 5, 8.0).count() < 2 * 300


def test_pins_are_ranked_once_per_text(spark):
    """4,000 askers of one text over 4,000 matching pins: no table holds their product."""
    pins = spark.range(4000).select(F.col("id").alias("pin_id"), F.lit("household").alias("name"), F.lit(None).cast("string").alias("note"), F.col("id").alias("t"))
    q = spark.range(4000).select(F.col("id").alias("query_id"), F.lit(" Household").alias("text"))
    hays = pins.select("pin_id", F.col("name").alias("hay"))
    assert places._needle_hits(places._needles(q), hays, "pin_id").count() == 4000
    d = places.rank_pins(q, pins)
    assert d.count() == 32000 and sorted(r.pin_id for r in d.where("query_id = 7").collect()) == list(range(3992, 4000))


def test_equal_regions_meet_a_tile_or_a_place_once(spark):
    """Regions of equal extent ride as a list: every pair comes out, none is made by the join itself."""
    r = spark.range(300).select(F.col("id").alias("region_id"), (F.col("id") % 2 * 3.0 - 122).alias("west"), F.lit(43.0).alias("south"),
                                (F.col("id") % 2 * 3.0 - 121.5).alias("east"), F.lit(43.4).alias("north"))
    f = spark.range(50).select(F.col("id").alias("feature_id"), F.lit(12).alias("z"), F.lit(663).cast("bigint").alias("x"),
                               (F.lit(1500) + F.col("id") % 2 * 900).cast("bigint").alias("y"))
    got = tables.region_extract(f, r, 8, 14)
    assert sorted((x.region_id, x.feature_id) for x in got.collect()) == sorted((i, j) for i in range(0, 300, 2) for j in range(0, 50, 2))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the extract itself is not shuffled
    assert [x.region_id for x in tables.region_extract_errors(tables.region_tiles(f, r, 8, 14), r).orderBy("region_id").collect()] == list(range(1, 300, 2))
    p = spark.createDataFrame([(1, -122.0, 43.0), (2, -118.7, 43.2), (3, 0.0, 0.0)], "p int, lng double, lat double")
    pairs = spatial.points_in_boxes(p, r, 0.05)
    assert set(pairs.columns) == {"p", "lng", "lat", "region_id", "west", "south", "east", "north"}
    assert sorted((x.p, x.region_id) for x in pairs.collect()) == sorted((1 + i % 2, i) for i in range(300))
