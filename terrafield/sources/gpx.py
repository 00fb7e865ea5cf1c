"""GPX waypoints and tracks through the built-in XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text

_POINT = "struct<_lat:string,_lon:string,ele:string,time:string>"
WPT_SCHEMA = "_lat string, _lon string, name string, desc string, time string"
TRK_SCHEMA = f"name string, src string, number bigint, trkseg array<struct<trkpt:array<{_POINT}>>>, trkpt array<{_POINT}>"
RTE_SCHEMA = f"name string, rtept array<{_POINT}>"
POINTS_PER_ELEMENT = 100_000
#: What ``src`` of a piece of a long track begins with; its track follows, ``number`` is the piece's.
PIECE = "piece of "


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints; those with bad coordinates are skipped, nameless ones get a default name."""
    d = _read(spark, path, "wpt", WPT_SCHEMA).where(geo.valid_coord("_lon", "_lat"))
    return d.select(
        F.coalesce(text.blank_to_null("name"), F.lit("Imported waypoint")).alias("name"),
        F.col("_lon").cast("double").alias("lng"), F.col("_lat").cast("double").alias("lat"),
        text.blank_to_null("desc").alias("note"), F.col("time").try_cast("timestamp").alias("t"),
    )


def read_track_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all tracks and routes (track_id, name, seq, lng, lat, ele, t); tracks of one point are dropped.

    Each of several segments is a track of its own, named "name (i)"; the time of a track is that of the first
    point that has one.  Pieces of one track, as ``write_tracks`` makes them of a long one, are one track again.
    """
    trk = _read(spark, path, "trk", TRK_SCHEMA).withColumn("_el", F.concat(F.lit("trk"), F.monotonically_increasing_id().cast("string")))
    many = F.size("trkseg") > 1
    name = F.coalesce(text.blank_to_null("name"), F.lit("Imported track"))
    lone = F.array(F.coalesce(F.get("trkseg", F.lit(0))["trkpt"], F.col("trkpt")))
    segs = F.when(many, F.transform("trkseg", lambda s: s["trkpt"])).otherwise(lone)
    piece = F.when(F.col("src").startswith(PIECE), F.col("src"))
    t = trk.select("_el", name.alias("_n"), many.alias("_many"), piece.alias("_piece_of"), F.when(piece.isNotNull(), F.col("number")).alias("_part"), F.posexplode(segs).alias("_i", "pts")).select(
        "_piece_of", "_part",
        F.concat("_el", F.lit("/"), F.col("_i").cast("string")).alias("track_id"),
        F.when(F.col("_many"), F.concat("_n", F.lit(" ("), (F.col("_i") + 1).cast("string"), F.lit(")"))).otherwise(F.col("_n")).alias("name"),
        "pts",
    )
    rte = _read(spark, path, "rte", RTE_SCHEMA)
    r = rte.select(
        F.concat(F.lit("rte"), F.monotonically_increasing_id().cast("string")).alias("track_id"),
        F.coalesce(text.blank_to_null("name"), F.lit("Imported route")).alias("name"), F.col("rtept").alias("pts"),
    )
    ok = F.filter("pts", lambda p: geo.valid_coord(p["_lon"], p["_lat"]))
    d = t.unionByName(r, allowMissingColumns=True).withColumn("pts", ok)
    d = d.withColumn("track_id", F.coalesce("_piece_of", "track_id")).withColumn("_part", F.coalesce("_part", F.lit(0)))
    d = d.withColumn("_t", F.get(F.filter(F.transform("pts", lambda p: p["time"].try_cast("timestamp")), lambda x: x.isNotNull()), F.lit(0)))
    # a row per piece: points before it, points of its track, and the track's time
    pieces = Window.partitionBy("track_id")
    slim = d.select("track_id", "_part", F.size("pts").alias("_n"), "_t")
    before = F.coalesce(F.sum("_n").over(pieces.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = slim.select("track_id", "_part", before.alias("_before"), F.sum("_n").over(pieces).alias("_all"), F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_part"))).over(pieces).alias("t"))
    d = d.drop("_t").join(where.where("_all > 1"), ["track_id", "_part"])
    return d.select("track_id", "name", "t", "_before", F.posexplode("pts").alias("seq", "p")).select(
        "track_id", "name", (F.col("_before") + F.col("seq")).cast("bigint").alias("seq"), F.col("p._lon").cast("double").alias("lng"),
        F.col("p._lat").cast("double").alias("lat"), F.col("p.ele").try_cast("double").alias("ele"), "t",
    )


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_waypoints(waypoints: DataFrame, path: str) -> None:
    """Waypoints as GPX files, time before name."""
    d = waypoints.select(
        F.col("lat").alias("_lat"), F.col("lng").alias("_lon"), _iso("t").alias("time"), "name", F.nullif("note", F.lit("")).alias("desc")
    )
    d.write.mode("overwrite").format("xml").option("rootTag", "gpx").option("rowTag", "wpt").save(path)


def write_tracks(points: DataFrame, path: str) -> None:
    """Tracks (track_id, name, seq, lng, lat, ele, t) as GPX files; the time goes on the first point.

    A very long track is written as several elements with its id and their number, so no row holds more than a fixed
    number of points; ``read_track_points`` puts them together again.
    """
    pt = F.struct(
        F.col("seq"), F.col("lat").alias("_lat"), F.col("lng").alias("_lon"),
        F.when(F.col("seq") == 0, _iso("t")).alias("time"), F.col("ele"),
    )
    last = points.groupBy("track_id").agg(F.max("seq").alias("_last"))
    d = points.groupBy("track_id", F.floor(F.col("seq") / POINTS_PER_ELEMENT).alias("_part")).agg(
        F.first("name").alias("name"), F.sort_array(F.collect_list(pt)).alias("_p")
    )
    seg = F.struct(F.transform("_p", lambda p: F.struct(p["_lat"].alias("_lat"), p["_lon"].alias("_lon"), p["time"].alias("time"), p["ele"].alias("ele"))).alias("trkpt"))
    long = F.col("_last") >= POINTS_PER_ELEMENT
    d = d.join(last, "track_id")
    src = F.when(long, F.concat(F.lit(PIECE), F.col("track_id").cast("string")))
    d.select("name", src.alias("src"), F.when(long, F.col("_part")).alias("number"), seg.alias("trkseg")).write.mode("overwrite").format("xml").option("rootTag", "gpx").option("rowTag", "trk").save(path)
