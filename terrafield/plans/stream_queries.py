"""Streams (in their batch form and as streams), sources, sinks and interval jobs over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sequences
from ..session import STATE_STORE, scratch_path, use_rocksdb
from ..sources import gpx, tables
from ..streaming import fixes, nodes, tracks
from . import sqlgen as q
from .path_queries import r3, r6
from .registry import Tables, query
from .rule_queries import NOW, status_sql

_LATEST = """
latest as (select num, arg_max(lng, pos_time * 1000000 + arrival) filter (lat is not null) as lng, arg_max(lat, pos_time * 1000000 + arrival) filter (lat is not null) as lat,
 arg_max(pos_time, pos_time * 1000000 + arrival) filter (lat is not null) as pos_time, arg_max(battery, arrival) filter (battery is not null) as battery,
 max(last_heard) as last_heard, arg_max(long_name, arrival) filter (long_name is not null) as long_name from v_mesh group by 1)
"""
_NODE_COLS = ["num", "pos_time", "battery", "last_heard", "long_name"]
_LATEST_SQL = f"with {_LATEST} select num, round(lng, 6) as lng, round(lat, 6) as lat, pos_time, battery, last_heard, long_name from latest"


@query("t1_latest_nodes", _LATEST_SQL)
def _(t: Tables):
    return nodes.latest_nodes(t.view("v_mesh")).select(*_NODE_COLS, r6("lng"), r6("lat"))


@query("t1_latest_nodes_stream", _LATEST_SQL)
def _(t: Tables):
    """The stream itself: update files in, folder table out, read back."""
    base = scratch_path(t.spark, f"nodes-{uuid.uuid4().hex}")
    t.view("v_mesh").repartition(3).write.parquet(f"{base}/updates")
    updates = t.spark.readStream.schema(t.view("v_mesh").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/updates")
    nodes.write_latest(updates, f"{base}/latest", f"{base}/checkpoint").awaitTermination()
    return nodes.read_latest(t.spark, f"{base}/latest").select(*_NODE_COLS, r6("lng"), r6("lat"))


@query("t4_status_feed", f"with {_LATEST} select num, freshness, age, battery_text, display_name from ({status_sql('latest')})")
def _(t: Tables):
    return nodes.status_feed(nodes.latest_nodes(t.view("v_mesh")), NOW).select("num", "freshness", "age", "battery_text", "display_name")


_REC = "select node * 4 + fix_id % 4 as session_id, node as device_id, case when fix_id > 300 and fix_id % 4 = 1 then 2 else 1 end as generation, fix_id as seq, ts, lng, lat from v_fix"


_TRACK_SQL = f"""
with r as ({_REC}), b as (select device_id, generation, min(seq) as b from r group by 1, 2),
k as (select r.* from r where not exists (select 1 from b where b.device_id = r.device_id and b.generation > r.generation and r.seq >= b.b)),
leg as (select session_id, ts, {q.hav('lag(lng) over w','lag(lat) over w','lng','lat')} as m from k window w as (partition by session_id order by seq))
select session_id, round(coalesce(sum(m), 0), 3) as length_m, count(*) as points, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration_s from leg group by 1 having count(*) > 1
"""


@query("t2_live_track", _TRACK_SQL)
def _(t: Tables):
    d = tracks.live_track(tracks.drop_superseded(t.sql(_REC)))
    return d.select("session_id", r3("length_m"), "points", "duration_s")


@query("t2_live_track_stream", _TRACK_SQL)
def _(t: Tables):
    """The same from a stream: totals of every trigger are written, the last ones read back."""
    base = scratch_path(t.spark, f"tracks-{uuid.uuid4().hex}")
    t.sql(_REC).write.parquet(f"{base}/in")
    fixes = t.spark.readStream.schema(t.sql(_REC).schema).parquet(f"{base}/in")
    before = t.spark.conf.get(STATE_STORE)
    use_rocksdb(t.spark)
    try:
        tracks.live_track_stream(fixes).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(
            lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(STATE_STORE, before)
    last = t.spark.read.parquet(f"{base}/out").groupBy("session_id").agg(F.max_by(F.struct("length_m", "points", "duration_s"), "batch").alias("r"))
    return last.select("session_id", "r.*").where("points > 1").select("session_id", r3("length_m"), "points", "duration_s")


def _asks(t: Tables):
    """Every event a fix; requests start a little before, or far before, their first fix."""
    f = t.sql("select cast(floor(event_id / 7) as bigint) as request_id, event_id as seq, timestamp_micros(1704067200000000 + event_id * 2300000 + (event_id % 3) * 400000) as ts, lng, lat, accuracy from (select fix_id as event_id, lng, lat, case when fix_id % 13 = 0 then null else 5.0e0 + fix_id % 60 end as accuracy from v_fix)")
    r = f.groupBy("request_id").agg(F.min("ts").alias("_f")).withColumn(
        "started_at", F.col("_f") - F.when(F.col("request_id") % 9 == 0, F.expr("interval 30 seconds")).otherwise(F.expr("interval 3 seconds"))
    ).drop("_f")
    return r, f


_W11 = """
with f as (select fix_id // 7 as request_id, fix_id as seq, fix_id * 2.3e0 + (fix_id % 3) * 0.4e0 as t, lng, lat, case when fix_id % 13 = 0 then null else 5.0e0 + fix_id % 60 end as accuracy from v_fix),
a as (select request_id, min(t) as t0, min(t) filter (accuracy <= 20) as tg from f group by 1),
ok as (select * from a where request_id % 9 <> 0),
u as (select f.*, row_number() over (partition by f.request_id order by coalesce(accuracy, 1e9), t, seq) as rn, count(*) over (partition by f.request_id) as n from f join ok on ok.request_id = f.request_id and t <= t0 + 12.0000001e0 and (tg is null or t <= tg))
select a.request_id, case when a.request_id % 9 = 0 then 'timeout' else 'ok' end as status, u.seq, round(u.lng, 6) as lng, round(u.lat, 6) as lat, u.accuracy{fixes} from a left join u on u.request_id = a.request_id and u.rn = 1
"""


@query("w11_refine_fix", _W11.format(fixes=", u.n as fixes"))
def _(t: Tables):
    r, f = _asks(t)
    return sequences.refine_fix(r, f).select("request_id", "status", "seq", r6("lng"), r6("lat"), "accuracy", "fixes")


_IV = "select o_custkey as k, o_orderkey as seq, cast((o_orderkey * 7919) % 97 * 60000 + o_orderkey % 400 as bigint) as start, cast(20000 + o_totalprice as bigint) as length from orders"


@query(
    "w12_merge_intervals",
    """
with recursive iv as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as i, cast((o_orderkey * 7919) % 97 * 60000 + o_orderkey % 400 as bigint) as s, cast(floor(20000 + o_totalprice) as bigint) as l from orders),
w as (select k, i, cast(0 as bigint) as b, s as lo, s + l as hi from iv where i = 1
 union all select v.k, v.i, case when greatest(v.s - w.hi, w.lo - (v.s + v.l), 0) <= 131072 and greatest(w.hi, v.s + v.l) - least(w.lo, v.s) <= 4194304 then w.b else w.b + 1 end,
  case when greatest(v.s - w.hi, w.lo - (v.s + v.l), 0) <= 131072 and greatest(w.hi, v.s + v.l) - least(w.lo, v.s) <= 4194304 then least(w.lo, v.s) else v.s end,
  case when greatest(v.s - w.hi, w.lo - (v.s + v.l), 0) <= 131072 and greatest(w.hi, v.s + v.l) - least(w.lo, v.s) <= 4194304 then greatest(w.hi, v.s + v.l) else v.s + v.l end
  from w join iv v on v.k = w.k and v.i = w.i + 1)
select k, b as batch_no, min(lo) as start, max(hi) - min(lo) as length, count(*) as members from (select k, b, arg_max(lo, i) over (partition by k, b) as lo, arg_max(hi, i) over (partition by k, b) as hi from w) group by 1, 2
""",
)
def _(t: Tables):
    return sequences.merge_intervals(t.sql(_IV), "k", "seq")


@query(
    "s1_read_features",
    "select feature_id, coalesce(name_en, name) as name, layer from v_feature where coalesce(name_en, name) is not null",
)
def _(t: Tables):
    """Features written as a table, read back by the reader."""
    base = scratch_path(t.spark, f"features-{uuid.uuid4().hex}")
    t.view("v_feature").write.parquet(base)
    return tables.read_features(t.spark, base).select("feature_id", "name", "layer")


def _documents(t: Tables, docs):
    """One file per row of text."""
    base = scratch_path(t.spark, f"documents-{uuid.uuid4().hex}")
    docs.write.option("maxRecordsPerFile", 1).text(base)
    return base


@query("s15_read_plants", "select symbol, scientific, common, verdict, tell, family from v_plant")
def _(t: Tables):
    """Plant documents of some hundred plants each, with working notes the reader leaves out."""
    v = t.view("v_plant").withColumn("notes", F.lit("unread"))
    docs = v.groupBy(F.floor(F.col("plant_no") / 200)).agg(F.collect_list(F.struct("symbol", "scientific", "common", "verdict", "tell", "family", "notes")).alias("plants"))
    path = _documents(t, docs.select(F.to_json(F.struct("plants")).alias("value")))
    return tables.read_plants(t.spark, path).select("symbol", "scientific", "common", "verdict", "tell", "family")


@query("s9_regions", "select abbr, name, west, south, east, north, coalesce(maxzoom, 15) as maxzoom from v_catalog")
def _(t: Tables):
    """Catalogue documents of some hundred regions each, read back by the reader."""
    raw = t.view("v_catalog").withColumn("bbox", F.array("west", "south", "east", "north")).withColumn("estMB", F.lit(1))
    docs = raw.groupBy(F.floor(F.col("ordinal") / 200)).agg(F.collect_list(F.struct("abbr", "name", "bbox", "estMB", "maxzoom")).alias("d"))
    return tables.read_regions(t.spark, _documents(t, docs.select(F.to_json("d").alias("value")))).drop("est_mb")


@query(
    "s10_read_dem",
    "select vec_id, len(list_filter(embedding, lambda v: v > 0)) as known, len(embedding) as pixels from embeddings",
)
def _(t: Tables):
    e = t.table("embeddings").withColumn("data", F.transform("embedding", lambda v: F.when(v > 0, v).otherwise(F.lit(float("nan")).cast("float"))))
    base = scratch_path(t.spark, f"dem-{uuid.uuid4().hex}")
    e.select(F.lit(12).alias("z"), F.col("vec_id").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(8).alias("width"), "data").write.parquet(base)
    d = tables.read_dem(t.spark, base).withColumnRenamed("x", "vec_id")
    return d.select("vec_id", F.size(F.filter("data", lambda v: v.isNotNull())).cast("bigint").alias("known"), F.size("data").cast("bigint").alias("pixels"))


_EXTRACT_F = "select feature_id, 12 as z, cast(floor((lng + 180.0e0) / 360.0e0 * 4096) as bigint) as x, cast(floor((1.0e0 - ln(tan(radians(lat)) + 1.0e0 / cos(radians(lat))) / pi()) / 2.0e0 * 4096) as bigint) as y from v_feature"
_Y = lambda c: f"cast(floor((1.0e0 - ln(tan(radians({c})) + 1.0e0 / cos(radians({c}))) / pi()) / 2.0e0 * 4096) as bigint)"


@query(
    "s11_region_extract",
    f"""
with r as (select ordinal as region_id, cast(floor((west + 180.0e0) / 360.0e0 * 4096) as bigint) as x0, cast(floor((east + 180.0e0) / 360.0e0 * 4096) as bigint) as x1, {_Y('north')} as y0, {_Y('south')} as y1 from v_catalog)
select r.region_id, f.feature_id, f.x, f.y from ({_EXTRACT_F}) f join r on f.x between x0 and x1 and f.y between y0 and y1
""",
)
def _(t: Tables):
    regions = t.view("v_catalog").withColumnRenamed("ordinal", "region_id")
    d = tables.region_extract(t.sql(_EXTRACT_F), regions, 8, 14)
    return d.select("region_id", "feature_id", "x", "y")


@query(
    "s11_region_extract_errors",
    f"""
with r as (select ordinal as region_id, cast(floor((west + 180.0e0) / 360.0e0 * 4096) as bigint) as x0, cast(floor((east + 180.0e0) / 360.0e0 * 4096) as bigint) as x1, {_Y('north')} as y0, {_Y('south')} as y1 from v_catalog)
select region_id, 'no map data covers that area' as error from r where not exists (select 1 from ({_EXTRACT_F}) f where f.x between x0 and x1 and f.y between y0 and y1)
""",
)
def _(t: Tables):
    regions = t.view("v_catalog").withColumnRenamed("ordinal", "region_id")
    return tables.region_extract_errors(tables.region_tiles(t.sql(_EXTRACT_F), regions, 8, 14), regions)


_MARKS = """select c_custkey as k, case when c_custkey % 2 = 0 then 'waypoint' else 'track' end as kind,
 case c_custkey % 14 when 0 then '{"id": "w' || cast(c_custkey as string) || '", "lat": 44.5, "lng": -121, "name": "a"}'
  when 1 then '{"id": "t1", "pts": [[-121.5, 44], [-121, 44.25, 900]]}' when 2 then '{"id": "bad id", "lat": 44.5, "lng": -121}' when 3 then '{"id": "t_2", "pts": [[-121.5, "44"]]}'
  when 4 then '{"id": "w4", "lat": "44.5", "lng": -121}' when 5 then '{"id": "t5", "name": 7, "pts": []}' when 6 then '{"id": "w6", "lat": 1, "lng": 2, "note": false}'
  when 7 then '{"id": "t7", "pts": []}' when 8 then '{"id": 8, "lat": 1, "lng": 2}' when 9 then '{"id": "t9"}' when 10 then 'not json' when 11 then '{"id": "t11", "name": "n", "pts": [[1e1, 2.5e0]]}'
  when 12 then '{"id": "w12", "lat": 1.25, "lng": 2, "note": "n"}' else '{"id": "t13", "pts": [[1, null]]}' end as mark from customer"""


@query("s7_check_marks", "select c_custkey as k, case when c_custkey % 2 = 0 then 'waypoint' else 'track' end as kind, c_custkey % 14 in (0, 1, 7, 11, 12) as valid from customer")
def _(t: Tables):
    return tables.check_marks(t.sql(_MARKS)).select("k", "kind", "valid")


@query(
    "s8_write_marks",
    "select case when c_custkey % 2 = 0 then 'waypoint' else 'track' end as kind, count(*) as count, cast(1 as bigint) as version from customer where c_custkey % 14 in (0, 1, 7, 11, 12) group by 1",
)
def _(t: Tables):
    base = scratch_path(t.spark, f"marks-{uuid.uuid4().hex}")
    tables.write_marks(tables.check_marks(t.sql(_MARKS)).where("valid").select("kind", "mark"), base)
    return t.spark.read.schema("kind string, count bigint, version bigint").json(f"{base}/manifest")


@query(
    "s5_s6_gpx_round_trip",
    """
select 'track' as what, 'Track ' || cast(node as varchar) as name, count(*) as points, count(altitude) as with_ele, round(sum(lng), 3) as lng, round(sum(lat), 3) as lat from v_fix group by 1, 2 having count(*) > 1
union all select 'waypoint', name, count(*), count(note), round(sum(lng), 3), round(sum(lat), 3) from v_pin group by 1, 2
""",
)
def _(t: Tables):
    base = scratch_path(t.spark, f"gpx-{uuid.uuid4().hex}")
    pts = t.sql("select node as track_id, 'Track ' || cast(node as string) as name, row_number() over (partition by node order by fix_id) - 1 as seq, lng, lat, altitude as ele, ts as t from v_fix")
    gpx.write_tracks(pts, f"{base}/tracks")
    gpx.write_waypoints(t.view("v_pin").withColumn("t", F.timestamp_seconds("t")), f"{base}/waypoints")
    got = gpx.read_track_points(t.spark, f"{base}/tracks").select(F.lit("track").alias("what"), "name", F.col("ele").isNotNull().alias("x"), "lng", "lat")
    wpt = gpx.read_waypoints(t.spark, f"{base}/waypoints").select(F.lit("waypoint").alias("what"), "name", F.col("note").isNotNull().alias("x"), "lng", "lat")
    return got.unionByName(wpt).groupBy("what", "name").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("x").alias("with_ele"), F.round(F.sum("lng"), 3).alias("lng"), F.round(F.sum("lat"), 3).alias("lat")
    )


@query(
    "s2_read_mvum",
    "select mvum_id, name, cast(2 as int) as parts, round(lng1, 6) as lng, nullif(trim(seasonal), '') as seasonal from v_mvum where mvum_id % 5 <> 0",
)
def _(t: Tables):
    """Features written as JSON lines, read back; every fifth has no geometry."""
    from ..sources.mvum import read_mvum

    base = scratch_path(t.spark, f"mvum-{uuid.uuid4().hex}")
    coords = F.expr("case when mvum_id % 5 = 0 then null else named_struct('type', 'MultiLineString', 'coordinates', array(array(array(lng1, lat1), array(lng2, lat2)), array(array(lng2, lat2), array(lng1, lat1)))) end")
    rows = t.view("v_mvum").select(F.struct(F.col("mvum_id").cast("string").alias("id"), "name", "seasonal").alias("properties"), coords.alias("geometry"))
    rows.write.json(base)
    d = read_mvum(t.spark, base)
    return d.select(F.col("props")["id"].cast("bigint").alias("mvum_id"), F.col("props")["name"].alias("name"), F.size("parts").alias("parts"),
                    F.round(F.col("parts")[0][0]["lng"], 6).alias("lng"), F.col("props")["seasonal"].alias("seasonal"))


@query("t3_refine_fix_stream", _W11.format(fixes=""))
def _(t: Tables):
    """The stream with timers, run to its end over the same requests and fixes."""
    base = scratch_path(t.spark, f"fix-{uuid.uuid4().hex}")
    r, f = _asks(t)
    none = F.lit(None).cast("double")
    asks = r.select("request_id", F.lit(-1).cast("bigint").alias("seq"), F.col("started_at").alias("ts"), none.alias("lng"), none.alias("lat"), none.alias("accuracy"))
    # a last event far ahead, of a request that never ends, lets all timers run out
    late = asks.groupBy().agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    late = late.select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("seq"), "ts", none.alias("lng"), none.alias("lat"), none.alias("accuracy"))
    ev = f.unionByName(asks).unionByName(late)
    ev.write.parquet(f"{base}/events")
    stream = t.spark.readStream.schema(ev.schema).parquet(f"{base}/events")
    out = fixes.refine_fix_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
    out.format("parquet").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(fixes.SCHEMA).parquet(f"{base}/out").select("request_id", "status", "seq", r6("lng"), r6("lat"), "accuracy")
