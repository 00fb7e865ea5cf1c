"""Files in and out, and streams against their batch form."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrafield import session
from terrafield.operators import quality
from terrafield.plans.registry import Tables
from terrafield.sources import gpx, mvum, tables
from terrafield.streaming import nodes, tracks


def test_gpx_is_read_leniently(spark, tmp_path):
    (tmp_path / "a.gpx").write_text("""<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">
<wpt lat="44.5" lon="-121.5"><name>Camp</name><desc>dry</desc></wpt><wpt lat="95" lon="0"><name>bad</name></wpt><wpt lat="1" lon="2"/>
<trk><name>Loop</name><trkseg><trkpt lat="1" lon="1"/><trkpt lat="x" lon="1"/><trkpt lat="1" lon="2"><ele>7</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg>
<trkseg><trkpt lat="3" lon="1"/><trkpt lat="3" lon="2"/></trkseg><trkseg><trkpt lat="9" lon="9"/></trkseg></trk>
<rte><rtept lat="5" lon="5"><name>start</name></rtept><rtept lat="5" lon="6"/></rte></gpx>""")
    w = {(r.name, r.lat, r.note) for r in gpx.read_waypoints(spark, str(tmp_path)).collect()}
    assert w == {("Camp", 44.5, "dry"), ("Imported waypoint", 1.0, None)}
    t = gpx.read_track_points(spark, str(tmp_path)).groupBy("name").agg(F.count("*").alias("n"), F.max("ele").alias("e"), F.max(F.year("t")).alias("y"))
    assert {(r.name, r.n, r.e, r.y) for r in t.collect()} == {("Loop (1)", 2, 7.0, 2024), ("Loop (2)", 2, None, None), ("Imported route", 2, None, None)}


def test_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"properties": {"id": "1", "name": " ", "symbol": "2"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
        {"properties": {"id": "2"}, "geometry": None}]}))
    rows = mvum.read_mvum(spark, str(tmp_path / "m.json"), whole_documents=True).collect()
    assert [(r.props, [[(p.lng, p.lat) for p in part] for part in r.parts]) for r in rows] == [({"id": "1", "symbol": "2"}, [[(1.0, 2.0), (3.0, 4.0)]])]

    (tmp_path / "r.json").write_text(json.dumps([{"abbr": "OR", "name": "Oregon", "bbox": [-124.6, 42, -116.5, 46.3], "estMB": 400}]))
    r = tables.read_regions(spark, str(tmp_path / "r.json")).first()
    assert (r.abbr, r.west, r.north, r.maxzoom) == ("OR", -124.6, 46.3, 15)

    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "waypoints": [{"id": "w1", "lat": 1, "lng": 2.5}, {"id": "w 2", "lat": 1, "lng": 2}],
                                                 "tracks": [{"id": "t1", "pts": [[1, 2], [3, "x"]]}, {"id": "t2", "pts": [[1, 2, 3]]}]}))
    good, bad = tables.read_marks(spark, str(tmp_path / "b.json"))
    ids = lambda d: sorted(json.loads(r.mark)["id"] for r in d.collect())
    assert ids(good) == ["t2", "w1"] and ids(bad) == ["t1", "w 2"]

    (tmp_path / "p.json").write_text(json.dumps({"plants": [{"symbol": "A", "common": "Ash", "states": ["OR"], "commons": ["private"]}]}))
    p = tables.read_plants(spark, str(tmp_path / "p.json"))
    assert "commons" not in p.columns and p.first().states == ["OR"]


def test_files_of_a_pack_folder(spark):
    f = spark.createDataFrame([("/d/states/OR.pmtiles", 10, 5), ("/d/dem/OR/12/1.png", 3, 1), ("/d/dem/WA/12/1.png", 3, 1), ("/d/mvum/OR.geojson", 2, 1)], "path string, length bigint, modified bigint")
    assert [tuple(r) for r in quality.pack_inventory(f).collect()] == [("OR", 10, 5, 3, 2)]


def test_positions_never_step_back(spark):
    rows = [(1, 1, "Ann", None, None, None, None), (1, 2, "", 1.0, 1.0, 100, 5), (1, 3, None, 2.0, 2.0, 90, None), (1, 4, None, 0.0, 0.0, 500, 9), (1, 5, None, 3.0, 3.0, 100, None)]
    d = spark.createDataFrame(rows, "num int, arrival int, long_name string, lng double, lat double, pos_time int, altitude int")
    r = nodes.latest_nodes(d).first()
    assert (r.long_name, r.lng, r.pos_time, r.altitude) == ("Ann", 3.0, 100, 5)


@pytest.fixture
def rocksdb(spark):
    names = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    session.use_rocksdb(spark)
    spark.conf.set(names[1], "false")  # with expiry every batch asks for another, and a run to the end of the input never ends
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _recordings(spark, sf_dir):
    """Recordings of a device whose generations interleave: stragglers of older ones keep coming."""
    return Tables(spark, sf_dir).sql("select node * 4 + fix_id % 4 as session_id, node as device_id, cast(1 + least(fix_id / 60, 4) as int) - if(fix_id % 5 = 0 and fix_id > 70, 1, 0) as generation, fix_id as seq, ts, lng, lat from v_fix")


def _run(df, name, checkpoint):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_track_stream_equals_batch(spark, sf_dir, tmp_path, rocksdb):
    fix = _recordings(spark, sf_dir)
    for part in ("seq < 100", "seq >= 100 and seq < 101", "seq >= 101 and seq < 400", "seq >= 400"):
        fix.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fix.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = _run(tracks.live_track_stream(stream), "live", str(tmp_path / "cp"))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 3
    last = spark.table("live").groupBy("session_id").agg(F.max_by(F.struct("points", F.round("length_m", 3).alias("m"), F.round("duration_s", 3).alias("d")), "points").alias("r"))
    got = {tuple(r) for r in last.select("session_id", "r.*").where("points > 1").collect()}
    kept = tracks.drop_superseded(fix)
    assert 0 < kept.count() < fix.count()
    want = tracks.live_track(kept).select("session_id", "points", F.round("length_m", 3).alias("m"), F.round("duration_s", 3).alias("d")).where("points > 1")
    assert got == {tuple(r) for r in want.collect()}


def test_track_state_expires(spark, tmp_path, rocksdb):
    schema = "device_id bigint, generation int, session_id bigint, seq bigint, ts timestamp, lng double, lat double"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = tracks.live_track_stream(stream, ttl_s=2.0).writeStream.outputMode("update").foreachBatch(
            lambda d, i: seen.extend((r.session_id, r.points) for r in d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    t, seen = datetime.datetime(2024, 1, 1), []
    arrive((1, 2, 7, 1, t, 0.0, 0.0), (1, 2, 7, 2, t, 0.1, 0.0))
    time.sleep(3)
    arrive((1, 1, 7, 3, t, 0.2, 0.0))  # the newer generation is forgotten, and so are the points
    assert seen == [(7, 2), (7, 1)]


def test_state_table_folds_and_replays(spark, tmp_path):
    table = str(tmp_path / "nodes")
    state, schema, early = {}, "num bigint, battery int, name string", None
    with pytest.raises(ValueError):
        nodes.read_latest(spark, table)
    for b in range(23):
        rows = [(n, b * 10 + n, None if n % 2 else f"n{b}") for n in range(b % 3, 12, 3)] if b != 5 else []
        nodes.append_batch(spark.createDataFrame(rows, schema).coalesce(1), b, table, fold_every=4, buckets=2)
        state.update({r[0]: r for r in rows})
        if b % 6 == 3:  # a replay, also of a batch that has just been folded in
            nodes.append_batch(spark.createDataFrame(rows, schema), b, table, fold_every=4, buckets=2)
        if b == 9:
            early, early_state = nodes.read_latest(spark, table), dict(state)
        if b == 12:  # one fold later
            assert sorted(tuple(r) for r in early.collect()) == sorted(early_state.values())
        assert len(list((tmp_path / "nodes" / "change").iterdir())) <= 8
        if (tmp_path / "nodes" / "whole").exists():
            assert len(list((tmp_path / "nodes" / "whole").iterdir())) <= 2
    # a fold that never committed is no part of the table
    (tmp_path / "nodes" / "whole" / "99").mkdir()
    assert sorted(tuple(r) for r in nodes.read_latest(spark, table).collect()) == sorted(state.values())


def test_refined_fixes_equal_batch(spark, sf_dir):
    got = {tuple(r) for r in entry.queries()["t3_refine_fix_stream"](spark, sf_dir).collect()}
    batch = entry.queries()["w11_refine_fix"](spark, sf_dir).drop("fixes")
    want = {tuple(r) for r in batch.collect()}
    assert got <= want and len(want - got) <= 3  # the last requests are still open when the input ends


def test_long_track_stays_one(spark, tmp_path):
    from terrafield.sources import gpx

    n = 100_002
    pts = spark.range(n).select(F.when(F.col("id") >= 0, 7).alias("track_id"), F.lit("far").alias("name"), F.col("id").alias("seq"), (F.col("id") % 1000 / 1000.0).alias("lng"), (F.col("id") % 700 / 1000.0).alias("lat"), F.lit(1.5).alias("ele"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("t"))
    gpx.write_tracks(pts, str(tmp_path / "g"))
    back = gpx.read_track_points(spark, str(tmp_path / "g"))
    row = back.agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("ids"), F.max("seq").alias("last"), F.countDistinct("seq").alias("seqs"), F.min("t").alias("t"), F.max("t").alias("t2")).first()
    assert (row.n, row.ids, row.last, row.seqs) == (n, 1, n - 1, n) and row.t == row.t2
    assert back.join(pts.select("seq", F.col("lng").alias("x"), F.col("lat").alias("y")), "seq").where("abs(lng - x) > 1e-9 or abs(lat - y) > 1e-9").count() == 0
