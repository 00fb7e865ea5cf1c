"""Spatial joins over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import spatial
from . import sqlgen as q
from .registry import Tables, query


def rings(df):
    return df.withColumn("rings", spatial.box_ring())


def segments(df, line_id):
    """Two-vertex lines of a fixture as a segment table."""
    return df.select(
        line_id, F.lit(0).alias("part"), F.lit(0).alias("seq"), F.col("lng1").alias("alng"), F.col("lat1").alias("alat"),
        F.col("lng2").alias("blng"), F.col("lat2").alias("blat"), F.lit(False).alias("single"),
    )


def water_features(t: Tables):
    """Named water of the place view as features: flowing ones as short lines, the rest as points."""
    pt = lambda dx, dy: F.struct((F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
    flow = F.col("detail") == "river"
    return t.view("v_place").where("kind in ('water', 'area')").select(
        F.col("place_id").alias("water_id"), "name", F.col("detail").alias("kind"),
        F.when(flow, "LineString").otherwise("Point").alias("geom_type"),
        F.when(flow, F.array(F.array(pt(0.02, 0.02), pt(0.0, 0.0)), F.array(pt(-0.01, 0.0), pt(0.01, 0.01), pt(0.015, 0.0))))
        .otherwise(F.array(F.array(pt(0.0, 0.0)))).alias("parts"),
    )


_TOWN_RANK = q.case_map("t.detail", spatial.SETTLEMENT_RANK)


@query(
    "j6_nearest_town",
    f"""
with pairs as (
  select p.place_id, t.place_id as town_id, t.name as town, {q.hav('p.lng','p.lat','t.lng','t.lat')} as m, {_TOWN_RANK} as r
  from v_place p join v_place t on t.kind = 'locality' and {_TOWN_RANK} is not null and p.kind <> 'locality'
   and abs(t.lat - p.lat) <= 0.6e0 and abs(t.lng - p.lng) <= 0.8e0
), best as (
  select *, row_number() over (partition by place_id order by m / (1 + 2 * r), town_id) as rn from pairs where m <= 40 * 1609.344e0
) select place_id, town_id, town, round(m, 3) as dist_m from best where rn = 1
""",
)
def _(t: Tables):
    return spatial.nearest_town(t.view("v_place")).withColumn("dist_m", F.round("dist_m", 3))


@query(
    "j2_points_in_areas",
    """
select p.place_id, a.area_id, a.kind from v_place p join v_plot a
 on (a.south > p.lat) <> (a.north > p.lat) and p.lng < a.east and not (p.lng < a.west)
""",
)
def _(t: Tables):
    points = t.view("v_place").select("place_id", "lng", "lat")
    return spatial.points_in_areas(points, rings(t.view("v_plot"))).select("place_id", "area_id", "kind")


@query(
    "j2_points_in_large_areas",
    """
select p.place_id, a.area_id, a.kind from v_place p join v_area a
 on (a.south > p.lat) <> (a.north > p.lat) and p.lng < a.east and not (p.lng < a.west)
""",
)
def _(t: Tables):
    points = t.view("v_place").select("place_id", "lng", "lat")
    return spatial.points_in_areas(points, rings(t.view("v_area"))).select("place_id", "area_id", "kind")


@query(
    "j3_recover_labels",
    """
select area_id, name, label_id from (
  select a.area_id, l.name, l.label_id, row_number() over (partition by a.area_id order by l.kind <> a.kind, l.label_id) as rn
  from v_plot a join v_label l on (a.south > l.lat) <> (a.north > l.lat) and l.lng < a.east and not (l.lng < a.west)
) where rn = 1
""",
)
def _(t: Tables):
    return spatial.recover_labels(rings(t.view("v_plot")), t.view("v_label"))


@query(
    "j3_recover_water_labels",
    """
select area_id, name, label_id from (
  select a.area_id, l.name, l.label_id, row_number() over (partition by a.area_id order by l.label_id) as rn
  from v_plot a join v_label l on (a.south > l.lat) <> (a.north > l.lat) and l.lng < a.east and not (l.lng < a.west)
) where rn = 1
""",
)
def _(t: Tables):
    return spatial.recover_labels(rings(t.view("v_plot")), t.view("v_label"), same_kind_first=False)


@query(
    "j5_nearest_line",
    f"""
with line as (select lng1, lat1, lng2, lat2, min(mvum_id) as mvum_id from v_mvum group by all),
pt as (select distinct lng, lat from v_route),
d as (
  select p.lng, p.lat, l.mvum_id, {q.seg_dist('p.lng','p.lat','l.lng1','l.lat1','l.lng2','l.lat2')} as m
  from pt p join line l on p.lat between l.lat1 - 0.002e0 and l.lat2 + 0.002e0 and p.lng between l.lng1 - 0.002e0 and l.lng2 + 0.002e0
), best as (select *, row_number() over (partition by lng, lat order by m, mvum_id) as rn from d where m < 40)
select r.route_id, r.seq, b.mvum_id, round(b.m, 3) as dist_m from v_route r join best b on r.lng = b.lng and r.lat = b.lat and b.rn = 1
""",
)
def _(t: Tables):
    pts = t.view("v_route").select(F.struct("route_id", "seq").alias("pid"), "lng", "lat")
    hit = spatial.nearest_line_within(pts, segments(t.view("v_mvum"), "mvum_id"), "pid", "mvum_id")
    return hit.select("pid.route_id", "pid.seq", "mvum_id", F.round("dist_m", 3).alias("dist_m"))


_FISH = q.in_list(spatial.FISHABLE_KINDS)


@query(
    "j7_distance_to_water",
    f"""
with w as (select lng, lat from v_place where kind in ('water','area') and detail in {_FISH} and detail <> 'river'
  union all select lng + d.dx, lat + d.dy from v_place, (values (0.02e0,0.02e0),(0.0e0,0.0e0),(-0.01e0,0.0e0),(0.01e0,0.01e0),(0.015e0,0.0e0)) d(dx,dy)
   where kind in ('water','area') and detail = 'river'),
n as (select p.pin_id, min({q.hav('p.lng','p.lat','w.lng','w.lat', 6371000.0)}) as m
  from v_pin p join w on abs(p.lat - w.lat) < 0.03e0 and abs(p.lng - w.lng) < 0.05e0 group by 1)
select p.pin_id, round(case when n.m <= 3000 then n.m end, 3) as water_m from v_pin p left join n on p.pin_id = n.pin_id
""",
)
def _(t: Tables):
    pins = t.view("v_pin").select("pin_id", "lng", "lat")
    return spatial.distance_to_water(pins, water_features(t)).select("pin_id", F.round("water_m", 3).alias("water_m"))


_ANCHOR = """
water_point as (select place_id as water_id, name, detail as kind, case when detail = 'river' then lng + 0.01e0 else lng end as lng,
  case when detail = 'river' then lat + 0.01e0 else lat end as lat from v_place where kind in ('water','area') and detail in ('lake','river'))
"""


@query(
    "j8_nearby_water",
    f"""
with {_ANCHOR},
d as (select p.query_id, w.*, {q.hav('p.lng','p.lat','w.lng','w.lat', 3958.8)} as mi from v_query p, water_point w),
best as (select *, row_number() over (partition by query_id, name order by mi, water_id) as rn from d where mi <= 80)
select query_id, name, water_id, kind, round(mi, 6) as dist_mi, case when kind = 'river' then 'river' else 'lake' end as label from best where rn = 1
""",
)
def _(t: Tables):
    pts = t.view("v_query").select("query_id", "lng", "lat")
    near = spatial.nearby_water(pts, spatial.water_anchor_points(water_features(t)), "query_id")
    return near.select("query_id", "name", "water_id", "kind", F.round("dist_mi", 6).alias("dist_mi"), "label")


@query(
    "j9_nearest_lake_name",
    f"""
with {_ANCHOR},
d as (select p.pin_id, w.*, {q.hav('p.lng','p.lat','w.lng','w.lat', 3958.8)} as mi from v_pin p join water_point w
  on abs(p.lat - w.lat) < 0.06e0 and w.kind <> 'river'),
best as (select *, row_number() over (partition by pin_id order by mi, water_id) as rn from d where mi <= 3)
select pin_id, name as lake, round(mi, 6) as dist_mi from best where rn = 1
""",
)
def _(t: Tables):
    pins = t.view("v_pin").select("pin_id", "lng", "lat")
    near = spatial.nearest_lake_name(pins, spatial.water_anchor_points(water_features(t)), "pin_id")
    return near.withColumn("dist_mi", F.round("dist_mi", 6))


def _clamped(kind, v):
    return f"greatest(0, least(cast(pow(2, z) as bigint) - 1, cast(floor({v}) as bigint)))"


_COVER = f"""
cover as (select region_id, z,
  {_clamped('x', q.tile_x('west', 'z'))} as x0, {_clamped('x', q.tile_x('east', 'z'))} as x1,
  {_clamped('y', q.tile_y('north', 'z'))} as y0, {_clamped('y', q.tile_y('south', 'z'))} as y1
  from (select ordinal as region_id, * from v_catalog), (select unnest(range(6, 12)) as z))
"""


@query(
    "j17_tile_cover",
    f"""
with {_COVER}
select region_id, cast(z as int) as z, x, y from (select region_id, z, y0, y1, unnest(range(x0, x1 + 1)) as x from cover), lateral (select unnest(range(y0, y1 + 1)) as y)
""",
)
def _(t: Tables):
    boxes = t.view("v_catalog").withColumnRenamed("ordinal", "region_id")
    return spatial.tile_cover(boxes, 6, 11).select("region_id", "z", "x", "y")


@query(
    "j17_tile_budget",
    f"""
with {_COVER}
select region_id, cast(sum((x1 - x0 + 1) * (y1 - y0 + 1)) as bigint) as tiles,
  cast(max(case when (x1 - x0 + 1) * (y1 - y0 + 1) <= 12 then z end) as int) as finest_in_budget from cover group by 1
""",
)
def _(t: Tables):
    boxes = t.view("v_catalog").withColumnRenamed("ordinal", "region_id")
    return spatial.tile_range(boxes, 6, 11).groupBy("region_id").agg(
        F.sum("tiles").alias("tiles"), F.max(F.when(F.col("tiles") <= 12, F.col("z"))).alias("finest_in_budget")
    )


@query(
    "j18_run_range_join",
    """
select e.event_id as id, r.start, r.run_id from events e join
 (select o_orderkey as run_id, o_orderkey * 16 as start, cast(1 + (o_custkey * o_custkey) % 16 as bigint) as run_length from orders) r
 on e.event_id * 23 >= r.start and e.event_id * 23 < r.start + r.run_length
""",
)
def _(t: Tables):
    ids = t.table("events").select((F.col("event_id") * 23).alias("id"), "event_id")
    runs = t.table("orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") * 16).alias("start"),
        (1 + F.col("o_custkey") * F.col("o_custkey") % 16).cast("bigint").alias("run_length"),
    )
    return spatial.run_range_join(ids, runs).select(F.col("event_id").alias("id"), "start", "run_id")


@query(
    "j19_relative_to",
    f"""
with d as (select p.pin_id, {q.hav('v.lng','v.lat','p.lng','p.lat')} as m, {q.bearing('v.lng','v.lat','p.lng','p.lat')} as b
  from v_pin p join v_viewer v on p.owner = v.owner)
select pin_id, round(m, 3) as dist_m, round(b, 6) as bearing, {q.cardinal('b')} as direction from d
""",
)
def _(t: Tables):
    viewers = t.view("v_viewer").select("owner", "lng", "lat")
    rel = spatial.relative_to(viewers, t.view("v_pin"), "owner")
    return rel.select("pin_id", F.round("dist_m", 3).alias("dist_m"), F.round("bearing", 6).alias("bearing"), "direction")


@query(
    "f5_in_region",
    """
select p.place_id, r.ordinal as region_id from v_place p join v_catalog r
 on p.lng between r.west - 0.05e0 and r.east + 0.05e0 and p.lat between r.south - 0.05e0 and r.north + 0.05e0
""",
)
def _(t: Tables):
    regions = t.view("v_catalog").withColumnRenamed("ordinal", "region_id")
    return spatial.points_in_boxes(t.view("v_place").select("place_id", "lng", "lat"),
                                   regions.select("region_id", "west", "south", "east", "north"), 0.05
                                   ).select("place_id", "region_id")


@query(
    "hilbert_tile_order",
    """
with recursive t as (select place_id, 12 as z, cast(floor((lng + 180.0e0) / 360.0e0 * 4096) as bigint) as x,
   cast(floor((1.0e0 - ln(tan(radians(lat)) + 1.0e0 / cos(radians(lat))) / pi()) / 2.0e0 * 4096) as bigint) as y from v_place),
h as (select place_id, x as x0, y as y0, x, y, cast(2048 as bigint) as s, cast(0 as bigint) as d from t
  union all
  select place_id, x0, y0,
    case when (y & s) > 0 then x & (s - 1) when (x & s) > 0 then s - 1 - (y & (s - 1)) else y & (s - 1) end,
    case when (y & s) > 0 then y & (s - 1) when (x & s) > 0 then s - 1 - (x & (s - 1)) else x & (s - 1) end,
    s // 2, d + s * s * (case when (x & s) > 0 then (case when (y & s) > 0 then 2 else 3 end) else (case when (y & s) > 0 then 1 else 0 end) end)
  from h where s > 0)
select place_id, x0 as x, y0 as y, d + (cast(4096 as bigint) * 4096 - 1) // 3 as tile_id from h where s = 0
""",
)
def _(t: Tables):
    p = t.view("v_place").select("place_id", F.floor(cells.tile_xf("lng", 12)).alias("x"), F.floor(cells.tile_yf("lat", 12)).alias("y"))
    return p.withColumn("tile_id", cells.hilbert_tile_id(F.lit(12), "x", "y"))
