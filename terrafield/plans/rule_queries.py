"""Rule-based enrichment over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rule_values as V
from ..operators import rules, spatial, terrain
from . import sqlgen as q
from .path_queries import dates_sql, r3
from .registry import Tables, query
from .spatial_queries import rings
from .terrain_queries import dem_join

_KIND_LIST = sorted({k for ks in V.RESOURCE_KINDS.values() for k in ks} | {k for ks in V.OVERLAY_KINDS.values() for k in ks} | {"other"})


def poi_sql() -> str:
    whens = " ".join(f"when {i} then {q.lit(k)}" for i, k in enumerate(_KIND_LIST))
    return f"select p_partkey as poi_id, case p_partkey % {len(_KIND_LIST)} {whens} end as kind, case when p_partkey % 3 = 0 then '' else p_name end as name from part"


def _class_values(table) -> str:
    return ", ".join(f"({q.lit(c)}, {q.lit(k)})" for c, ks in table.items() for k in ks)


@query(
    "f2_resource_features",
    f"select p.poi_id, c.category, 11 as dot_zoom, case when p.name <> '' then 14 end as label_zoom from ({poi_sql()}) p join (values {_class_values(V.RESOURCE_KINDS)}) c(category, kind) on p.kind = c.kind",
)
def _(t: Tables):
    return rules.resource_features(t.sql(poi_sql())).select("poi_id", "category", "dot_zoom", "label_zoom")


@query(
    "f3_overlay_class",
    f"select p.poi_id, c.overlay from ({poi_sql()}) p join (values {_class_values(V.OVERLAY_KINDS)}) c(overlay, kind) on p.kind = c.kind",
)
def _(t: Tables):
    return rules.overlay_class(t.sql(poi_sql())).select("poi_id", "overlay")


def land_sql(kind="kind", name="name") -> tuple[str, str]:
    cls = "case " + " ".join(f"when lower({kind}) in {q.in_list(ks)} then {q.lit(c)}" for c, ks in V.LAND_CLASSES.items()) + " end"
    n = f"lower(trim({name}))"
    des = "case " + " ".join(f"when regexp_matches({n}, {q.lit(p)}) then {q.lit(d)}" for d, p in V.DESIGNATIONS)
    des += f" when not regexp_matches({n}, {q.lit(V.WIDER_THAN_LOCAL)}) and regexp_matches({n}, {q.lit(V.LOCAL_PARK)}) then 'local_park' end"
    return cls, f"case when ({cls}) <> 'military' then {des} end"


_CLS, _DES = land_sql()
_prof = lambda i: q.case_map("coalesce(d, c)", {k: p[i] for k, p in V.LAND_PROFILES.items()})
_rule = lambda i, j: q.case_map("coalesce(d, c)", {k: p[4][i][j] for k, p in V.LAND_PROFILES.items()})


@query(
    "r1_land_info",
    f"""
with l as (select area_id, trim(name) as name, {_CLS} as c, {_DES} as d from v_land)
select area_id, name, c as land_class, d as designation, {_prof(0)} as title, {_prof(1)} as manager, {_prof(2)} as access, {_prof(3)} as access_note,
 {_rule(0, 0)} as enter, {_rule(1, 0)} as camp, {_rule(2, 0)} as hunt, {_rule(3, 0)} as fire, {_rule(2, 1)} as hunt_ok from l where c is not null
""",
)
def _(t: Tables):
    return rules.land_info(t.view("v_land")).select(
        "area_id", "name", "land_class", "designation", "title", "manager", "access", "access_note", "enter", "camp", "hunt", "fire", "hunt_ok"
    )


@query(
    "j4_land_at",
    f"""
with lab as (select area_id, name from (select a.area_id, l.name, row_number() over (partition by a.area_id order by l.kind <> a.kind, l.label_id) as rn
  from v_plot a join v_label l on (a.south > l.lat) <> (a.north > l.lat) and l.lng < a.east and not (l.lng < a.west)) where rn = 1),
nm as (select a.*, coalesce(lab.name, '') as name from v_plot a left join lab on a.area_id = lab.area_id),
inf as (select *, {_CLS} as c, {_DES} as d from nm),
pr as (select area_id, west, south, east, north, trim(name) as name, d as designation, {_prof(0)} as title, {_prof(2)} as access from inf where c is not null),
hit as (select p.place_id, r.*, row_number() over (partition by p.place_id order by access <> 'closed', designation is null, r.name = '', r.area_id) as rn
  from v_place p join pr r on (r.south > p.lat) <> (r.north > p.lat) and p.lng < r.east and not (p.lng < r.west))
select place_id, area_id, title, name, designation, access from hit where rn = 1
""",
)
def _(t: Tables):
    plots = rings(t.view("v_plot"))
    names = spatial.recover_labels(plots, t.view("v_label")).select("area_id", "name")
    info = rules.land_info(t.view("v_plot").select("area_id", "kind").join(names, "area_id", "left"))
    return rules.land_at(t.view("v_place"), plots, info, "place_id")


_WATERS = "select p.place_id, case p.place_id % 9 when 0 then 'water' when 1 then 'lake' when 2 then 'reservoir' when 3 then 'river' when 4 then 'stream' when 5 then 'canal' when 6 then 'pond' when 7 then 'basin' else 'lagoon' end as kind, p.lng + case p.place_id % 4 when 0 then 0.0e0 when 1 then 20.0e0 when 2 then 40.0e0 else 30.0e0 end as lng, p.lat - case p.place_id % 5 when 0 then 0.0e0 when 1 then 5.0e0 when 2 then 10.0e0 else -1.0e0 end as lat, case when p.place_id % 6 = 0 then null else cast((p.place_id * 131) % 9000 as double) end as elevation_ft from v_place p"


def fish_sql() -> str:
    line = "greatest(0.0e0, (49 - abs(lat)) * 320)"
    reg = (f"case when elevation_ft is null then case when abs(lat) >= 44 then 'cold' when abs(lat) >= 39 then 'cool' else 'warm' end "
           f"when elevation_ft >= {line} then 'cold' when elevation_ft >= {line} - 1500 then 'cool' else 'warm' end")
    arr = lambda xs: "[" + ",".join(q.lit(x) for x in xs) + "]"
    base = "case " + " ".join(
        f"when regime = {q.lit(r)} and moving = {q.lit(m)}" + ("" if w is None else f" and west = {q.lit(w)}") + f" then {arr(f)}"
        for (r, m, w), f in V.FISH_BASE.items()) + " end"
    big = f"case when regime = 'cold' and kind in {q.in_list(V.BIG_WATER)} and not moving then {arr(V.FISH_BIG_COLD)} when regime = 'warm' and lat < 36 and lng > -95 then {arr(V.FISH_SOUTH_EAST)} else [] end"
    pac = "(lng < -116.5e0 and lat > 34 and lat < 62)"
    lead = (f"list_concat(case when not west and lng < -69 and lat >= 41 and regime <> 'warm' then {arr(V.FISH_NORTH)} else [] end, list_concat("
            f"case when {pac} and moving and regime <> 'warm' and (elevation_ft is null or elevation_ft < 3000) then {arr(V.FISH_PACIFIC)} else [] end, "
            f"case when {pac} and kind = 'river' then {arr(V.FISH_PACIFIC_RIVER)} else [] end))")
    typ = (f"case when regime = 'cold' then {q.case_map('kind', V.WATER_TYPE_COLD, q.lit('high lake'))} else {q.case_map('kind', V.WATER_TYPE, q.lit('lake'))} end")
    how = "case " + " ".join(f"when regime = {q.lit(r)} and moving = {q.lit(m)} then {q.lit(h)}" for (r, m), h in V.FISH_METHOD.items()) + " end"
    return f"""
with w as (select *, {reg} as regime, kind in {q.in_list(V.MOVING_WATER)} as moving, lng < -100 as west from ({_WATERS})),
s as (select *, list_concat({lead}, list_concat({base}, {big})) as raw from w),
u as (select place_id, x, min(i) as i from (select place_id, unnest(raw) as x, generate_subscripts(raw, 1) as i from s) group by 1, 2),
r as (select place_id, string_agg(x, '|' order by i) as species from (select *, row_number() over (partition by place_id order by i) as rn from u) where rn <= 6 group by 1)
select s.place_id, s.regime, {typ} as water_type, r.species, {how} as method, elevation_ft is not null as elevation_known from s join r on s.place_id = r.place_id
"""


@query("r2_likely_fish", fish_sql())
def _(t: Tables):
    d = rules.likely_fish(t.sql(_WATERS))
    return d.select("place_id", "regime", "water_type", F.array_join("species", "|").alias("species"), "method", "elevation_known")


_GROUND = "select p.place_id, case p.place_id % 13 when 0 then 'forest' when 1 then 'wood' when 2 then 'scrub' when 3 then 'meadow' when 4 then 'grassland' when 5 then 'grass' when 6 then 'wetland' when 7 then 'farmland' when 8 then 'farmyard' when 9 then 'orchard' when 10 then 'vineyard' when 11 then 'Forest' else 'park' end as kind, p.lng + case p.place_id % 3 when 0 then 40.0e0 else 0.0e0 end as lng, p.lat - (p.place_id % 4) * 1.0e0 as lat, case when p.place_id % 5 = 0 then null else cast((p.place_id * 131) % 7000 as double) end as elevation_ft, cast(p.place_id % 12 as int) as month from v_place p"


def forage_sql() -> str:
    arr = lambda xs: ("[" + ",".join(q.lit(x) for x in xs) + "]") if xs else "[]"
    hab = q.case_map("lower(kind)", V.HABITATS)
    woods = "case when elevation_ft is null then case when west then 'conifer forest' else 'hardwood forest' end when elevation_ft >= 4500 or (west and elevation_ft >= 3000) then 'conifer forest' else 'hardwood forest' end"
    by = lambda tb: "case " + " ".join(f"when habitat = {q.lit(h)} then case when west then {arr(w)} else {arr(e)} end" for h, (w, e) in tb.items()) + " end"
    sea = "case when month in (0, 1, 11) then 'winter' when month <= 4 then 'spring' when month <= 7 then 'summer' else 'fall' end"
    extra = (f"case when season = 'spring' and contains(habitat, 'forest') then {arr(V.SPRING_WOODS + V.SPRING)} when season = 'spring' then {arr(V.SPRING)} "
             f"when season = 'fall' and contains(habitat, 'forest') then {arr(V.FALL_WOODS)} else [] end")
    return f"""
with g as (select *, lng < -100 as west, {sea} as season from ({_GROUND})),
h as (select *, coalesce({hab}, case when lower(kind) in ('forest','wood') then {woods} when west then 'conifer forest' else 'hardwood forest' end) as habitat from g),
p as (select *, list_concat({by(V.FORAGE_PLANTS)}, {extra}) as pl, list_concat(case when season = 'winter' then {arr(V.WINTER_GAME)} else [] end, {by(V.FORAGE_GAME)}) as gm from h)
select place_id, habitat, season, array_to_string(pl[1:7], '|') as plants, array_to_string(gm[1:5], '|') as game, {q.case_map('season', V.FORAGE_SEASON_NOTE)} as season_note from p
"""


@query("r3_likely_forage", forage_sql())
def _(t: Tables):
    d = rules.likely_forage(t.sql(_GROUND))
    return d.select("place_id", "habitat", "season", F.array_join("plants", "|").alias("plants"), F.array_join("game", "|").alias("game"), "season_note")


def season_sql() -> str:
    vals = ", ".join(
        f"({q.lit(s)}, {V.SEASON_TOPICS.index(tp)}, {q.lit(tp)}, {q.lit(w)}, {q.lit(n)}, {q.lit(words)})" for (s, tp, w, n), words in V.SEASON_NOTES.items())
    sea = "case when month in (0, 1, 11) then 'winter' when month <= 4 then 'spring' when month <= 7 then 'summer' else 'fall' end"
    return f"""
with g as (select *, {sea} as season from ({_GROUND}))
select place_id, g.season, n.i as item_no, n.topic, n.note from g join (values {vals}) n(season, i, topic, west, north, note)
 on g.season = n.season and (n.west is null or n.west = (lng < -100)) and (n.north is null or n.north = (lat >= 42))
"""


@query("r4_season_report", season_sql())
def _(t: Tables):
    return rules.season_report(t.sql(_GROUND)).select("place_id", "season", "item_no", "topic", "note")


_SITE = "select p.place_id, case p.place_id % 4 when 0 then null else cast((p.place_id * 17) % 300 as double) / 10 end as slope_deg, case p.place_id % 5 when 0 then null else cast((p.place_id * 53) % 3500 as double) end as water_m, p.place_id % 3 = 0 as tree_cover, case p.place_id % 7 when 0 then 'military' when 1 then 'public' when 2 then 'public' else 'unknown' end as land, p.place_id % 11 = 0 as wetland from v_place p"


def camp_sql(src: str, key: str) -> str:
    rnd = lambda c: f"cast(cast(floor({c} + 0.5e0) as bigint) as varchar)"
    l = q.lit
    return f"""
select {key}, sc as score, case when land = 'military' or slope_deg > 20 then 'avoid' when sc >= 4 then 'good' when sc >= 1 then 'fair' else 'poor' end as verdict,
 concat_ws('|', case when land = 'military' then {l(V.CAMP_MILITARY)} end,
  case when slope_deg > 20 then 'Steep ground (' || {rnd('slope_deg')} || '°) — no flat spot to lie down.' end,
  case when wetland then {l(V.CAMP_WETLAND)} end,
  case when slope_deg is null then {l(V.CAMP_NO_TERRAIN)} when slope_deg <= 5 then 'Flat ground (' || {rnd('slope_deg')} || '°) — good for a tent.'
   when slope_deg <= 12 then 'Gently sloped (' || {rnd('slope_deg')} || '°) — sleep with your head uphill.' when slope_deg <= 20 then 'Noticeably sloped (' || {rnd('slope_deg')} || '°) — water would run through camp.' end,
  case when water_m is null then {l(V.CAMP_NO_WATER)} when water_m < 30 then {l(V.CAMP_ON_WATER)}
   when water_m <= 800 then 'Water about ' || {rnd('water_m')} || ' m away — close enough to fetch, far enough to be dry.'
   when water_m <= 3000 then 'Nearest water is roughly ' || printf('%.1f', water_m / 1000) || ' km — a hike, but reachable.' else {l(V.CAMP_FAR_WATER)} end,
  case when tree_cover then {l(V.CAMP_TREES)} else {l(V.CAMP_OPEN)} end,
  case when land = 'public' then {l(V.CAMP_PUBLIC)} when land = 'unknown' then {l(V.CAMP_UNKNOWN_LAND)} end) as reasons
from (select *, cast(case when wetland then -3 else 0 end + case when slope_deg is null then 0 when slope_deg <= 5 then 2 when slope_deg <= 12 then 1 when slope_deg <= 20 then -1 else 0 end
  + case when water_m is null then -1 when water_m < 30 then -1 when water_m <= 800 then 2 when water_m <= 3000 then 0 else -1 end + case when tree_cover then 1 else 0 end + case when land = 'public' then 1 else 0 end as int) as sc from {src})
"""


@query("r5_score_camp", camp_sql(f"({_SITE})", "place_id"))
def _(t: Tables):
    return rules.score_camp(t.sql(_SITE)).select("place_id", "score", "verdict", F.array_join("reasons", "|").alias("reasons"))


_CAMP_WATER = "select place_id as water_id, lng, lat from v_place where kind in ('water', 'area')"


@query(
    "r5_camp_check",
    f"""
with side as (select pin_id, lat as lat0, s, lng + dx * 0.0005e0 / greatest(0.2e0, cos(radians(lat))) as lng, lat + dy * 0.0005e0 as lat from v_pin, (values ('n', 0, 1), ('s', 0, -1), ('e', 1, 0), ('w', -1, 0)) o(s, dx, dy)),
e as ({dem_join('side')}),
g as (select pin_id, any_value(lat0) as lat, max(case when s = 'n' then elev_m end) as n, max(case when s = 's' then elev_m end) as so, max(case when s = 'e' then elev_m end) as ea, max(case when s = 'w' then elev_m end) as we from e group by 1),
sl as (select pin_id, degrees(atan(sqrt(pow((n - so) / (2 * 0.0005e0 * 111320.0e0), 2) + pow((ea - we) / (2 * 0.0005e0 / greatest(0.2e0, cos(radians(lat))) * 111320.0e0 * cos(radians(lat))), 2)))) as slope_deg from g),
wd as (select p.pin_id, min({q.hav('p.lng','p.lat','w.lng','w.lat', 6371000.0)}) as m from v_pin p join ({_CAMP_WATER}) w on abs(p.lat - w.lat) < 0.03e0 and abs(p.lng - w.lng) < 0.05e0 group by 1),
ar as (select p.pin_id, bool_or(a.kind in {q.in_list(V.OVERLAY_KINDS['military'])}) as mil, bool_or(a.kind in {q.in_list(V.OVERLAY_KINDS['public'])}) as pub, bool_or(a.kind in {q.in_list(V.OVERLAY_KINDS['forest'])}) as tr, bool_or(a.kind = 'wetland') as wet
  from v_pin p join v_plot a on (a.south > p.lat) <> (a.north > p.lat) and p.lng < a.east and not (p.lng < a.west) group by 1),
site as (select p.pin_id, sl.slope_deg, case when wd.m <= 3000 then wd.m end as water_m, coalesce(ar.tr, false) as tree_cover, case when ar.mil then 'military' when ar.pub then 'public' else 'unknown' end as land, coalesce(ar.wet, false) as wetland
  from v_pin p left join sl on p.pin_id = sl.pin_id left join wd on p.pin_id = wd.pin_id left join ar on p.pin_id = ar.pin_id)
{camp_sql('site', 'pin_id')}
""",
)
def _(t: Tables):
    pins = t.view("v_pin").select("pin_id", "lng", "lat")
    water = t.sql(_CAMP_WATER).select(
        F.lit("lake").alias("kind"), F.array(F.array(F.struct(F.col("lng").alias("lng"), F.col("lat").alias("lat")))).alias("parts"))
    ground = rules.ground_under(spatial.points_in_areas(pins, rings(t.view("v_plot"))), "pin_id")
    site = (
        spatial.distance_to_water(pins, water).join(terrain.slope(pins, t.view("v_dem"), "pin_id"), "pin_id", "left").join(ground, "pin_id", "left")
        .fillna({"land": "unknown", "tree_cover": False, "wetland": False})
    )
    return rules.score_camp(site).select("pin_id", "score", "verdict", F.array_join("reasons", "|").alias("reasons"))


_VEH = "select mvum_id, symbol, passengervehicle, dates as passengervehicle_datesopen, case mvum_id % 3 when 0 then 'OPEN ' when 1 then 'closed' else null end as fourwd_gt50inches, case mvum_id % 2 when 0 then ' 5/1 - 9/15 ' else null end as fourwd_gt50_datesopen, case when mvum_id % 5 = 0 then 'open' end as motorcycle, 'by permit' as motorcycle_datesopen from v_mvum"


@query(
    "r7_vehicle_access",
    f"""
with v as ({_VEH}), u as (
 select mvum_id, symbol, 0 as vehicle_no, 'Passenger car' as vehicle, passengervehicle as flag, passengervehicle_datesopen as raw from v
 union all select mvum_id, symbol, 3, '4WD over 50"', fourwd_gt50inches, fourwd_gt50_datesopen from v
 union all select mvum_id, symbol, 6, 'Motorcycle', motorcycle, motorcycle_datesopen from v),
o as (select *, trim(coalesce(raw, '')) as d from u where lower(trim(flag)) = 'open')
select mvum_id, vehicle_no, vehicle, {dates_sql('d')} as dates, {q.case_map('symbol', V.MVUM_LABELS, q.lit(V.MVUM_UNKNOWN))} as road_class, symbol in {q.in_list(V.MVUM_SEASONAL_SYMBOLS)} as seasonal from o
""",
)
def _(t: Tables):
    return rules.vehicle_access(t.sql(_VEH))


NOW = 1704067200 + 60 * 600


def status_sql(src: str) -> str:
    """Node status of rows with pos_time, battery, long_name and num."""
    age = f"greatest(0, {NOW} - pos_time)"
    hrs = f"({age} // 3600)"
    mins = f"(({age} - {hrs} * 3600) // 60)"
    return f"""
select *, case when coalesce(pos_time, 0) = 0 then 'old' when {NOW} - pos_time < 300 then 'live' when {NOW} - pos_time < 1800 then 'recent' when {NOW} - pos_time < 3600 then 'stale' else 'old' end as freshness,
 case when coalesce(pos_time, 0) = 0 then 'never' when {age} < 45 then 'just now' when {age} // 60 < 60 then greatest(1, {age} // 60)::varchar || ' min ago'
  when {hrs} < 24 and {mins} > 0 then {hrs}::varchar || ' h ' || {mins}::varchar || ' min ago' when {hrs} < 24 then {hrs}::varchar || ' h ago'
  when {age} // 86400 = 1 then '1 day ago' else ({age} // 86400)::varchar || ' days ago' end as age,
 case when battery is null or battery < 0 then '' when battery > 100 then 'plugged in' else battery::varchar || '%' end as battery_text,
 coalesce(nullif(trim(long_name), ''), '!' || lpad(lower(printf('%x', num)), 8, '0')) as display_name from {src}
"""


@query("r10_node_status", f"select num, arrival, freshness, age, battery_text, display_name from ({status_sql('v_mesh')})")
def _(t: Tables):
    return rules.node_status(t.view("v_mesh"), NOW).select("num", "arrival", "freshness", "age", "battery_text", "display_name")


@query(
    "f7_drop_null_island",
    "select event_id, case when event_id % 7 = 0 then null else lat end as lat, case when event_id % 7 = 0 then null else lng end as lng from (select event_id, 44.0e0 as lat, -121.0e0 as lng from events)",
)
def _(t: Tables):
    from ..sources import clean

    d = t.sql("select event_id, case when event_id % 7 = 0 then 0.0e0 else 44.0e0 end as lat, case when event_id % 7 = 0 then 0.0e0 else -121.0e0 end as lng from events")
    return clean.drop_null_island(d, ["lat", "lng"])


@query(
    "f6_valid_coord",
    "select event_id from (select event_id, value * 3 - 90 as lat, case when event_id % 11 = 0 then null else value * 5 - 180 end as lng from events) where lat between -90 and 90 and lng between -180 and 180",
)
def _(t: Tables):
    from ..functions import geo

    d = t.sql("select event_id, cast(value * 3 - 90 as string) as lat, case when event_id % 11 = 0 then 'north' else cast(value * 5 - 180 as string) end as lng from events")
    return d.where(geo.valid_coord("lng", "lat")).select("event_id")


@query(
    "distance_formats",
    f"""
with d as (select event_id, value * event_id as m from events)
select event_id, case when m * 3.28084e0 < 1000 then {q.thousands('floor(m * 3.28084e0 + 0.5e0)')} || ' ft' when m / 1609.344e0 < 10 then {q.fixed('m / 1609.344e0', 2)} || ' mi' else {q.fixed('m / 1609.344e0', 1)} || ' mi' end as imperial,
 case when m < 1000 then {q.thousands('floor(m + 0.5e0)')} || ' m' when m < 10000 then {q.fixed('m / 1000', 2)} || ' km' else {q.fixed('m / 1000', 1)} || ' km' end as metric from d
""",
)
def _(t: Tables):
    from ..functions import text

    d = t.sql("select event_id, value * event_id as m from events")
    return d.select("event_id", text.distance_text("m").alias("imperial"), text.metric_text("m").alias("metric"))
