"""Views derived from the given tables by key arithmetic.

The same text runs in Spark and DuckDB; where the two dialects differ a view has one text for each.
"""

from __future__ import annotations

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_PLACE = """
select 'part' as src, p_partkey as id, p_name as name, case p_partkey % 5 when 0 then 'locality' when 1 then 'water' when 2 then 'poi' when 3 then 'road' else 'area' end as kind, case p_partkey % 4 when 0 then 'town' when 1 then 'lake' when 2 then 'river' else 'hamlet' end as detail, cast((p_partkey * 37) % 5000 as bigint) as pop, -124.0e0 + ((p_partkey * 7919) % 100003) / 100003.0e0 * 7.0e0 as lng, 42.0e0 + ((p_partkey * 104729) % 100019) / 100019.0e0 * 4.0e0 as lat from part
union all
select 'supplier', s_suppkey, s_name, 'locality', case s_suppkey % 4 when 0 then 'city' when 1 then 'town' when 2 then 'village' else 'hamlet' end, cast(floor(abs(s_acctbal)) as bigint), -124.0e0 + ((s_suppkey * 15485863) % 100003) / 100003.0e0 * 7.0e0, 42.0e0 + ((s_suppkey * 32452843) % 100019) / 100019.0e0 * 4.0e0 from supplier
"""

VIEWS: dict[str, str | dict[str, str]] = {
    "v_place_raw": _PLACE,
    "v_place": "select case when src = 'part' then id * 2 else id * 2 + 1 end as place_id, src, id, name, kind, detail, pop, lng, lat from v_place_raw",
    "v_fix": "select user_id as node, event_id as fix_id, ts, -121.0e0 + (user_id % 50) * 0.02e0 + floor(value) % 100 * 0.0001e0 as lng, 44.0e0 + (user_id % 40) * 0.02e0 + floor(value * 10) % 100 * 0.0001e0 as lat, case when event_type = 'error' then null else value end as altitude, 5.0e0 + event_id % 60 as accuracy, event_type from events",
    "v_area": "select n_nationkey as area_id, case n_regionkey when 0 then 'nature_reserve' when 1 then 'forest' when 2 then 'park' when 3 then 'military' else 'wetland' end as kind, -124.0e0 + (n_nationkey % 5) * 1.4e0 as west, 42.0e0 + floor(n_nationkey / 5.0e0) * 0.8e0 as south, -124.0e0 + (n_nationkey % 5) * 1.4e0 + 1.6e0 as east, 42.0e0 + floor(n_nationkey / 5.0e0) * 0.8e0 + 1.0e0 as north from nation",
    # many small boxes, one per part, so that area joins grow with the data
    "v_plot": "select id as area_id, case id % 9 when 0 then 'nature_reserve' when 1 then 'forest' when 2 then 'park' when 3 then 'military' when 4 then 'wetland' when 5 then 'national_park' when 6 then 'protected_area' when 7 then 'wood' else 'meadow' end as kind, lng as west, lat as south, lng + 0.02e0 + (id % 7) * 0.02e0 as east, lat + 0.02e0 + (id % 5) * 0.02e0 as north from v_place where src = 'part'",
    "v_land": "select p_partkey as area_id, case p_partkey % 9 when 0 then 'national_park' when 1 then 'forest' when 2 then 'park' when 3 then 'military' when 4 then 'protected_area' when 5 then 'nature_reserve' when 6 then 'wood' when 7 then 'meadow' else 'AIRFIELD' end as kind, case p_partkey % 14 when 0 then p_name || ' Wilderness' when 1 then p_name || ' National Wildlife Refuge' when 2 then p_name || ' National Forest' when 3 then p_name || ' National Historic Site' when 4 then p_name || ' National Recreation Area' when 5 then p_name || ' National Monument' when 6 then p_name || ' State Park' when 7 then p_name || ' State Forest' when 8 then 'BLM ' || p_name when 9 then p_name || ' County Park' when 10 then p_name || ' park' when 11 then '' when 12 then ' ' || p_name || ' ' else 'National ' || p_name || ' park' end as name from part",
    "v_label": "select l.area_id as label_id, l.name, l.kind, p.lng + 0.01e0 as lng, p.lat + 0.01e0 as lat from v_land l join v_place p on p.src = 'part' and p.id = l.area_id where trim(l.name) <> ''",
    "v_road": "select o_orderkey as seg_id, case substring(o_orderpriority, 1, 1) when '1' then 'major_road' when '2' then 'minor_road' when '3' then 'minor_road' when '4' then 'path' else 'rail' end as kind, case when substring(o_orderpriority, 1, 1) = '4' then 'track' else 'residential' end as detail, o_orderpriority as name, o_orderstatus = 'F' as oneway, -121.5e0 + (o_custkey % 40) * 0.01e0 as lng1, 44.0e0 + floor(o_custkey / 40.0e0) * 0.01e0 as lat1, -121.5e0 + (o_custkey % 40 + case when o_orderkey % 2 = 0 then 1 else 0 end) * 0.01e0 as lng2, 44.0e0 + (floor(o_custkey / 40.0e0) + case when o_orderkey % 2 = 0 then 0 else 1 end) * 0.01e0 as lat2 from orders",
    # 8 x 8 tiles laid on zoom-12 tile numbers under the routes and fixes; relief in metres
    "v_dem": {
        "spark": "select 12 as z, 655 + vec_id % 25 as x, 1475 + cast(floor(vec_id / 25.0e0) as bigint) as y, 8 as width, transform(embedding, (v, i) -> case when (i + vec_id) % 29 = 0 then null else cast(v as double) * 2000.0e0 end) as data from embeddings",
        "duck": "select 12 as z, 655 + vec_id % 25 as x, 1475 + cast(floor(vec_id / 25.0e0) as bigint) as y, 8 as width, list_transform(embedding, lambda v, i: case when (i - 1 + vec_id) % 29 = 0 then null else cast(v as double) * 2000.0e0 end) as data from embeddings",
    },
    "v_route": "select user_id as route_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as seq, -121.5e0 + ((event_id * 7) % 400) * 0.001e0 as lng, 44.0e0 + ((event_id * 3) % 400) * 0.001e0 as lat from events",
    # short hops along a line, so that sampling keeps a moderate number of points
    "v_path": "select user_id as route_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as seq, -121.5e0 + (user_id % 300) * 0.001e0 + (row_number() over (partition by user_id order by event_id)) * 0.0017e0 as lng, 44.0e0 + (user_id % 300) * 0.0011e0 + (event_id % 3) * 0.0009e0 as lat from events",
    "v_mvum": "select k as mvum_id, cast(1 + k % 12 as string) as symbol, 'FR ' || cast(k % 400 as string) as name, case when l_returnflag = 'A' then 'Seasonal' when l_returnflag = 'N' then ' ' else null end as seasonal, case when l_linestatus = 'F' then 'open' when l_linestatus = 'O' then ' ' else null end as passengervehicle, case when k % 3 = 0 then '06/01-10/15' when k % 3 = 1 then '01/01-12/31' else '13/01-02/02' end as dates, -121.5e0 + ((k * 7) % 400) * 0.001e0 as lng1, 44.0e0 + ((k * 3) % 400) * 0.001e0 as lat1, -121.5e0 + ((k * 7) % 400 + 6) * 0.001e0 as lng2, 44.0e0 + ((k * 3) % 400 + 4) * 0.001e0 as lat2 from (select *, l_orderkey * 8 + l_linenumber as k from lineitem) as l",
    "v_mesh": "select user_id as num, event_id as arrival, case when event_type in ('signup', 'error') then null else -121.0e0 + (user_id % 50) * 0.02e0 + event_id % 97 * 0.0001e0 end as lng, case when event_type in ('signup', 'error') then null else 44.0e0 + (user_id % 40) * 0.02e0 + event_id % 89 * 0.0001e0 end as lat, cast(1704067200 + event_id * 60 - (event_id * 37) % 9000 as bigint) as pos_time, case when event_type = 'signup' then 'node ' || cast(event_id % 7 as string) else null end as long_name, case when event_id % 3 = 0 then cast(event_id % 120 as int) else null end as battery, 10 + event_id % 23 as precision_bits, cast(1704067200 + event_id * 60 as bigint) as last_heard from events",
    "v_pin": "select c_custkey as pin_id, lower(c_mktsegment) || ' ' || cast(c_custkey % 90 as string) as name, case when c_custkey % 4 = 0 then 'water near camp' else null end as note, cast(1700000000 + c_custkey * 3600 as bigint) as t, -124.0e0 + ((c_custkey * 7907) % 100003) / 100003.0e0 * 7.0e0 as lng, 42.0e0 + ((c_custkey * 104723) % 100019) / 100019.0e0 * 4.0e0 as lat, c_custkey % 25 as owner from customer",
    # one asker per customer, and one viewer per owner
    "v_query": "select cast(c_custkey as bigint) as query_id, case c_custkey % 6 when 0 then 'widget' when 1 then 'bolt' when 2 then 'Sm' when 3 then 'ring' when 4 then 'supplier#0000000' else '44.' || cast(c_custkey % 25 as string) || ', -121.3' end as text, -124.0e0 + ((c_custkey * 7919) % 100003) / 100003.0e0 * 7.0e0 as lng, 42.0e0 + ((c_custkey * 104729) % 100019) / 100019.0e0 * 4.0e0 as lat, cast(c_custkey % 25 as bigint) as owner from customer",
    "v_viewer": "select cast(n_nationkey as bigint) as query_id, case n_nationkey % 6 when 0 then 'widget' when 1 then 'bolt' when 2 then 'Sm' when 3 then 'ring' when 4 then 'supplier#0000000' else '44.' || cast(n_nationkey as string) || ', -121.3' end as text, -124.0e0 + n_nationkey * 0.25e0 as lng, 42.0e0 + n_nationkey * 0.15e0 as lat, cast(n_nationkey as bigint) as owner from nation",
    "v_find": "select query_id, case query_id % 8 when 0 then 'household' when 1 then 'water' when 7 then ' ' else text end as text, lng, lat, owner from v_query",
    "v_region": "select r_regionkey as region_id, substring(r_name, 1, 2) as abbr, -124.0e0 + r_regionkey * 1.4e0 as west, 42.0e0 + r_regionkey * 0.5e0 as south, -122.4e0 + r_regionkey * 1.4e0 as east, 43.5e0 + r_regionkey * 0.5e0 as north, case when r_regionkey % 2 = 0 then 12 else null end as maxzoom from region",
    # one catalogue row per supplier, so that catalogue jobs grow with the data
    "v_catalog": "select s_suppkey as ordinal, 'P' || cast(s_suppkey as string) as abbr, s_name as name, -124.0e0 + (s_suppkey % 20) * 0.3e0 as west, 42.0e0 + (s_suppkey % 9) * 0.4e0 as south, -124.0e0 + (s_suppkey % 20) * 0.3e0 + 0.1e0 + (s_suppkey % 4) * 0.2e0 as east, 42.0e0 + (s_suppkey % 9) * 0.4e0 + 0.1e0 + (s_suppkey % 3) * 0.2e0 as north, case when s_suppkey % 3 = 0 then 12 when s_suppkey % 3 = 1 then 14 else null end as maxzoom from supplier",
    "v_pack": "select s_suppkey as pack_id, cast(s_nationkey as bigint) as device_id, 'P' || cast(s_suppkey as string) as abbr, cast(floor(abs(s_acctbal) * 100000) as bigint) as bytes, cast(case when s_suppkey % 9 = 0 then 0 else 1700000000 - s_suppkey * 700000 end as bigint) as modified from supplier",
    "v_plant": "select p_partkey as plant_no, 'S' || cast(p_partkey as string) as symbol, p_name as common, case p_partkey % 5 when 0 then 'deadly' when 1 then 'toxic' when 2 then 'irritant' when 3 then 'edible-with-care' else 'edible' end as verdict, case when p_partkey % 17 = 0 then ' ' else p_type end as tell, p_brand as family, p_type || ' ' || p_name as scientific from part",
    "v_plant_pair": "select 'S' || cast(p_partkey as string) as symbol, case when p_partkey % 7 = 3 then null else 's' || cast(case when p_partkey % 2 = 0 then p_partkey + 1 when p_partkey % 11 = 1 then p_partkey + 50000000 else p_partkey - 1 end as string) end as other from part",
    "v_plant_state": "select l_partkey as plant_no, case l_suppkey % 6 when 0 then 'OR' when 1 then 'WA' when 2 then 'CA' when 3 then 'ID' when 4 then 'NV' else 'MT' end as state from lineitem",
    "v_profile": "select user_id as profile_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as seq, case when event_id % 5 = 0 or event_id % 31 < 4 then null else value end as elev from events",
    # tile features: two vertices each, every third one repeated in the next tile
    "v_feature": "select l_orderkey * 8 + l_linenumber as feature_id, case l_partkey % 6 when 0 then 'places' when 1 then 'pois' when 2 then 'water' when 3 then 'roads' when 4 then 'earth' else 'landuse' end as layer, case l_partkey % 11 when 0 then 'country' when 1 then 'administrative' when 2 then 'ferry' when 3 then 'locality' when 4 then 'lake' when 5 then 'river' else 'peak' end as kind, case l_suppkey % 3 when 0 then 'town' when 1 then 'village' else null end as kind_detail, case when l_linenumber = 7 then null else 'Feature ' || cast(l_partkey % 900 as string) end as name, case when l_partkey % 13 = 0 then 'English ' || cast(l_partkey % 900 as string) else null end as name_en, cast(l_quantity * 100 as bigint) as population, 12 as z, -124.0e0 + (l_partkey % 700) * 0.01e0 + l_linenumber * 0.0007e0 as lng, 42.0e0 + (l_suppkey % 90) * 0.04e0 + l_linenumber * 0.0003e0 as lat from lineitem",
}

VIEWS |= {
    # 90 harmonics whose values depend on the whole part table
    "v_coef": "select cast(case when i < 3 then 1 when i < 6 then 2 when i < 10 then 3 when i < 15 then 4 when i < 21 then 5 when i < 28 then 6 when i < 36 then 7 when i < 45 then 8 when i < 55 then 9 when i < 66 then 10 when i < 78 then 11 else 12 end as int) as n, cast(i - case when i < 3 then 1 when i < 6 then 3 when i < 10 then 6 when i < 15 then 10 when i < 21 then 15 when i < 28 then 21 when i < 36 then 28 when i < 45 then 36 when i < 55 then 45 when i < 66 then 55 when i < 78 then 66 else 78 end as int) as m, case when i = 1 then -29000.0e0 else ((i * 37) % 101 - 50) * 20.0e0 + sz end as g, case when i in (1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66, 78) then 0.0e0 else ((i * 53) % 89 - 44) * 25.0e0 - sz end as h, ((i * 7) % 19 - 9) * 1.5e0 as gdot, ((i * 5) % 17 - 8) * 1.1e0 as hdot from (select 1 + p_partkey % 90 as i, cast(max(p_size) as double) as sz from part group by 1 + p_partkey % 90)",
    "v_sheet": "select s_suppkey as sheet_id, -124.0e0 + (s_suppkey % 25) * 0.27e0 as west, 42.0e0 + (s_suppkey % 17) * 0.2e0 as south, -124.0e0 + (s_suppkey % 25) * 0.27e0 + 0.05e0 + (s_suppkey % 6) * 0.05e0 as east, 42.0e0 + (s_suppkey % 17) * 0.2e0 + 0.04e0 + (s_suppkey % 5) * 0.03e0 as north, 540.0e0 as width_pt, 720.0e0 as height_pt from supplier",
}

VIEWS |= {
    # rows of short streets with gaps of 16 m or 160 m between them
    "v_lane": "select c_custkey as seg_id, case c_custkey % 3 when 0 then 'minor_road' else 'major_road' end as kind, 'residential' as detail, c_name as name, c_custkey % 5 = 0 as oneway, -121.5e0 + (c_custkey % 200) * 0.003e0 as lng1, 44.0e0 + floor(c_custkey / 200.0e0) * 0.004e0 as lat1, -121.5e0 + (c_custkey % 200) * 0.003e0 + case when c_custkey % 7 = 0 then 0.001e0 else 0.0028e0 end as lng2, 44.0e0 + floor(c_custkey / 200.0e0) * 0.004e0 as lat2 from customer",
    "v_od": "select s_suppkey as od_id, -121.5e0 + ((s_suppkey * 7) % 36) * 0.01e0 + 0.0011e0 as lng1, 44.0e0 + ((s_suppkey * 3) % n) * 0.01e0 + 0.0007e0 as lat1, -121.5e0 + ((s_suppkey * 7) % 36 + s_suppkey % 4) * 0.01e0 - 0.0009e0 as lng2, 44.0e0 + (((s_suppkey * 3) % n + s_suppkey % 9) % n) * 0.01e0 + 0.0005e0 as lat2 from supplier, (select greatest(cast(floor(count(*) / 40.0e0) as bigint), 1) as n from customer)",
}
