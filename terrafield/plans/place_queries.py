"""Place index and searches over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import places, rules, spatial
from ..operators import rule_values as V
from . import sqlgen as q
from .path_queries import r3, r6
from .registry import Tables, query
from .spatial_queries import _TOWN_RANK


def features(t: Tables):
    """Fixture features with geometry and tile numbers."""
    pt = lambda dx, dy: F.struct((F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
    return t.view("v_feature").withColumn("parts", F.array(F.array(pt(0.0, 0.0), pt(0.01, 0.005)), F.array(pt(0.02, 0.0)))).withColumn(
        "x", F.floor((F.col("lng") + 180.0) / 360.0 * 4096)).withColumn("y", F.floor((90.0 - F.col("lat")) * 16)).drop("lng", "lat")


_BUCKET = q.case_map("layer", {r[0]: r[1] for r in V.HARVEST_RULES if r[1]})
_GRID = q.case_map("layer", {r[0]: r[3] for r in V.HARVEST_RULES})
_RULES = f"""
ruled as (select *, coalesce(name_en, name) as nm, {_BUCKET} as bucket, {_GRID} as grid from v_feature
 where coalesce(name_en, name) is not null and not (layer = 'places' and kind = 'country') and not (layer = 'pois' and kind = 'administrative')
  and not (layer = 'roads' and kind = 'ferry') and not (layer = 'landuse' and kind = 'administrative'))
"""
_HARVEST = _RULES + """,
mid as (select *, (lng + (lng + 0.01e0) + (lng + 0.02e0)) / 3 as ml, (lat + (lat + 0.005e0) + (lat + 0.0e0)) / 3 as ma,
  cast(floor((lng + 180.0e0) / 360.0e0 * 4096) as bigint) as x, cast(floor((90.0e0 - lat) * 16) as bigint) as y from ruled),
hv as (select arg_min(feature_id, (x, y, feature_id)) as place_id, nm as name, arg_min(coalesce(bucket, kind), (x, y, feature_id)) as kind,
  arg_min(case when bucket is null then coalesce(kind_detail, '') else kind end, (x, y, feature_id)) as detail,
  arg_min(coalesce(population, 0), (x, y, feature_id)) as pop, sum(ml * 3) / sum(3) as lng, sum(ma * 3) / sum(3) as lat, lower(nm) as folded
  from mid group by layer, nm, mid.kind, floor(ml * grid + 0.5e0), floor(ma * grid + 0.5e0))
"""


@query("f4_harvest_rules", f"with {_RULES} select feature_id, nm as name, kind, bucket, cast(grid as int) as grid from ruled")
def _(t: Tables):
    return places.harvest_rules(t.view("v_feature")).select("feature_id", "name", "kind", "bucket", "grid")


@query("a1_harvest_places", f"with {_HARVEST} select place_id, name, kind, detail, pop, round(lng, 6) as lng, round(lat, 6) as lat, folded from hv")
def _(t: Tables):
    return places.harvest_places(features(t)).withColumn("lng", F.round("lng", 6)).withColumn("lat", F.round("lat", 6))


_REACH = "(case when kind in ('road','mvum') then 120.0e0 when kind = 'water' and detail in ('river','canal','stream') then 60.0e0 else 10.0e0 end) * 1609.344e0"


@query(
    "a2_merge_duplicates",
    f"""
with recursive base as (select *, lower(name) as folded, {q.case_map('kind', V.KIND_RANK, '9')} as rk, {_REACH} as reach from v_place),
one as (select folded, rk, reach, kind, detail, pop, lng, lat, min(place_id) as place_id from base group by all),
ord as (select *, row_number() over (partition by folded order by rk, -pop, lng, lat, place_id) as i from one),
walk as (select folded, i, [(lng, lat)] as kept, reach, true as keep, place_id from ord where i = 1
 union all select o.folded, o.i,
  case when list_min(list_transform(w.kept, lambda k: {q.hav('k[1]', 'k[2]', 'o.lng', 'o.lat')})) < greatest(w.reach, o.reach) then w.kept else list_append(w.kept, (o.lng, o.lat)) end,
  case when list_min(list_transform(w.kept, lambda k: {q.hav('k[1]', 'k[2]', 'o.lng', 'o.lat')})) < greatest(w.reach, o.reach) then w.reach else greatest(w.reach, o.reach) end,
  not (list_min(list_transform(w.kept, lambda k: {q.hav('k[1]', 'k[2]', 'o.lng', 'o.lat')})) < greatest(w.reach, o.reach)), o.place_id
  from walk w join ord o on o.folded = w.folded and o.i = w.i + 1)
select p.place_id, p.name, p.kind, p.detail, p.pop from walk w join v_place p on p.place_id = w.place_id where w.keep
""",
)
def _(t: Tables):
    p = t.view("v_place").withColumn("folded", text.fold("name"))
    return places.merge_duplicates(p).select("place_id", "name", "kind", "detail", "pop")


_MV_NAMES = """case mvum_id % 6 when 0 then 'CHINA HAT RD' when 1 then ' dog MTN. th ' when 2 then 'B.P.A 12' when 3 then '4600-471 spur' when 4 then 'c.g road' else '' end"""


@query(
    "r9_mvum_places",
    f"""
select distinct mvum_id as place_id, {q.case_map('mvum_id % 6', {0: 'China Hat Rd', 1: 'Dog Mtn. Th', 2: 'B.p.a 12', 3: '4600-471 Spur', 4: 'C.G Road'})} as name,
 round(lng2, 6) as lng, round(lat2, 6) as lat from v_mvum m where mvum_id % 6 <> 5 and exists (select 1 from v_catalog r where
  m.lng2 between r.west - 0.05e0 and r.east + 0.05e0 and m.lat2 between r.south - 0.05e0 and r.north + 0.05e0)
""".replace("'B.p.a 12'", "'B.P.A 12'"),
)
def _(t: Tables):
    pt = lambda n: F.struct(F.col(f"lng{n}").alias("lng"), F.col(f"lat{n}").alias("lat"))
    m = t.view("v_mvum").withColumn("name", F.expr(_MV_NAMES)).withColumn("parts", F.array(F.array(pt(1)), F.array(pt(1), pt(2))))
    return places.mvum_places(m, t.view("v_catalog")).select("place_id", "name", r6("lng"), r6("lat"))


_POS = lambda hay, needle, a, b, c: (
    f"(case when instr({hay}, {needle}) = 0 then 0 when instr({hay}, {needle}) = 1 then {a} when substring({hay}, instr({hay}, {needle}) - 1, 1) = ' ' then {b} else {c} end)"
)
_K1 = f"""
k1 as (select q.query_id, p.*, {q.hav('q.lng','q.lat','p.lng','p.lat')} as dist_m, lower(trim(q.text)) as needle, q.lng as ql, q.lat as qa from v_place p join v_find q
  on trim(q.text) <> '' and instr(lower(p.name), lower(trim(q.text))) > 0 and not regexp_matches(trim(q.text), '^-?\\d+(?:\\.\\d+)?\\s*[,\\s]\\s*-?\\d+(?:\\.\\d+)?$')),
s1 as (select *, {_POS('lower(name)', 'needle', 2, 1, 0)} * 1e6 + case when pop > 0 then log10(pop + 1.0e0) else 0 end - 8 * log10(dist_m / 1609.344e0 + 1) - length(name) * 0.01e0 as score from k1),
t1 as (select *, row_number() over (partition by query_id order by score desc, place_id) as rank from s1)
"""


@query("k1_rank_places", f"with {_K1} select query_id, place_id, cast(rank as int) as rank, round(score, 6) as score from t1 where rank <= 20")
def _(t: Tables):
    typed = places.parse_query_coord(t.view("v_find")).where("c_lat is null and trim(text) <> ''")
    return places.rank_places(typed, t.view("v_place")).select("query_id", "place_id", "rank", r6("score"))


_K2 = f"""
k2 as (select q.query_id, p.pin_id, p.name, {_POS('lower(p.name)', 'lower(trim(q.text))', 3, 2, 1)} * 1e14 + p.t as score, p.owner = q.owner as own from v_pin p join v_find q
  on trim(q.text) <> '' and (instr(lower(p.name), lower(trim(q.text))) > 0 or instr(coalesce(p.note, ''), lower(trim(q.text))) > 0)),
"""


@query(
    "k2_rank_pins",
    f"with {_K2} t2 as (select *, row_number() over (partition by query_id order by score desc, pin_id) as rank from k2) select query_id, pin_id, cast(rank as int) as rank from t2 where rank <= 8",
)
def _(t: Tables):
    return places.rank_pins(t.view("v_find"), t.view("v_pin")).select("query_id", "pin_id", "rank")


_LABELLED = lambda c: (
    f"case when kind = 'locality' then {q.case_map(c, V.KIND_LABELS, c)} else {q.case_map(c, V.KIND_LABELS, c)} end"
)


@query(
    "k5_find",
    f"""
with {_K1}, {_K2}
t2 as (select *, row_number() over (partition by query_id order by score desc, pin_id) as rank from k2 where own),
tw as (select p.place_id, t.place_id as tid, t.name as town, {q.hav('p.lng','p.lat','t.lng','t.lat')} as m, {_TOWN_RANK} as r from v_place p join v_place t on t.kind = 'locality' and {_TOWN_RANK} is not null
  and p.kind <> 'locality' and abs(t.lat - p.lat) <= 0.6e0 and abs(t.lng - p.lng) <= 0.8e0),
tb as (select place_id, town from (select *, row_number() over (partition by place_id order by m / (1 + 2 * r), tid) as rn from tw where m <= 40 * 1609.344e0) where rn = 1)
select query_id, 'coordinate' as section, 1 as rank, cast(null as bigint) as item_id, printf('%.5f', cast(regexp_extract(text, '^(-?[\\d.]+)', 1) as double)) || ', ' || printf('%.5f', cast(regexp_extract(text, '(-?[\\d.]+)$', 1) as double)) as name,
  'grid ref' as label, cast(null as double) as dist_m, cast(null as varchar) as direction, cast(null as varchar) as town
 from v_find where regexp_matches(trim(text), '^-?\\d+(?:\\.\\d+)?\\s*[,\\s]\\s*-?\\d+(?:\\.\\d+)?$')
union all select query_id, 'pin', cast(rank as int), pin_id, name, 'your pin', null, null, null from t2 where rank <= 8
union all select q.query_id, 'recent', null, p.pin_id, p.name, 'your pin', null, null, null from v_find q join v_pin p on p.owner = q.owner where trim(q.text) = ''
union all select query_id, 'place', cast(rank as int), t1.place_id, name, {_LABELLED('detail')}, round(dist_m, 3), {q.cardinal(q.bearing('ql','qa','lng','lat'))}, tb.town
 from t1 left join tb on t1.place_id = tb.place_id where rank <= 20
""",
)
def _(t: Tables):
    d = places.find(t.view("v_find"), t.view("v_place"), t.view("v_pin"), "owner")
    return d.withColumn("dist_m", F.round("dist_m", 3))


@query(
    "f9_parse_query_coord",
    """
select query_id, cast(nullif(regexp_extract(text, '^(-?\\d+(?:\\.\\d+)?)\\s*[,\\s]\\s*(-?\\d+(?:\\.\\d+)?)$', 1), '') as double) as c_lat,
 cast(nullif(regexp_extract(text, '^(-?\\d+(?:\\.\\d+)?)\\s*[,\\s]\\s*(-?\\d+(?:\\.\\d+)?)$', 2), '') as double) as c_lng from v_query
""",
)
def _(t: Tables):
    return places.parse_query_coord(t.view("v_query")).select("query_id", "c_lat", "c_lng")


K6_QUERIES = [(1, "the"), (2, "LICENSE"), (3, "è ouè"), (4, ""), (5, "wiki")]


@query(
    "k6_search_documents",
    """
select q.id as query_id, d.doc_id from documents d join (values (1, 'the'), (2, 'license'), (3, 'è ouè'), (4, ''), (5, 'wiki')) q(id, t)
 on q.t = '' or contains(lower(regexp_replace(d.text, '<[^>]*>', '', 'g')), q.t) or contains(lower(d.source), q.t)
""".replace("q.id as query_id", "cast(q.id as bigint) as query_id"),
)
def _(t: Tables):
    docs = t.table("documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return places.search_documents(docs, K6_QUERIES).select("query_id", "doc_id")


@query(
    "k6_search_pages",
    """
select cast(q.id as bigint) as query_id, p.page_id from pages p join (values (1, 'licen'), (2, 'ing'), (3, 'href')) q(id, t)
 on contains(lower(regexp_replace(p.html, '<[^>]*>', '', 'g')), q.t) or contains(lower(p.url), q.t)
""",
)
def _(t: Tables):
    docs = t.table("pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("body"))
    return places.search_documents(docs, [(1, "licen"), (2, "ing"), (3, "href")]).select("query_id", "page_id")


@query(
    "fold_text",
    "select doc_id, md5(strip_accents(lower(regexp_replace(text, '[\\^`¨¯´·¸]', '', 'g')))) as folded_md5 from documents",
)
def _(t: Tables):
    return t.table("documents").select("doc_id", F.md5(text.fold("text")).alias("folded_md5"))


@query(
    "k7_search_regions",
    """
with q as (select query_id, case query_id % 5 when 0 then '' when 1 then 'p1' when 2 then '#00000000' when 3 then 'SUPPLIER' else 'zz' end as text from v_query),
got as (select case when pack_id % 3 = 0 then abbr else 'old ' || abbr end as abbr, max(modified) as modified from v_pack group by 1)
select q.query_id, r.ordinal, r.abbr, g.modified is not null as installed, g.modified from q join v_catalog r on contains(lower(r.name), lower(q.text)) or contains(lower(r.abbr), lower(q.text))
 left join got g on g.abbr = r.abbr
""",
)
def _(t: Tables):
    qs = t.sql("select query_id, case query_id % 5 when 0 then '' when 1 then 'p1' when 2 then '#00000000' when 3 then 'SUPPLIER' else 'zz' end as text from v_query")
    d = places.search_regions(qs, t.view("v_catalog"), t.view("v_pack").withColumn("abbr", F.expr("case when pack_id % 3 = 0 then abbr else 'old ' || abbr end")))
    return d.select("query_id", "ordinal", "abbr", "installed", "modified")


@query(
    "k3_sort_nodes",
    f"""
select m.num, m.arrival, m.lng is not null as positioned, round({q.hav('v.lng','v.lat','m.lng','m.lat')}, 3) as dist_m, m.last_heard
 from (select *, num % 20 as owner from v_mesh) m left join (select owner, case when owner < 15 then lng end as lng, case when owner < 15 then lat end as lat from v_viewer) v on m.owner = v.owner
""",
)
def _(t: Tables):
    nodes = t.view("v_mesh").withColumn("owner", F.col("num") % 20)
    d = places.sort_nodes(nodes, t.view("v_viewer").withColumns({c: F.when(F.col("owner") < 15, F.col(c)) for c in ("lng", "lat")}), "owner")
    return d.select("num", "arrival", "positioned", r3("dist_m"), "last_heard")


@query(
    "k9_nearest_pins",
    f"""
with d as (select v.query_id as point_id, p.pin_id, {q.hav('v.lng','v.lat','p.lng','p.lat')} as m from v_query v join v_pin p on p.owner = v.owner),
r as (select *, row_number() over (partition by point_id order by m, pin_id) as rank from d)
select point_id, pin_id, round(m, 3) as dist_m, cast(rank as int) as rank from r where rank <= 12
""",
)
def _(t: Tables):
    pts = t.view("v_query").withColumnRenamed("query_id", "point_id")
    return places.nearest_pins(pts, t.view("v_pin"), "owner", 12).select("point_id", "pin_id", r3("dist_m"), "rank")


_NAMED = "select place_id, case place_id % 12 when 0 then name || ' Lake' when 1 then 'Mt. ' || name when 2 then name || ' trail head' when 3 then name || ' Springs' when 4 then 'Lake ' || name when 5 then name || ' lava flow' when 6 then name || 'lake' when 7 then 'camp' else name end as name, case place_id % 7 when 0 then '' when 1 then 'region' when 2 then 'mvum' when 3 then 'county' else kind end as kind, case place_id % 10 when 0 then 'water' when 1 then 'camp_site' when 2 then 'bare_rock' when 3 then '' when 4 then 'odd_kind_x' when 5 then 'isolated_dwelling' when 6 then 'parking' else detail end as detail from v_place"


def label_sql() -> str:
    ends = lambda ws: "regexp_matches(' ' || lower(name), ' (?:" + "|".join(w.replace(".", "\\.") for w in ws) + ")$')"
    starts = lambda ws: " or regexp_matches(lower(name), '^(?:" + "|".join(w.replace(".", "\\.") for w in ws) + ") ')" if ws else ""
    named = "case " + " ".join(f"when {ends(e)}{starts(s)} then {q.lit(label)}" for label, e, s in V.NAME_LABELS) + " else '' end"
    known = q.case_map("detail", V.KIND_LABELS)
    plain = "case when detail <> '' then replace(detail, '_', ' ') end"
    return (
        f"case when kind = 'region' then 'state' when kind = 'county' then 'county' when kind in ('locality', 'neighbourhood', '') then coalesce({known}, {plain}, 'place') "
        f"when kind = 'mvum' then 'forest road' when detail in {q.in_list(V.VAGUE_KINDS)} and ({named}) <> '' then ({named}) else coalesce({known}, {plain}, nullif(({named}), ''), 'place') end"
    )


@query("r8_place_label", f"select place_id, {label_sql()} as label from ({_NAMED})")
def _(t: Tables):
    return t.sql(_NAMED).select("place_id", rules.place_label("name", "kind", "detail").alias("label"))


_WATER_NAMED = "select place_id, case place_id % 8 when 0 then name || ' Reservoir' when 1 then name || ' Creek' when 2 then name || ' Bayou' when 3 then name || ' ditch' when 4 then 'Creekside ' || name else name end as name, case place_id % 5 when 0 then 'river' when 1 then 'stream' when 2 then 'canal' when 3 then 'reservoir' else 'water' end as kind from v_place"


@query(
    "r8_water_label",
    f"""
select place_id, case when kind = 'river' then 'river' when kind = 'stream' then 'creek' when kind = 'canal' then 'canal' when kind = 'reservoir' or regexp_matches(lower(name), '\\breservoir\\b') then 'reservoir'
 when regexp_matches(lower(name), '\\bcreek\\b') then 'creek' when regexp_matches(lower(name), '\\briver\\b|\\bslough\\b|\\bbayou\\b') then 'river' when regexp_matches(lower(name), '\\bcanal\\b|\\bditch\\b') then 'canal' else 'lake' end as label from ({_WATER_NAMED})
""",
)
def _(t: Tables):
    return t.sql(_WATER_NAMED).select("place_id", spatial.water_label("name", "kind").alias("label"))
