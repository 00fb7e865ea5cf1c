"""Catalogues, inventories and data-quality reports over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..operators import rule_values as V
from ..sources import clean
from . import sqlgen as q
from .registry import Tables, query

NOW = 1700000000


@query(
    "s12_pending_tiles",
    "select o_orderkey % 13 as z, o_orderkey as x, o_custkey as y from orders o where not exists (select 1 from lineitem l where l.l_linenumber = 3 and l.l_orderkey = o.o_orderkey)",
)
def _(t: Tables):
    wanted = t.sql("select o_orderkey % 13 as z, o_orderkey as x, o_custkey as y from orders")
    present = t.sql("select o_orderkey % 13 as z, o_orderkey + case when l_linenumber = 3 then 0 else 1000000000 end as x, o_custkey as y from orders o join lineitem l on l.l_orderkey = o.o_orderkey")
    return quality.pending_tiles(wanted, present)


_FILES = "select case p_partkey % 5 when 0 then '/data/states/R' || cast(p_partkey // 10 as string) || '.pmtiles' when 1 then '/data/dem/R' || cast(p_partkey // 10 as string) || '/12/' || cast(p_partkey as string) || '.png' when 2 then '/data/mvum/R' || cast(p_partkey // 10 as string) || '.geojson' when 3 then '/data/dem/R' || cast(p_partkey // 20 as string) || '/13/' || cast(p_partkey as string) || '.png' else '/data/states/readme.txt' end as path, cast(p_size * 1000 as bigint) as length, cast(1700000000 + p_partkey as bigint) as modified from part"


@query(
    "s13_pack_inventory",
    f"""
with f as ({_FILES}),
k as (select *, case when path like '/data/dem/%' then 'dem' when path like '/data/mvum/%' then 'mvum' when path like '%.pmtiles' then 'map' end as kind,
 case when path like '/data/dem/%' then split_part(path, '/', 4) else split_part(split_part(path, '/', 4), '.', 1) end as abbr from f)
select abbr, cast(coalesce(sum(length) filter (kind = 'map'), 0) as bigint) as bytes, max(modified) filter (kind = 'map') as modified, cast(coalesce(sum(length) filter (kind = 'dem'), 0) as bigint) as dem_bytes,
 cast(coalesce(sum(length) filter (kind = 'mvum'), 0) as bigint) as mvum_bytes from k where kind is not null group by 1 having count(*) filter (kind = 'map') > 0
""",
)
def _(t: Tables):
    return quality.pack_inventory(t.sql(_FILES.replace("p_partkey // ", "p_partkey div ")))


@query(
    "s14_pack_audit",
    """
select doc_id, case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 1 then 'wrong size' when doc_id % 7 = 2 then 'wrong hash' else 'ok' end as status, case when doc_id % 5 <> 0 then cast(octet_length(encode(text)) as bigint) end as got_bytes,
 case when doc_id % 7 = 2 then sha256(text || 'x') else sha256(text) end as sha256 from documents
""",
)
def _(t: Tables):
    docs = t.table("documents").withColumn("abbr", F.col("doc_id").cast("string")).withColumn("content", F.encode("text", "UTF-8"))
    odd = F.col("doc_id") % 7
    manifest = docs.select(
        "abbr", "doc_id", (F.length("content") + F.when(odd == 1, 1).otherwise(0)).cast("bigint").alias("bytes"),
        F.sha2(F.when(odd == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    return quality.pack_audit(docs.where("doc_id % 5 <> 0"), manifest).select("doc_id", "status", "got_bytes", "sha256")


@query(
    "j13_pack_for",
    """
with req as (select o_orderkey as request_id, case o_orderkey % 3 when 0 then 'p' when 1 then 'P' else 'X' end || cast(o_custkey % 300 as varchar) as want_abbr, cast(11 + o_orderkey % 6 as int) as want_zoom from orders),
man as (select p.pack_id, case when p.pack_id % 10 = 3 then lower(p.abbr) else p.abbr end as abbr, coalesce(c.maxzoom, 15) as maxzoom from v_pack p join v_catalog c on c.abbr = p.abbr),
j as (select r.*, coalesce(e.pack_id, u.pack_id) as pid, coalesce(e.maxzoom, u.maxzoom) as mz from req r left join man e on e.abbr = r.want_abbr left join man u on u.abbr = upper(r.want_abbr))
select request_id, want_abbr, want_zoom, case when mz >= want_zoom then pid end as pack_id, cast(case when mz >= want_zoom then mz end as int) as maxzoom from j
""",
)
def _(t: Tables):
    req = t.sql("select o_orderkey as request_id, case o_orderkey % 3 when 0 then 'p' when 1 then 'P' else 'X' end || cast(o_custkey % 300 as string) as want_abbr, cast(11 + o_orderkey % 6 as int) as want_zoom from orders")
    man = t.sql("select p.pack_id, case when p.pack_id % 10 = 3 then lower(p.abbr) else p.abbr end as abbr, c.maxzoom from v_pack p join v_catalog c on c.abbr = p.abbr")
    return quality.pack_for(req, man)


def _age(days):
    return (f"case when {days} < 1 then 'today' when {days} = 1 then 'yesterday' when {days} < 60 then {days}::varchar || ' days ago' when {days} < 730 then cast(floor({days} / 30.0e0 + 0.5e0) as bigint)::varchar || ' months ago'"
            f" else printf('%.1f', {days} / 365.0e0) || ' years ago' end")


@query(
    "a7_readiness",
    f"""
with p as (select device_id, count(*) as packs, sum(bytes) as bytes, min(modified) filter (modified > 0) as oldest, arg_min(abbr, (modified, abbr)) filter (modified > 0) as oldest_abbr, count(*) filter (modified = 0) as undated from v_pack group by 1),
m as (select (case when c_nationkey % 4 = 0 then c_nationkey + 1000 else c_nationkey end)::bigint as device_id, count(*) filter (c_custkey % 3 > 0) as pins, count(*) filter (c_custkey % 3 = 0) as tracks from customer group by 1),
d as (select coalesce(p.device_id, m.device_id) as device_id, coalesce(packs, 0) as packs, bytes, oldest, oldest_abbr, coalesce(undated, 0) as undated, coalesce(pins, 0) as pins, coalesce(tracks, 0) as tracks,
  case when coalesce(p.device_id, m.device_id) >= 1000 or coalesce(p.device_id, m.device_id) % 3 = 0 then null else {NOW} - coalesce(p.device_id, m.device_id) * 86400 * 12 end as backup_at from p full join m on p.device_id = m.device_id),
e as (select *, ({NOW} - oldest) // 86400 as od, ({NOW} - backup_at) // 86400 as bd, bytes::double as b from d)
select device_id, 'Map packs' as "check", case when packs > 0 then 'ok' else 'bad' end as level, case when packs > 0 then packs::varchar || ' downloaded (' || case when b >= 1e9 then printf('%.1f', b / 1e9) || ' GB' when b >= 1e6 then cast(floor(b / 1e6 + 0.5e0) as bigint)::varchar || ' MB' else greatest(1, cast(floor(b / 1e3 + 0.5e0) as bigint))::varchar || ' KB' end || ')' else 'None downloaded' end as detail from e
union all select device_id, 'Pack freshness', case when oldest is null then 'warn' when {NOW} - oldest > 730 * 86400 then 'bad' when {NOW} - oldest > 365 * 86400 then 'warn' else 'ok' end,
 case when oldest is null then 'Unknown.' else 'Oldest pack (' || upper(oldest_abbr) || ') downloaded ' || {_age('od')} || '.' end from e where packs > 0
union all select device_id, 'Pack age unknown', 'warn', undated::varchar || ' undated' from e where packs > 0 and oldest is not null and undated > 0
union all select device_id, 'Your marks', 'ok', pins::varchar || ' pin(s), ' || tracks::varchar || ' track(s)' from e
union all select device_id, 'Backup', case when pins + tracks = 0 then 'ok' when backup_at is null then 'bad' when {NOW} - backup_at > 90 * 86400 then 'warn' else 'ok' end,
 case when pins + tracks = 0 then 'Nothing to back up yet.' when backup_at is null then 'Never backed up.' else 'Last backup ' || {_age('bd')} || '.' end from e
""",
)
def _(t: Tables):
    marks = t.sql("select cast(case when c_nationkey % 4 = 0 then c_nationkey + 1000 else c_nationkey end as bigint) as device_id, case when c_custkey % 3 = 0 then 'track' else 'pin' end as kind from customer")
    backups = t.sql(f"select distinct cast(n_nationkey as bigint) as device_id, case when n_nationkey % 3 <> 0 then {NOW} - n_nationkey * 86400 * 12 end as backup_at from nation")
    return quality.readiness(t.view("v_pack"), marks, backups, NOW).select("device_id", "check", "level", "detail")


@query("j14_lookalikes", "select a.symbol, a.other, p.symbol as other_symbol, p.verdict as other_verdict from v_plant_pair a join v_plant p on upper(p.symbol) = upper(a.other)")
def _(t: Tables):
    return quality.lookalikes(t.view("v_plant"), t.view("v_plant_pair"))


@query("j14_deadly_lookalikes", "select a.symbol, a.other, p.symbol as other_symbol, p.verdict as other_verdict from v_plant_pair a join v_plant p on upper(p.symbol) = upper(a.other) where p.verdict = 'deadly'")
def _(t: Tables):
    return quality.deadly_lookalikes(t.view("v_plant"), t.view("v_plant_pair"))


@query(
    "j15_check_pairing",
    """
select symbol, 'no tell' as problem, cast(null as varchar) as other from v_plant where trim(tell) = ''
union all select a.symbol, 'dangling', a.other from v_plant_pair a where upper(a.other) not in (select upper(symbol) from v_plant)
union all select a.symbol, 'one-way', a.other from v_plant_pair a where upper(a.other) in (select upper(symbol) from v_plant) and not exists (select 1 from v_plant_pair b where upper(b.symbol) = upper(a.other) and upper(b.other) = upper(a.symbol))
union all select p.symbol, 'no lookalike', null from v_plant p where verdict = 'edible-with-care' and upper(symbol) not in (select upper(symbol) from v_plant_pair where other is not null)
""",
)
def _(t: Tables):
    return quality.check_pairing(t.view("v_plant"), t.view("v_plant_pair"))


_TEXTS = "select event_id as text_id, case event_id % 5 when 0 then 'Small' when 1 then 'blue widget (young) x' when 2 then 'ri' when 3 then 'LARGE bolts and nuts' else props end as text from events"
_COMMON = "select plant_no, symbol, common || ', ' || cast(plant_no % 50 as string) || ' wort' as common from v_plant"


@query(
    "j16_match_common_name",
    f"""
with t as (select text_id, trim(regexp_replace(lower(text), '\\s*\\(.*$', '')) as t from ({_TEXTS})),
d as (select distinct t from t where t <> ''),
nm as (select plant_no, symbol, unnest(string_split(lower(common), ', ')) as n from ({_COMMON})),
u as (select n, min(plant_no) as plant_no from nm group by 1),
b as (select d.t, min(u.plant_no) as plant_no from d join u on starts_with(u.n, d.t) or starts_with(d.t, u.n) group by 1)
select t.text_id, p.symbol from t join b on b.t = t.t join v_plant p on p.plant_no = b.plant_no
""",
)
def _(t: Tables):
    return quality.match_common_name(t.sql(_TEXTS), t.sql(_COMMON))


STATES = ["or", "WA", "NV"]


@query(
    "k4_plants_for_state",
    f"""
select p.plant_no, s.state, exists (select 1 from v_plant_state x where x.plant_no = p.plant_no and x.state = s.state) as recorded_here, {q.case_map('verdict', V.VERDICT_RANK)} as verdict_rank
 from v_plant p, (values ('OR'), ('WA'), ('NV')) s(state)
""",
)
def _(t: Tables):
    return quality.plants_for_state(t.view("v_plant"), t.view("v_plant_state"), STATES).select("plant_no", "state", "recorded_here", "verdict_rank")


_PQ = "select query_id, case query_id % 4 when 0 then 'Brass' when 1 then 'brand#1' when 2 then 'ring ' else 'e' end as text from v_viewer"


@query(
    "k8_search_plants",
    f"""
select q.query_id, p.plant_no, {q.case_map('p.verdict', V.VERDICT_RANK)} as verdict_rank, exists (select 1 from v_plant_state x where x.plant_no = p.plant_no and x.state = 'CA') as recorded_here
 from ({_PQ}) q join v_plant p on contains(lower(p.common), lower(trim(q.text))) or contains(lower(p.scientific), lower(trim(q.text))) or contains(lower(p.family), lower(trim(q.text)))
""",
)
def _(t: Tables):
    d = quality.search_plants(t.sql(_PQ), t.view("v_plant"), t.view("v_plant_state"), "ca")
    return d.select("query_id", "plant_no", "verdict_rank", "recorded_here")


_SPECIES = "select case l_suppkey % 6 when 0 then 'OR' when 1 then 'WA' when 2 then 'CA' when 3 then 'ID' when 4 then 'NV' else 'MT' end as state, 'G' || cast(l_partkey % 120 as string) || '-' || cast(l_suppkey % 9 as string) as symbol, 'Genus' || cast(l_partkey % 120 as string) || ' sp' || cast(l_suppkey % 9 as string) || ' var x' as scientific from lineitem"
_GPLANT = "select 'G' || cast(p_partkey % 150 as string) || '-' || cast(p_partkey // 150 as string) as symbol, case when p_partkey % 4 = 0 then 'genus' || cast(p_partkey % 150 as string) || ' a / Genus' || cast((p_partkey + 7) % 150 as string) || ' b' else 'Genus' || cast(p_partkey % 150 as string) || ' a' end as scientific from part"


@query(
    "j20_plant_states",
    f"""
with g as (select symbol, unnest(string_split(scientific, '/')) as x from ({_GPLANT})),
s as (select distinct g.symbol, sp.state from g join ({_SPECIES}) sp on lower(split_part(trim(g.x), ' ', 1)) = lower(split_part(sp.scientific, ' ', 1)))
select p.symbol, coalesce(string_agg(s.state, ',' order by s.state), '') as states from ({_GPLANT}) p left join s on s.symbol = p.symbol group by 1
""",
)
def _(t: Tables):
    plants = t.sql(_GPLANT.replace("p_partkey // ", "p_partkey div "))
    return quality.plant_states(plants, t.sql(_SPECIES)).select("symbol", F.array_join("states", ",").alias("states"))


@query(
    "j20_borrowed_images",
    f"""
with img as (select distinct symbol from ({_SPECIES}) where symbol like '%-2' or symbol like '%-5'),
g as (select p.symbol, generate_subscripts(string_split(scientific, '/'), 1) as i, unnest(string_split(scientific, '/')) as x from ({_GPLANT}) p where symbol not in (select symbol from img)),
r as (select lower(split_part(scientific, ' ', 1)) as genus, symbol as rel, min(scientific) as sci from ({_SPECIES}) where symbol in (select symbol from img) group by 1, 2),
c as (select g.symbol, r.rel, r.sci, row_number() over (partition by g.symbol order by g.i, r.rel) as rn from g join r on lower(split_part(trim(g.x), ' ', 1)) = r.genus and r.rel <> g.symbol)
select symbol, rel as rel_symbol, split_part(sci, ' ', 1) || ' ' || split_part(sci, ' ', 2) as via from c where rn = 1
""",
)
def _(t: Tables):
    species = t.sql(_SPECIES)
    img = species.where("symbol like '%-2' or symbol like '%-5'")
    return quality.borrowed_images(t.sql(_GPLANT.replace("p_partkey // ", "p_partkey div ")), species, img)


_IMG = "select cast(l_partkey % 500 as string) as symbol, l_orderkey * 8 + l_linenumber as image_no, case l_suppkey % 5 when 0 then 'CC0' when 1 then 'Public Domain Mark' when 2 then 'CC BY-SA 4.0' when 3 then 'no restrictions' else null end as licence, case when l_linenumber = 4 then 'image/png' else 'image/jpeg' end as mime, 'File:Leaf ' || cast(l_orderkey as string) || case l_linenumber when 2 then ' map' when 3 then ' Herbarium sheet' when 5 then ' plates.jpg' else '.jpg' end as title, case l_linenumber when 1 then '<a href=\"x\">A.  Person</a> ' when 6 then null else ' ' end as artist from lineitem"


@query(
    "f8_usable_images",
    f"""
with ok as (select *, row_number() over (partition by symbol order by image_no) as rn, trim(regexp_replace(regexp_replace(coalesce(artist, ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as a from ({_IMG.replace(chr(92), '')})
 where regexp_matches(licence, '(?i)^(public domain|cc0|no restrictions)') and mime = 'image/jpeg' and not regexp_matches(title, '(?i)\\bmap\\b|herbarium|\\bplates?\\b'))
select symbol, image_no, regexp_replace(title, '^File:', '') as file, case when a = '' then 'Unknown' else a end || ' (' || licence || ')' as credit from ok where rn <= 3
""",
)
def _(t: Tables):
    return quality.usable_images(t.sql(_IMG))


@query(
    "f10_region_of_path",
    "select page_id, case page_id % 4 when 0 then 'OR' when 1 then '' when 2 then 'WA' else '' end as region from pages",
)
def _(t: Tables):
    d = t.table("pages").withColumn("path", F.concat("url", F.expr("case page_id % 4 when 0 then '/states/or.pmtiles' when 1 then '/planet.pmtiles' when 2 then '/x/WA.pmtiles?v=2' else '' end")))
    return d.select("page_id", quality.region_of_path("path").alias("region"))


@query(
    "s3_strip_blank",
    "select mvum_id, nullif(trim(seasonal), '') as seasonal, nullif(trim(passengervehicle), '') as passengervehicle, case when trim(coalesce(seasonal, '')) <> '' then 1 else 0 end + case when trim(coalesce(passengervehicle, '')) <> '' then 1 else 0 end + 1 as kept from v_mvum",
)
def _(t: Tables):
    d = t.view("v_mvum").withColumn("props", F.create_map(F.lit("s"), "seasonal", F.lit("p"), "passengervehicle", F.lit("n"), "name"))
    return clean.strip_blank(d, "seasonal", "passengervehicle", "props").select("mvum_id", "seasonal", "passengervehicle", F.size("props").alias("kept"))


@query(
    "s4_union_mvum",
    """
select mvum_id, symbol, 'road' as layer_kind, '2 - high clearance' as operationalmaintlevel, cast(null as varchar) as trailclass from v_mvum where mvum_id % 3 <> 0
union all select mvum_id, symbol, 'trail', null, 'TC' || cast(mvum_id % 5 as varchar) from v_mvum where mvum_id % 3 = 0
""",
)
def _(t: Tables):
    from ..sources.mvum import union_mvum

    m = t.view("v_mvum").select("mvum_id", "symbol")
    roads = m.where("mvum_id % 3 <> 0").withColumn("operationalmaintlevel", F.lit("2 - high clearance"))
    trails = m.where("mvum_id % 3 = 0").withColumn("trailclass", F.concat(F.lit("TC"), (F.col("mvum_id") % 5).cast("string")))
    return union_mvum(roads, trails)
