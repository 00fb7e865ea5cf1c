"""Paths, tracks and the legal-access summary over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths
from ..operators import rule_values as V
from . import sqlgen as q
from .registry import Tables, query
from .spatial_queries import segments

r3 = lambda c: F.round(c, 3).alias(c)
r6 = lambda c: F.round(c, 6).alias(c)

_LEG = f"""
leg as (select *, {q.hav('p_lng','p_lat','lng','lat')} as leg_m from (
  select route_id, seq, lng, lat, lag(lng) over w as p_lng, lag(lat) over w as p_lat, lead(lng) over w as n_lng from v_path
  window w as (partition by route_id order by seq))),
cum as (select *, sum(coalesce(leg_m, 0)) over (partition by route_id order by seq) as cum_m from leg)
"""


@query(
    "w1_legs",
    f"""
with {_LEG}
select route_id, seq, round(leg_m, 3) as leg_m, round({q.bearing('p_lng','p_lat','lng','lat')}, 6) as bearing,
 {q.cardinal(q.bearing('p_lng','p_lat','lng','lat'))} as direction, round(cum_m, 3) as cum_m from cum
""",
)
def _(t: Tables):
    d = paths.legs(t.view("v_path"), "route_id", "seq")
    return d.select("route_id", "seq", r3("leg_m"), r6("bearing"), "direction", r3("cum_m"))


_SAMPLE = """
smp as (
  select route_id, 0 as sample_no, lng, lat from cum where p_lng is null
  union all select route_id, k, p_lng + (lng - p_lng) * ((k * 60.0e0 - (cum_m - leg_m)) / leg_m), p_lat + (lat - p_lat) * ((k * 60.0e0 - (cum_m - leg_m)) / leg_m)
   from (select *, unnest(range(cast(floor((cum_m - leg_m) / 60.0e0) as bigint) + 1, cast(floor(cum_m / 60.0e0) as bigint) + 1)) as k from cum where leg_m > 0)
  union all select route_id, cast(floor(cum_m / 60.0e0) as bigint) + 1, lng, lat from cum where n_lng is null and p_lng is not null)
"""


@query(
    "w2_resample_every",
    f"with {_LEG}, {_SAMPLE} select route_id, cast(sample_no as bigint) as sample_no, round(lng, 6) as lng, round(lat, 6) as lat from smp",
)
def _(t: Tables):
    s = paths.resample_every(t.view("v_path"), "route_id", "seq")
    return s.select("route_id", "sample_no", r6("lng"), r6("lat"))


_SHARE = f"""
shr as (select *, coalesce({q.hav('pl','pa','lng','lat')} / 2, 0) + coalesce({q.hav('lng','lat','nl','na')} / 2, 0) as share_m from (
  select route_id, sample_no, lng, lat, lag(lng) over w as pl, lag(lat) over w as pa, lead(lng) over w as nl, lead(lat) over w as na
  from smp window w as (partition by route_id order by sample_no)))
"""


@query(
    "w4_sample_share",
    f"with {_LEG}, {_SAMPLE}, {_SHARE} select route_id, cast(sample_no as bigint) as sample_no, round(share_m, 3) as share_m from shr",
)
def _(t: Tables):
    s = paths.sample_share(paths.resample_every(t.view("v_path"), "route_id", "seq"), "route_id")
    return s.select("route_id", "sample_no", r3("share_m"))


@query(
    "w3_resample_n",
    f"""
with {_LEG},
tot as (select route_id, max(cum_m) as total_m, least(256, greatest(2, cast(floor(max(cum_m) / 20.0e0 + 0.5e0) as bigint))) as n from cum group by 1 having count(*) > 1),
j as (select c.*, t.total_m, t.n, cast(floor((cum_m - leg_m) * (n - 1) / total_m) as bigint) + 1 as lo, least(n - 2, cast(floor(cum_m * (n - 1) / total_m) as bigint)) as hi from cum c join tot t using (route_id)),
s as (select route_id, 0 as k, lng, lat, total_m, n from j where p_lng is null
 union all select route_id, k, p_lng + (lng - p_lng) * ((total_m * k / (n - 1) - (cum_m - leg_m)) / leg_m), p_lat + (lat - p_lat) * ((total_m * k / (n - 1) - (cum_m - leg_m)) / leg_m), total_m, n
  from (select *, unnest(range(lo, hi + 1)) as k from j where leg_m > 0)
 union all select route_id, n - 1, lng, lat, total_m, n from j where n_lng is null and p_lng is not null)
select route_id, cast(k as bigint) as sample_no, round(lng, 6) as lng, round(lat, 6) as lat, round(total_m * k / (n - 1), 3) as d_m from s
""",
)
def _(t: Tables):
    s = paths.resample_n(t.view("v_path"), "route_id", "seq")
    return s.select("route_id", "sample_no", r6("lng"), r6("lat"), r3("d_m"))


_LABEL = q.case_map("m.symbol", V.MVUM_LABELS, q.lit(V.MVUM_UNKNOWN))
_MATCH = f"""
with {_LEG}, {_SAMPLE}, {_SHARE},
line as (select lng1, lat1, lng2, lat2, min(mvum_id) as mvum_id from v_mvum group by all),
d as (select s.route_id, s.sample_no, l.mvum_id, {q.seg_dist('s.lng','s.lat','l.lng1','l.lat1','l.lng2','l.lat2')} as m
  from shr s join line l on s.lat between l.lat1 - 0.001e0 and l.lat2 + 0.001e0 and s.lng between l.lng1 - 0.001e0 and l.lng2 + 0.001e0),
best as (select route_id, sample_no, mvum_id from (select *, row_number() over (partition by route_id, sample_no order by m, mvum_id) as rn from d where m < 40) where rn = 1),
matched as (select s.route_id, s.sample_no, s.share_m, m.* from shr s left join best b on s.route_id = b.route_id and s.sample_no = b.sample_no
  left join v_mvum m on b.mvum_id = m.mvum_id)
"""


def matched(t: Tables):
    mvum = t.view("v_mvum")
    props = mvum.select("mvum_id", F.col("mvum_id").cast("string").alias("id"), "name", "symbol", "seasonal", "dates")
    return paths.match_route_samples(t.view("v_path"), "route_id", "seq", segments(mvum, "mvum_id"), props)


@query(
    "a3_route_totals",
    _MATCH + """
select route_id, round(matched_m, 3) as matched_m, round(unmatched_m, 3) as unmatched_m,
 cast(floor(matched_m / (matched_m + unmatched_m) * 100 + 0.5e0) as bigint) as share_pct, matched_m >= 100 as report from (
 select route_id, sum(case when mvum_id is not null then share_m else 0 end) as matched_m, sum(case when mvum_id is null then share_m else 0 end) as unmatched_m from matched group by 1)
""",
)
def _(t: Tables):
    return paths.route_totals(matched(t), "route_id").withColumn("matched_m", F.round("matched_m", 3)).withColumn(
        "unmatched_m", F.round("unmatched_m", 3)
    )


@query(
    "a3_route_classes",
    _MATCH + f"""
select route_id, {_LABEL} as label, round(sum(share_m), 3) as metres from matched m where mvum_id is not null group by 1, 2 having sum(share_m) > 80
""",
)
def _(t: Tables):
    return paths.route_classes(matched(t), "route_id").withColumn("metres", F.round("metres", 3))


def dates_sql(c: str) -> str:
    """Readable open season of a month-day range."""
    p = r"^(\d{1,2})/(\d{1,2})\s*-\s*(\d{1,2})/(\d{1,2})$"
    months = "[" + ",".join(q.lit(m) for m in V.MONTH_ABBR) + "]"
    part = lambda i: f"try_cast(regexp_extract({c}, '{p}', {i}) as int)"
    ok = f"regexp_matches({c}, '{p}') and {part(1)} between 1 and 12 and {part(3)} between 1 and 12"
    txt = f"({months})[{part(1)}] || ' ' || {part(2)} || ' – ' || ({months})[{part(3)}] || ' ' || {part(4)}"
    return f"case when {c} = '01/01-12/31' then 'year-round' when {ok} then {txt} else {c} end"


@query(
    "a3_route_roads",
    _MATCH + f"""
select route_id, cast(mvum_id as varchar) as road, cast(min(sample_no) as bigint) as first_sample, any_value(name) as name, any_value(symbol) as symbol,
 bool_or(coalesce(lower(trim(seasonal)) = 'seasonal', false) or symbol in {q.in_list(V.MVUM_SEASONAL_SYMBOLS)}) as seasonal,
 case when bool_or(coalesce(lower(trim(seasonal)) = 'seasonal', false) or symbol in {q.in_list(V.MVUM_SEASONAL_SYMBOLS)}) then any_value({dates_sql('dates')}) end as dates
from matched where mvum_id is not null group by route_id, mvum_id
""",
)
def _(t: Tables):
    return paths.route_roads(matched(t), "route_id").select("route_id", "road", "first_sample", "name", "symbol", "seasonal", "dates")


@query(
    "a4_track_stats",
    f"""
with leg as (select node, ts, {q.hav('lag(lng) over w','lag(lat) over w','lng','lat')} as m from v_fix window w as (partition by node order by fix_id))
select node, round(coalesce(sum(m), 0), 3) as length_m, count(*) as points, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration_s from leg group by 1 having count(*) > 1
""",
)
def _(t: Tables):
    return paths.track_stats(t.view("v_fix"), "node", "fix_id", "ts").withColumn("length_m", F.round("length_m", 3))


@query(
    "w10_unwrap_heading",
    f"""
with h as (select user_id as k, event_id as o, -floor(value * 7) as face from events),
l as (select k, o, face, coalesce(lag(face) over (partition by k order by o), 0) as prev from h)
select k, o, round(sum({q.fmod('face - prev + 540', '360')} - 180) over (partition by k order by o), 6) as needle from l
""",
)
def _(t: Tables):
    h = t.table("events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("o"), F.floor(F.col("value") * 7).cast("double").alias("heading")
    )
    return paths.unwrap_heading(h, "k", "o").select("k", "o", r6("needle"))


@query(
    "a10_ring_area",
    """
with v as (select route_id, lng, lat, coalesce(lead(lng) over w, first_value(lng) over w) as lng2, coalesce(lead(lat) over w, first_value(lat) over w) as lat2
  from v_route window w as (partition by route_id order by seq))
select route_id, count(*) as vertices, round(case when count(*) < 3 then 0 else abs(sum(radians(lng2 - lng) * (2 + sin(radians(lat)) + sin(radians(lat2)))) * 6378137.0e0 * 6378137.0e0 / 2) end, 1) as area_m2 from v group by 1
""",
)
def _(t: Tables):
    return paths.ring_area(t.view("v_route"), "route_id", "seq").withColumn("area_m2", F.round("area_m2", 1))
