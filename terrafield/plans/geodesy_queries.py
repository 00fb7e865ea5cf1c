"""Grids, magnetic field, sheets and rings over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geodesy as g
from . import sqlgen as q
from .path_queries import _LEG, r3, r6
from .registry import Tables, query


def n(v) -> str:
    return f"({v!r}::double)"


E2, EP2, A, K0 = g.UTM_E2, g.UTM_EP2, g.UTM_A, g.UTM_K0


def utm_sql(lng, lat, zone, north) -> tuple[str, str]:
    """Easting and northing as one SQL expression each."""
    ph = f"radians({lat})"
    a = f"(cos({ph}) * (radians({lng}) - radians(({zone} - 1) * 6.0e0 - 177.0e0)))"
    t, c = f"pow(tan({ph}), 2)", f"({n(EP2)} * pow(cos({ph}), 2))"
    nn = f"({n(A)} / sqrt(1 - {n(E2)} * pow(sin({ph}), 2)))"
    e4, e6 = E2**2, E2**3
    arc = (f"{n(A)} * ({n(1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)} * {ph} - {n(3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)} * sin(2 * {ph})"
           f" + {n(15 * e4 / 256 + 45 * e6 / 1024)} * sin(4 * {ph}) - {n(35 * e6 / 3072)} * sin(6 * {ph}))")
    e = f"({n(K0)} * {nn} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {n(58 * EP2)}) * pow({a}, 5) / 120) + 500000.0e0)"
    no = (f"({n(K0)} * ({arc} + {nn} * tan({ph}) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24"
          f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {n(330 * EP2)}) * pow({a}, 6) / 720)) + case when {north} then 0 else 10000000.0e0 end)")
    return e, no


def inverse_sql(e, no, zone) -> tuple[str, str]:
    """Longitude and latitude of a northern grid position; ``mu`` and ``phi`` come from the surrounding query."""
    k, t = f"({n(EP2)} * pow(cos(phi), 2))", "pow(tan(phi), 2)"
    w = f"(1 - {n(E2)} * pow(sin(phi), 2))"
    nn, r = f"({n(A)} / sqrt({w}))", f"({n(A * (1 - E2))} / pow({w}, 1.5e0))"
    d = f"(({e} - 500000.0e0) / ({nn} * {n(K0)}))"
    lat = (f"degrees(phi - {nn} * tan(phi) / {r} * (pow({d}, 2) / 2 - (5 + 3 * {t} + 10 * {k} - 4 * {k} * {k} - {n(9 * EP2)}) * pow({d}, 4) / 24"
           f" + (61 + 90 * {t} + 298 * {k} + 45 * {t} * {t} - {n(252 * EP2)} - 3 * {k} * {k}) * pow({d}, 6) / 720))")
    lng = (f"(({zone} - 1) * 6.0e0 - 177.0e0 + degrees(({d} - (1 + 2 * {t} + {k}) * pow({d}, 3) / 6"
           f" + (5 - 2 * {k} + 28 * {t} - 3 * {k} * {k} + {n(8 * EP2)} + 24 * {t} * {t}) * pow({d}, 5) / 120) / cos(phi)))")
    return lng, lat


_WORLD = "select place_id, lng + (place_id % 7) * 30.0e0 as lng, case when place_id % 3 = 0 then -lat else lat - (place_id % 5) * 8.0e0 end as lat from v_place"
_ZONE = f"cast(floor({q.fmod('lng + 180.0e0', '360.0e0')} / 6) + 1 as int)"
_e, _n = utm_sql("lng", "lat", "zone", "lat >= 0")


@query(
    "r12_utm_points",
    f"with w as (select *, {_ZONE} as zone from ({_WORLD})) select place_id, zone, lat >= 0 as north, round({_e}, 3) as easting, round({_n}, 3) as northing from w",
)
def _(t: Tables):
    return g.utm_points(t.sql(_WORLD)).select("place_id", "zone", "north", r3("easting"), r3("northing"))


@query(
    "r12_utm_bins",
    f"""
with w as (select *, {_ZONE} as zone from ({_WORLD}))
select zone, lat >= 0 as north, cast(floor({_e} / 10000) as bigint) as e_bin, cast(floor({_n} / 10000) as bigint) as n_bin, count(*) as points from w group by all
""",
)
def _(t: Tables):
    return g.utm_bins(t.sql(_WORLD), 10000.0)


_ie, _in = utm_sql("lng", "lat", "11", "true")


@query("r12_utm_forced_zone", f"select place_id, round({_ie}, 3) as easting, round({_in}, 3) as northing from v_place")
def _(t: Tables):
    return g.utm_points(t.view("v_place"), forced_zone=11).select("place_id", r3("easting"), r3("northing"))


def _corner(axis):
    i = 0 if axis == "e" else 1
    return [utm_sql(x, y, "zone", "true")[i] for x in ("west", "east") for y in ("south", "north")]


_e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
_PHI = (f"(mu + {n(3 * _e1 / 2 - 27 * _e1**3 / 32)} * sin(2 * mu) + {n(21 * _e1**2 / 16 - 55 * _e1**4 / 32)} * sin(4 * mu)"
        f" + {n(151 * _e1**3 / 96)} * sin(6 * mu) + {n(1097 * _e1**4 / 512)} * sin(8 * mu))")
_lng, _lat = inverse_sql("e", "nn", "zone")
_SPACING = "case " + " ".join(f"when (e1 - e0) / {s} <= 14 then {s}" for s in g.GRID_SPACINGS_M) + " else 100000 end"


@query(
    "w14_graticule",
    f"""
with z as (select *, {_ZONE.replace('lng', '((west + east) / 2)')} as zone from v_sheet),
c as (select sheet_id, zone, least({', '.join(_corner('e'))}) as e0, greatest({', '.join(_corner('e'))}) as e1, least({', '.join(_corner('n'))}) as n0, greatest({', '.join(_corner('n'))}) as n1
  from z where abs(west - ((zone - 1) * 6 - 177)) <= 9 and abs(east - ((zone - 1) * 6 - 177)) <= 9),
s as (select *, {_SPACING} as spacing from c),
l as (select *, 'easting' as axis, unnest(range(cast(ceil(e0 / spacing) as bigint), cast(floor(e1 / spacing) as bigint) + 1)) * spacing as value from s
  union all select *, 'northing', unnest(range(cast(ceil(n0 / spacing) as bigint), cast(floor(n1 / spacing) as bigint) + 1)) * spacing from s),
p as (select *, case when axis = 'easting' then value::double else e0 + (e1 - e0) * (step / 8.0e0) end as e, case when axis = 'easting' then n0 + (n1 - n0) * (step / 8.0e0) else value::double end as nn
  from l, (select unnest(range(0, 9)) as step)),
m as (select *, nn / {n(K0)} / {n(A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))} as mu from p),
f as (select *, {_PHI} as phi from m)
select sheet_id, cast(spacing as int) as spacing, axis, cast(value as bigint) as value, case when spacing >= 100000 then cast(value // 100000 as varchar) when spacing >= 1000 then lpad(cast((value % 100000) // 1000 as varchar), 2, '0') else lpad(cast((value % 100000) // 100 as varchar), 3, '0') end as label,
 cast(step as int) as step, round({_lng}, 6) as lng, round({_lat}, 6) as lat from f
""",
)
def _(t: Tables):
    d = g.graticule(t.view("v_sheet"), "sheet_id")
    return d.select("sheet_id", "spacing", "axis", "value", "label", "step", r6("lng"), r6("lat"))


def basis_values() -> str:
    rows = [f"({nn}, {m}, {p}, {c!r}::double)" for nn in range(1, 13) for m in range(nn + 1)
            for p, c in enumerate(g.legendre_polynomial(nn, m)) if c]
    return ", ".join(rows)


def field_sql(points: str, key: str) -> str:
    """Field at ``points`` (key, lng, lat, year) by joining points, harmonics and polynomial terms."""
    return f"""
base as (select {key}, lng, lat, year - 2025.0e0 as t, radians(lat) as phi, {n(g.MAG_A_KM)} / sqrt(1 - {n(1 - (g.MAG_B_KM / g.MAG_A_KM) ** 2)} * pow(sin(radians(lat)), 2)) as rc from ({points})),
geo as (select *, sqrt(pow(rc * cos(phi), 2) + pow(rc * {n((g.MAG_B_KM / g.MAG_A_KM) ** 2)} * sin(phi), 2)) as r, asin(rc * {n((g.MAG_B_KM / g.MAG_A_KM) ** 2)} * sin(phi) / sqrt(pow(rc * cos(phi), 2) + pow(rc * {n((g.MAG_B_KM / g.MAG_A_KM) ** 2)} * sin(phi), 2))) as gl from base),
poly as (select {key}, any_value(lng) as lng, any_value(t) as t, any_value(phi) as phi, any_value(gl) as gl, any_value(r) as r, b.n, b.m,
  sum(b.c * pow(sin(gl), b.p)) as v, sum(case when b.p > 0 then b.c * b.p * pow(sin(gl), b.p - 1) else 0 end) as d from geo, (values {basis_values()}) b(n, m, p, c) group by {key}, b.n, b.m),
term as (select p.*, pow(cos(gl), p.m) * v as pv, pow(cos(gl), p.m + 1) * d - p.m * sin(gl) * pow(cos(gl), p.m - 1) * v as dp, c.g + t * c.gdot as g, c.h + t * c.hdot as h, p.m * radians(lng) as ml, pow({n(g.MAG_RE_KM)} / r, p.n + 2) as w
  from poly p join v_coef c on p.n = c.n and p.m = c.m),
xyz as (select {key}, any_value(phi) as phi, any_value(gl) as gl, -sum(w * (g * cos(ml) + h * sin(ml)) * dp) as x, sum(w * m * (g * sin(ml) - h * cos(ml)) * pv / cos(gl)) as y, -sum(w * (n + 1) * (g * cos(ml) + h * sin(ml)) * pv) as z from term group by {key}),
rot as (select {key}, x * cos(gl - phi) - z * sin(gl - phi) as x, y, x * sin(gl - phi) + z * cos(gl - phi) as z from xyz),
field as (select {key}, degrees(atan2(y, x)) as declination, degrees(atan2(z, sqrt(x * x + y * y))) as inclination, sqrt(x * x + y * y + z * z) as intensity from rot)
"""


_MAG_POINTS = "select pin_id, lng, lat, 2025.0e0 + (pin_id % 5) as year, 0.0e0 as alt_km from v_pin"


@query(
    "a9_field_model",
    f"with {field_sql(_MAG_POINTS, 'pin_id')} select pin_id, round(declination, 6) as declination, round(inclination, 6) as inclination, round(intensity, 3) as intensity from field",
)
def _(t: Tables):
    d = g.field_model(t.sql(_MAG_POINTS), t.view("v_coef"))
    return d.select("pin_id", r6("declination"), r6("inclination"), r3("intensity"))


_LEG_POINTS = "select route_id * 100000000 + seq as k, p_lng as lng, p_lat as lat, 2026.5e0 as year from cum where p_lng is not null"


@query(
    "r11_apply_declination",
    f"""
with {_LEG}, {field_sql(_LEG_POINTS, 'k')}
select route_id, seq, round({q.fmod(q.bearing('p_lng','p_lat','lng','lat') + ' - f.declination', '360.0e0')}, 5) as magnetic_bearing,
 case when abs(f.declination) < 0.05 then '0°' else printf('%.1f', abs(f.declination)) || '° ' || case when f.declination > 0 then 'E' else 'W' end end as declination_text
 from cum join field f on f.k = route_id * 100000000 + seq
""",
)
def _(t: Tables):
    p = t.view("v_path").withColumn("alt_km", F.lit(0.0)).withColumn("year", F.lit(2026.5))
    d = g.apply_declination(p, t.view("v_coef"), "route_id", "seq")
    return d.select("route_id", "seq", F.round("magnetic_bearing", 5).alias("magnetic_bearing"), "declination_text")


_MERC = lambda c: f"ln(tan(pi() / 4 + radians({c}) / 2))"


@query(
    "r13_sheet_index",
    f"""
select p.place_id, s.sheet_id, round((p.lng - west) / (east - west) * 540, 3) as page_x, round(({_MERC('north')} - {_MERC('p.lat')}) / ({_MERC('north')} - {_MERC('south')}) * 720, 3) as page_y
 from v_place p join v_sheet s on p.lng between west and east and p.lat between south and north
""",
)
def _(t: Tables):
    d = g.sheet_index(t.view("v_place").select("place_id", "lng", "lat"), t.view("v_sheet"))
    return d.select("place_id", "sheet_id", r3("page_x"), r3("page_y"))


_B125 = lambda v: f"(case when {v} / pow(10, floor(log10({v}))) >= 5 then 5 when {v} / pow(10, floor(log10({v}))) >= 2 then 2 else 1 end * pow(10, floor(log10({v}))))"


@query(
    "r13_scale_bar",
    f"""
with w as (select sheet_id, {q.hav('west','south','east','south')} / 4 as m from v_sheet)
select sheet_id, round(case when m >= 1000 then {_B125('m / 1000')} * 1000 else {_B125('m')} end, 3) as metric_m,
 case when m >= 1000 then cast(cast({_B125('m / 1000')} as int) as varchar) || ' km' else cast(cast({_B125('m')} as int) as varchar) || ' m' end as metric,
 case when m / 1609.344e0 >= 1 then cast(cast({_B125('m / 1609.344e0')} as int) as varchar) || ' mi' else cast(cast({_B125('m * 3.28084e0')} as int) as varchar) || ' ft' end as imperial from w
""",
)
def _(t: Tables):
    from ..functions import geo

    w = t.view("v_sheet").withColumn("m", geo.haversine("west", "south", "east", "south") / 4)
    metric, imperial = g.scale_bar("m", "metric"), g.scale_bar("m")
    return w.select("sheet_id", F.round(metric[0], 3).alias("metric_m"), metric[1].alias("metric"), imperial[1].alias("imperial"))


@query(
    "r13_scale_ratio",
    f"""
with w as (select sheet_id, {q.hav('west','south','east','south')} / 540 / (0.0254e0 / 72) as r from v_sheet)
select sheet_id, '1:' || {q.thousands('floor(r / pow(10, floor(log10(r)) - 1) + 0.5e0) * pow(10, floor(log10(r)) - 1)')} as ratio from w
""",
)
def _(t: Tables):
    from ..functions import geo

    w = t.view("v_sheet").withColumn("m", geo.haversine("west", "south", "east", "south") / F.col("width_pt"))
    return w.select("sheet_id", g.scale_ratio("m").alias("ratio"))


@query(
    "r14_uncertainty_ring",
    """
with d as (select arrival, lng, lat, pow(2.0e0, 32 - precision_bits) * 1e-7 * 111320.0e0 / 2 as m from v_mesh where lng is not null and precision_bits > 0 and precision_bits < 32)
select arrival, round(m, 3) as radius_m, cast(i as int) as i, round(lng + degrees(m * sin(i / 64.0e0 * 2 * pi()) / (6378137.0e0 * cos(radians(lat)))), 6) as ring_lng, round(lat + degrees(m * cos(i / 64.0e0 * 2 * pi()) / 6378137.0e0), 6) as ring_lat
 from d, (select unnest(range(0, 65)) as i)
""",
)
def _(t: Tables):
    d = g.uncertainty_ring(t.view("v_mesh"), "arrival")
    return d.select("arrival", r3("radius_m"), "i", r6("ring_lng"), r6("ring_lat"))


@query(
    "a11_terrain_estimate",
    f"select ordinal, cast(floor(greatest(1.0e0, (east - west) / 360.0e0 * 4096) * greatest(1.0e0, {q.tile_y('south', 12)} - {q.tile_y('north', 12)}) * 1.33e0 * 110 / 1000 + 0.5e0) as bigint) as terrain_mb from v_catalog",
)
def _(t: Tables):
    return g.terrain_estimate(t.view("v_catalog")).select("ordinal", "terrain_mb")
