"""Map grids, magnetic field, printed sheets and uncertainty rings."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, geo, text
from ..functions.lookup import first_match
from . import paths, spatial

# --- UTM ------------------------------------------------------------------------------------------------------

# WGS84 and the UTM grid.
UTM_A = 6378137.0
UTM_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_E2 = UTM_F * (2 - UTM_F)
UTM_EP2 = UTM_E2 / (1 - UTM_E2)
GRID_SPACINGS_M = [100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]
GRID_MAX_LINES = 14
MAX_ZONE_SPAN_DEG = 9.0


def utm_zone(lng) -> Column:
    return (F.floor(F.pmod(geo.col(lng) + 180.0, F.lit(360.0)) / 6) + 1).cast("int")


def zone_meridian(zone) -> Column:
    return (geo.col(zone) - 1) * 6.0 - 177.0


def _meridian_arc(lat: Column) -> Column:
    e2, e4, e6 = UTM_E2, UTM_E2**2, UTM_E2**3
    return UTM_A * (
        lat * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)
        - F.sin(2 * lat) * (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)
        + F.sin(4 * lat) * (15 * e4 / 256 + 45 * e6 / 1024)
        - F.sin(6 * lat) * (35 * e6 / 3072)
    )


def to_utm(lng, lat, zone, north) -> tuple[Column, Column]:
    """(easting, northing) of a point in the given zone and hemisphere (series expansion)."""
    phi = F.radians(geo.col(lat))
    dl = F.radians(geo.col(lng)) - F.radians(zone_meridian(zone))
    dl = F.when(dl > math.pi, dl - 2 * math.pi).when(dl < -math.pi, dl + 2 * math.pi).otherwise(dl)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), F.lit(2.0))
    n = F.lit(UTM_A) / F.sqrt(1 - F.lit(UTM_E2) * s * s)
    k = F.lit(UTM_EP2) * c * c
    a = c * dl
    p = lambda i: F.pow(a, F.lit(float(i)))
    east = UTM_K0 * n * (
        a + (1 - t + k) * p(3) / 6 + (5 - 18 * t + t * t + 72 * k - 58 * UTM_EP2) * p(5) / 120
    ) + 500000.0
    north_m = UTM_K0 * (
        _meridian_arc(phi)
        + n * F.tan(phi) * (
            p(2) / 2 + (5 - t + 9 * k + 4 * k * k) * p(4) / 24
            + (61 - 58 * t + t * t + 600 * k - 330 * UTM_EP2) * p(6) / 720
        )
    )
    return east, F.when(geo.col(north), north_m).otherwise(north_m + 10000000.0)


def from_utm(easting, northing, zone, north) -> tuple[Column, Column]:
    """(lng, lat) of a grid position."""
    x = geo.col(easting) - 500000.0
    y = F.when(geo.col(north), geo.col(northing)).otherwise(geo.col(northing) - 10000000.0)
    e2 = UTM_E2
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / UTM_K0 / (UTM_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c = F.sin(phi), F.cos(phi)
    k, t = F.lit(UTM_EP2) * c * c, F.pow(F.tan(phi), F.lit(2.0))
    w = 1 - F.lit(e2) * s * s
    n, r = F.lit(UTM_A) / F.sqrt(w), F.lit(UTM_A * (1 - e2)) / F.pow(w, F.lit(1.5))
    d = x / (n * UTM_K0)
    p = lambda i: F.pow(d, F.lit(float(i)))
    lat = phi - n * F.tan(phi) / r * (
        p(2) / 2 - (5 + 3 * t + 10 * k - 4 * k * k - 9 * UTM_EP2) * p(4) / 24
        + (61 + 90 * t + 298 * k + 45 * t * t - 252 * UTM_EP2 - 3 * k * k) * p(6) / 720
    )
    dl = (
        d - (1 + 2 * t + k) * p(3) / 6
        + (5 - 2 * k + 28 * t - 3 * k * k + 8 * UTM_EP2 + 24 * t * t) * p(5) / 120
    ) / c
    return zone_meridian(zone) + F.degrees(dl), F.degrees(lat)


def utm_points(points: DataFrame, forced_zone: int | None = None) -> DataFrame:
    zone = F.lit(forced_zone) if forced_zone else utm_zone("lng")
    d = points.withColumn("zone", zone).withColumn("north", F.col("lat") >= 0)
    e, n = to_utm("lng", "lat", "zone", "north")
    return d.withColumn("easting", e).withColumn("northing", n)


def utm_bins(points: DataFrame, spacing_m: float, forced_zone: int | None = None) -> DataFrame:
    """Points per grid square of a zone."""
    d = utm_points(points, forced_zone)
    return d.groupBy(
        "zone", "north", F.floor(F.col("easting") / spacing_m).alias("e_bin"), F.floor(F.col("northing") / spacing_m).alias("n_bin")
    ).agg(F.count(F.lit(1)).alias("points"))


def grid_spacing(width_m) -> Column:
    """Smallest round spacing that gives at most 14 lines."""
    return first_match(((geo.col(width_m) / s <= GRID_MAX_LINES, s) for s in GRID_SPACINGS_M), GRID_SPACINGS_M[-1])


def grid_label(value, spacing) -> Column:
    v = geo.round_half_up(value)
    within = F.pmod(v, F.lit(100000))
    return (
        F.when(geo.col(spacing) >= 100000, geo.round_half_up(geo.col(value) / 100000).cast("string"))
        .when(geo.col(spacing) >= 1000, F.lpad(F.floor(within / 1000).cast("string"), 2, "0"))
        .otherwise(F.lpad(F.floor(within / 100).cast("string"), 3, "0"))
    )


def graticule(sheets: DataFrame, sheet_id: str, steps: int = 8) -> DataFrame:
    """Grid lines of every map sheet as polylines of ``steps + 1`` points.

    All corners are taken in the zone of the sheet's middle; an inverted sheet, or one reaching more than nine
    degrees from the central meridian, has no lines.
    """
    d = sheets.where((F.col("east") > F.col("west")) & (F.col("north") > F.col("south")))
    d = d.withColumn("zone", utm_zone((F.col("west") + F.col("east")) / 2)).withColumn(
        "hemi", (F.col("south") + F.col("north")) / 2 >= 0
    )
    mid = zone_meridian("zone")
    d = d.where((F.abs(F.col("west") - mid) <= MAX_ZONE_SPAN_DEG) & (F.abs(F.col("east") - mid) <= MAX_ZONE_SPAN_DEG))
    corners = [to_utm(x, y, "zone", "hemi") for x in ("west", "east") for y in ("south", "north")]
    es, ns = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    d = d.withColumn("_es", es).withColumn("_ns", ns).select(
        sheet_id, "zone", "hemi", F.array_min("_es").alias("e0"), F.array_max("_es").alias("e1"),
        F.array_min("_ns").alias("n0"), F.array_max("_ns").alias("n1"),
    )
    d = d.withColumn("spacing", grid_spacing(F.col("e1") - F.col("e0")))

    def lines(axis, lo, hi):
        first, last = F.ceil(F.col(lo) / F.col("spacing")), F.floor(F.col(hi) / F.col("spacing"))
        vals = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(vals, lambda i: F.struct(F.lit(axis).alias("axis"), (i * F.col("spacing")).cast("bigint").alias("value")))

    d = d.withColumn("_l", F.explode(F.concat(lines("easting", "e0", "e1"), lines("northing", "n0", "n1"))))
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    along = F.col("step") / F.lit(steps)
    on_e = F.col("_l.axis") == "easting"
    e = F.when(on_e, F.col("_l.value").cast("double")).otherwise(F.col("e0") + (F.col("e1") - F.col("e0")) * along)
    n = F.when(on_e, F.col("n0") + (F.col("n1") - F.col("n0")) * along).otherwise(F.col("_l.value").cast("double"))
    lng, lat = from_utm(e, n, "zone", "hemi")
    return d.select(sheet_id, "zone", "spacing", "_l.axis", "_l.value", grid_label("_l.value", "spacing").alias("label"),
                    "step", lng.alias("lng"), lat.alias("lat"))


# --- magnetic field -------------------------------------------------------------------------------------------

# Fixed values of the field model.
MAG_A_KM, MAG_RE_KM, MAG_EPOCH, MAG_YEARS, MAG_DEGREE = 6378.137, 6371.2, 2025.0, 5.0, 12
MAG_B_KM = MAG_A_KM * (1 - UTM_F)


def legendre_polynomial(n: int, m: int) -> list[float]:
    """Coefficients by power of sin(latitude) of the m-th derivative of P_n, Schmidt semi-normalised."""
    norm = math.sqrt((1 if m == 0 else 2) * math.factorial(n - m) / math.factorial(n + m))
    out = [0.0] * (n - m + 1)
    for k in range(n // 2 + 1):
        power = n - 2 * k
        if power < m:
            continue
        c = Fraction((-1) ** k * math.comb(n, k) * math.comb(2 * n - 2 * k, n), 2**n)
        out[power - m] = float(c * math.factorial(power) / math.factorial(power - m)) * norm
    return out


def decimal_year(ts) -> Column:
    year = F.year(ts)
    start, end = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(
        year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    sec = lambda c: F.unix_micros(c) / 1e6
    return year + (sec(geo.col(ts).cast("timestamp")) - sec(start)) / (sec(end) - sec(start))


def field_model(points: DataFrame, coef: DataFrame) -> DataFrame:
    """Declination, inclination (degrees) and intensity (nT) for points with lng, lat, alt_km, year.

    A model has at most 90 coefficient rows (degree 12); they go to the tasks with the function, and the sum over
    the harmonics is a vectorised projection.  Joining the rows to every point would multiply the points by 90 and
    shuffle them; higher-order functions need milliseconds per point.
    """
    valid = F.col("n").between(1, MAG_DEGREE) & F.col("m").between(0, F.col("n"))
    if coef.where(~F.coalesce(valid, F.lit(False))).limit(1).count():
        raise ValueError(f"coefficient rows must have degree 1 to {MAG_DEGREE} and order 0 to the degree")
    values = F.struct("g", "h", "gdot", "hdot")
    rows = coef.groupBy("n", "m").agg(F.min(values).alias("c"), F.max(values).alias("_c")).select("n", "m", "c.*", (F.col("c") != F.col("_c")).alias("_twice")).collect()
    if any(r["_twice"] for r in rows):
        raise ValueError("a degree and order has two different coefficient rows")
    model = [(r.n, r.m, r.g, r.h, r.gdot, r.hdot, legendre_polynomial(r.n, r.m)) for r in rows]

    @F.pandas_udf("declination double, inclination double, intensity double")
    def field(lng: pd.Series, lat: pd.Series, alt_km: pd.Series, year: pd.Series) -> pd.DataFrame:
        t, lam = year.to_numpy() - MAG_EPOCH, np.radians(lng.to_numpy())
        phi = np.radians(np.clip(lat.to_numpy(), -89.9999, 89.9999))
        e2, alt = 1 - (MAG_B_KM / MAG_A_KM) ** 2, alt_km.fillna(0.0).to_numpy()
        rc = MAG_A_KM / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        p, z = (rc + alt) * np.cos(phi), (rc * (1 - e2) + alt) * np.sin(phi)
        r = np.hypot(p, z)
        gc_lat = np.arcsin(z / r)
        s, c = np.sin(gc_lat), np.cos(gc_lat)
        north, east, down = np.zeros_like(s), np.zeros_like(s), np.zeros_like(s)
        for n, m, g0, h0, gd, hd, poly in model:
            v = np.polynomial.polynomial.polyval(s, poly)
            dv = np.polynomial.polynomial.polyval(s, np.polynomial.polynomial.polyder(poly))
            val, slope = c**m * v, c ** (m + 1) * dv - m * s * c ** (m - 1.0) * v
            g, h, w = g0 + t * gd, h0 + t * hd, (MAG_RE_KM / r) ** (n + 2)
            along = g * np.cos(m * lam) + h * np.sin(m * lam)
            north -= w * along * slope
            east += w * m * (g * np.sin(m * lam) - h * np.cos(m * lam)) * val / c
            down -= w * (n + 1) * along * val
        d = gc_lat - phi
        x, z = north * np.cos(d) - down * np.sin(d), north * np.sin(d) + down * np.cos(d)
        hor = np.hypot(x, east)
        return pd.DataFrame({
            "declination": np.degrees(np.arctan2(east, x)), "inclination": np.degrees(np.arctan2(z, hor)), "intensity": np.hypot(hor, z),
        })

    d = points.where((F.col("year") >= MAG_EPOCH) & (F.col("year") < MAG_EPOCH + MAG_YEARS))
    return d.withColumn("_f", field("lng", "lat", "alt_km", "year")).select(*points.columns, "_f.*")


def declination_text(deg) -> Column:
    a = F.abs(geo.col(deg))
    return F.when(a < 0.05, "0°").otherwise(
        F.concat(text.fixed(a, 1), F.lit("° "), F.when(geo.col(deg) > 0, "E").otherwise("W"))
    )


def apply_declination(points: DataFrame, coef: DataFrame, path: str, seq: str) -> DataFrame:
    """Magnetic bearing of every leg, with the field at the leg's start (``year`` and ``alt_km`` per point)."""
    legs = paths.legs(points, path, seq).where(F.col("p_lng").isNotNull())
    at = legs.select(path, seq, F.col("bearing").alias("true_bearing"), F.col("p_lng").alias("lng"), F.col("p_lat").alias("lat"),
                     "alt_km", "year")
    f = field_model(at, coef)
    return f.withColumn("magnetic_bearing", F.pmod(F.col("true_bearing") - F.col("declination"), F.lit(360.0))).withColumn(
        "declination_text", declination_text("declination")
    )


def magnetic_to_true(magnetic, declination) -> Column:
    return F.pmod(geo.col(magnetic) + geo.col(declination), F.lit(360.0))


# --- sheets, rings, estimates ---------------------------------------------------------------------------------

def sheet_index(features: DataFrame, sheets: DataFrame) -> DataFrame:
    """Which features fall on which printed sheet (width_pt x height_pt), and where on the page."""
    d = spatial.points_in_boxes(features, sheets)
    top, bottom = geo.mercator_y("north"), geo.mercator_y("south")
    x = (F.col("lng") - F.col("west")) / (F.col("east") - F.col("west")) * F.col("width_pt")
    y = (top - geo.mercator_y("lat")) / (top - bottom) * F.col("height_pt")
    return d.withColumn("page_x", x).withColumn("page_y", y)


def _one_two_five(v: Column) -> Column:
    base = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / base
    return F.when(m >= 5, 5.0).when(m >= 2, 2.0).otherwise(1.0) * base


def scale_bar(max_m, unit: str = "imperial") -> tuple[Column, Column]:
    """(metres, label) of the longest 1-2-5 bar that fits."""
    m = geo.col(max_m)
    ok = m > 0

    def words(n, u):
        return F.concat(F.regexp_replace(text.fixed(n, 6), r"\.?0+$", ""), F.lit(u))

    if unit == "metric":
        km, mm = _one_two_five(m / 1000), _one_two_five(m)
        length = F.when(m >= 1000, km * 1000).otherwise(mm)
        label = F.when(m >= 1000, words(km, " km")).otherwise(words(mm, " m"))
    else:
        miles = m / geo.METRES_PER_MILE
        mi, ft = _one_two_five(miles), _one_two_five(m * geo.FEET_PER_METRE)
        length = F.when(miles >= 1, mi * geo.METRES_PER_MILE).otherwise(ft / geo.FEET_PER_METRE)
        label = F.when(miles >= 1, words(mi, " mi")).otherwise(words(ft, " ft"))
    return F.when(ok, length).otherwise(0.0), F.when(ok, label).otherwise("")


def scale_ratio(metres_per_point) -> Column:
    """Scale such as 1:24,000, rounded to two figures."""
    ratio = geo.col(metres_per_point) / (0.0254 / 72)
    step = F.pow(F.lit(10.0), F.floor(F.log10(ratio)) - 1)
    rounded = F.when(ratio >= 100, geo.round_half_up(ratio / step) * step).otherwise(geo.round_half_up(ratio))
    return F.concat(F.lit("1:"), F.format_number(geo.round_half_up(rounded), 0))


def uncertainty_m(precision_bits) -> Column:
    """Half-width of the cell a blurred position may lie in; null when exact or unset."""
    b = geo.col(precision_bits)
    return F.when((b > 0) & (b < 32), F.pow(F.lit(2.0), 32 - b) * 1e-7 * 111320.0 / 2)


def uncertainty_ring(nodes: DataFrame, node_id: str, n: int = 64) -> DataFrame:
    """Closed ring of n + 1 points around every node with a blurred position."""
    d = nodes.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).withColumn("radius_m", uncertainty_m("precision_bits"))
    d = d.where(F.col("radius_m").isNotNull()).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a = F.col("i") / n * (2 * math.pi)
    r = geo.EARTH_EQUATORIAL_M
    return d.select(
        node_id, "radius_m", "i",
        (F.col("lng") + F.degrees(F.col("radius_m") * F.sin(a) / (r * F.cos(F.radians("lat"))))).alias("ring_lng"),
        (F.col("lat") + F.degrees(F.col("radius_m") * F.cos(a) / r)).alias("ring_lat"),
    )


def terrain_estimate(regions: DataFrame) -> DataFrame:
    """Expected terrain download of a region in MB: zoom-12 tiles plus a third, 110 KB each."""
    cols = F.greatest(F.lit(1.0), (F.col("east") - F.col("west")) / 360.0 * 4096.0)
    rows = F.greatest(F.lit(1.0), cells.tile_yf("south", 12) - cells.tile_yf("north", 12))
    return regions.withColumn("terrain_mb", geo.round_half_up(cols * rows * 1.33 * 110 / 1000))
