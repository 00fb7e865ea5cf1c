"""Distances, bearings and angles as Column expressions.

Several Earth radii are in use on purpose: every job passes the one its results are defined with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_EQUATORIAL_M = 6378137.0  # search, track, line matching, node distances
EARTH_MEAN_M = 6371000.0  # routing, viewshed, line of sight, camp water distance
EARTH_MEAN_MI = 3958.8  # nearby water
METRES_PER_MILE = 1609.344
FEET_PER_METRE = 3.28084
METRES_PER_DEG_LAT = 110574.0
METRES_PER_DEG_LNG = 111320.0
COMPASS_POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str) -> Column:
    """Rounding towards plus infinity at .5, the rule every stored grid key follows."""
    return F.floor(col(c) + F.lit(0.5))


def haversine(lng1, lat1, lng2, lat2, radius: float = EARTH_EQUATORIAL_M) -> Column:
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    s = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    )
    # not least(): it would skip a null coordinate and answer half the globe
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.when(s > 1, F.lit(1.0)).otherwise(s)))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    """Initial bearing in degrees, 0-360 clockwise from north."""
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    dl = F.radians(lng2 - lng1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def cardinal(deg) -> Column:
    """16-point compass name of a bearing."""
    names = F.array(*[F.lit(p) for p in COMPASS_POINTS])
    idx = round_half_up(F.pmod(col(deg), F.lit(360.0)) / 22.5).cast("int") % 16
    return F.when(col(deg).isNotNull(), F.element_at(names, idx + 1))


def destination(lng, lat, bearing_rad, metres, radius: float = EARTH_MEAN_M) -> tuple[Column, Column]:
    """(lng, lat) reached from a point along a bearing."""
    lng, lat, brg = col(lng), col(lat), col(bearing_rad)
    ang = col(metres) / radius
    p1, l1 = F.radians(lat), F.radians(lng)
    sin_p2 = F.sin(p1) * F.cos(ang) + F.cos(p1) * F.sin(ang) * F.cos(brg)
    p2 = F.asin(sin_p2)
    l2 = l1 + F.atan2(F.sin(brg) * F.sin(ang) * F.cos(p1), F.cos(ang) - F.sin(p1) * F.sin(p2))
    return F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0, F.degrees(p2)


def segment_distance_m(plng, plat, alng, alat, blng, blat) -> Column:
    """Flat-earth distance of a point to a segment, scaled at the point's latitude."""
    plng, plat, alng, alat, blng, blat = map(col, (plng, plat, alng, alat, blng, blat))
    kx = F.lit(METRES_PER_DEG_LNG) * F.cos(F.radians(plat))
    px, py = (plng - alng) * kx, (plat - alat) * METRES_PER_DEG_LAT
    bx, by = (blng - alng) * kx, (blat - alat) * METRES_PER_DEG_LAT
    len2 = bx * bx + by * by
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / len2))
    )
    return F.hypot(px - bx * t, py - by * t)


def shortest_turn(a, b) -> Column:
    """Signed turn from one angle to another, in [-180, 180)."""
    return F.pmod(col(b) - col(a) + 540.0, F.lit(360.0)) - 180.0


def valid_coord(lng, lat) -> Column:
    lng, lat = col(lng).try_cast("double"), col(lat).try_cast("double")
    ok = ~F.isnan(lng) & ~F.isnan(lat) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def mercator_y(lat) -> Column:
    clamped = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), col(lat)))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2))
