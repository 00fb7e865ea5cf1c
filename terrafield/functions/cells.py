"""Web-map tiles, Hilbert tile ids and the search cells behind every radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

MAX_MERCATOR_LAT = 85.0511
_BAND = 1 << 32


# --- web-map tiles --------------------------------------------------------------------------------------------

def tile_xf(lng, z) -> Column:
    return (col(lng) + 180.0) / 360.0 * F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(float(z)))


def tile_yf(lat, z) -> Column:
    r = F.radians(col(lat))
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(float(z)))
    return (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n


def clamp_lat(lat, limit: float = MAX_MERCATOR_LAT) -> Column:
    return F.least(F.lit(limit), F.greatest(F.lit(-limit), col(lat)))


def tile_lng(x, z) -> Column:
    return col(x) / F.pow(F.lit(2.0), col(z)) * 360.0 - 180.0


def tile_lat(y, z) -> Column:
    n = F.lit(math.pi) - F.lit(2.0 * math.pi) * col(y) / F.pow(F.lit(2.0), col(z))
    return F.degrees(F.atan(F.sinh(n)))


def hilbert_tile_id(z, x, y) -> Column:
    """Position of a tile on the Hilbert curve of its zoom, after all tiles of the coarser zooms.

    One fold over the bit planes, highest first; each plane rotates the remaining quadrant.
    """
    z, x, y = col(z).cast("bigint"), col(x).cast("bigint"), col(y).cast("bigint")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("bigint").alias("d"))

    def plane(acc, k):
        s = F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))
        bx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        by = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        low_x, low_y = acc["x"].bitwiseAND(s - 1), acc["y"].bitwiseAND(s - 1)
        flip = (by == 0) & (bx == 1)
        fx = F.when(flip, s - 1 - low_x).otherwise(low_x)
        fy = F.when(flip, s - 1 - low_y).otherwise(low_y)
        return F.struct(
            F.when(by == 0, fy).otherwise(fx).alias("x"),
            F.when(by == 0, fx).otherwise(fy).alias("y"),
            (acc["d"] + s * s * (bx * 3).bitwiseXOR(by)).alias("d"),
        )

    planes = F.when(z > 0, F.sequence(z - 1, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    before = ((F.call_function("shiftleft", F.lit(1).cast("bigint"), (z * 2).cast("int")) - 1) / 3).cast("bigint")
    return before + F.aggregate(planes, start, plane, lambda acc: acc["d"])


# --- search cells ---------------------------------------------------------------------------------------------
# Latitude bands of equal height; each band is cut into cells about as wide as they are high, so cells near the
# poles do not degenerate.  A cell id packs (band, index).  Whatever the cell width, `cells_around` lists every
# cell that a circle can touch, so joins on it are exact.  A latitude beyond a pole has bands of its own, cut as at the place
# that distances take it for (on the far side of the pole), so there too a circle meets a few cells.

def _folded(lat: Column) -> Column:
    """Degrees from the equator of any latitude; unchanged up to the poles."""
    a = F.abs(lat)
    return F.abs(a - F.floor(a / 180.0 + 0.5) * 180.0)


def _band(lat, size_deg) -> Column:
    return F.floor((col(lat) + 90.0) / size_deg)


def _cells_in_band(band: Column, size_deg) -> Column:
    low, high = _folded(band * size_deg - 90.0), _folded((band + 1) * size_deg - 90.0)
    edge = F.least(F.greatest(low, high), F.lit(89.9))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (360.0 / size_deg))).cast("bigint")


def size_for(metres: float) -> float:
    """Cell height in degrees for a search distance; never so fine that a circle spans many cells."""
    return max(metres / 110000.0, 1e-5)


def cell_of(lng, lat, size_deg) -> Column:
    band = _band(lat, size_deg)
    n = _cells_in_band(band, size_deg)
    idx = F.pmod(F.floor((col(lng) + 180.0) / 360.0 * n), n)
    return (band * _BAND + idx).cast("bigint")


def cell_width(lat, size_deg) -> Column:
    """Width in degrees of longitude of the cells in the band of a latitude."""
    return 360.0 / _cells_in_band(_band(lat, size_deg), size_deg)


def cells_around(lng, lat, reach_deg, size_deg) -> Column:
    """Every cell that a circle of ``reach_deg`` degrees of latitude around the point may touch."""
    lng, lat = col(lng), col(lat)
    reach = (reach_deg if isinstance(reach_deg, Column) else F.lit(float(reach_deg))) * 1.0001
    top = _folded(lat) + reach
    dlng = F.when(top >= 89.5, F.lit(180.0)).otherwise(
        F.least(F.lit(180.0), reach / F.cos(F.radians(top)) * 1.001)
    )
    bands = F.sequence(_band(lat - reach, size_deg), _band(lat + reach, size_deg))

    def in_band(band):
        n = _cells_in_band(band, size_deg)
        lo = F.floor((lng - dlng + 180.0) / 360.0 * n)
        hi = F.floor((lng + dlng + 180.0) / 360.0 * n)
        hi = F.least(hi, lo + n - 1)
        return F.transform(F.sequence(lo, hi), lambda i: (band * _BAND + F.pmod(i, n)).cast("bigint"))

    return F.flatten(F.transform(bands, in_band))
