"""Small pieces of DuckDB SQL used by the oracle statements."""

from __future__ import annotations

from ..functions.geo import COMPASS_POINTS


def hav(lng1, lat1, lng2, lat2, r=6378137.0) -> str:
    s = (
        f"pow(sin(radians(({lat2})-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians(({lng2})-({lng1}))/2),2)"
    )
    return f"(2*{r!r}*asin(sqrt({s})))"


def fmod(x, n) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def bearing(lng1, lat1, lng2, lat2) -> str:
    dl = f"radians(({lng2})-({lng1}))"
    y = f"sin({dl})*cos(radians({lat2}))"
    x = f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))*cos({dl})"
    return fmod(f"degrees(atan2({y},{x}))+360.0e0", "360.0e0")


def cardinal(deg) -> str:
    names = ",".join(f"'{p}'" for p in COMPASS_POINTS)
    return f"([{names}])[cast(floor({fmod(deg, '360.0e0')}/22.5e0+0.5e0) as int) % 16 + 1]"


def seg_dist(px, py, ax, ay, bx, by) -> str:
    """Flat-earth point-to-segment distance."""
    kx = f"(111320.0e0*cos(radians({py})))"
    ky = "110574.0e0"
    dx, dy = f"((({px})-({ax}))*{kx})", f"((({py})-({ay}))*{ky})"
    ex, ey = f"((({bx})-({ax}))*{kx})", f"((({by})-({ay}))*{ky})"
    l2 = f"({ex}*{ex}+{ey}*{ey})"
    t = f"(case when {l2}=0 then 0.0e0 else greatest(0.0e0,least(1.0e0,({dx}*{ex}+{dy}*{ey})/{l2})) end)"
    return f"sqrt(pow({dx}-{ex}*{t},2)+pow({dy}-{ey}*{t},2))"


def tile_x(lng, z) -> str:
    return f"((({lng})+180.0e0)/360.0e0*pow(2.0e0,{z}))"


def tile_y(lat, z) -> str:
    return f"((1.0e0-ln(tan(radians({lat}))+1.0e0/cos(radians({lat})))/pi())/2.0e0*pow(2.0e0,{z}))"


def case_map(expr: str, table: dict, default: str = "null") -> str:
    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"case {expr} {whens} else {default} end"


def lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}e0"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ",".join(lit(v) for v in values) + ")"


def thousands(n: str) -> str:
    """Whole number with comma separators."""
    return f"format('{{:,}}', cast({n} as bigint))"


def fixed(x: str, places: int) -> str:
    return f"printf('%.{places}f', {x})"
