"""Point-in-polygon joins by an index of cells that carry clipped edges.

A polygon becomes cells of a grid fine enough for its number of vertices.  A cell that no edge touches is wholly inside or not
listed.  A border cell carries the edges that touch it and one parity, so that a point meets only those edges, whatever
the polygon has elsewhere.

The exact test counts edges that a ray to the east crosses.  Of the edges that do not touch the point's cell those west
of it are never crossed, and a chain of others is crossed as often, modulo two, as its two ends lie on different sides
of the point's latitude.  Chain ends outside the cell's latitudes are a constant; the others are ends of edges in the
cell, marked there.  The answer therefore equals the count over all edges bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Cell sizes are 360 degrees over these powers of two.
LEVELS = tuple(range(2, 23, 2))
#: Polygons with no more vertices go whole into the cells of their box.
WHOLE = 32
#: Most cells from side to side of a polygon.
MOST_CELLS = 256
#: An index of no more cells is left to the planner, which may broadcast it.
BROADCAST_CELLS = 10_000
#: Degrees by which cells count as touched, far above rounding and far below any cell.
EPS = 1e-9
_BOX = ["_west", "_south", "_east", "_north"]
_CELL = ["_lv", "_cx", "_cy"]
_RINGS = "array<struct<hole:boolean,odd:int,edges:array<struct<ax:double,ay:double,bx:double,by:double,fa:int,fb:int>>>>"


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def with_bounds(areas: DataFrame, rings: str = "rings") -> DataFrame:
    outer = F.col(rings)[0]
    lngs, lats = F.transform(outer, lambda p: p["lng"]), F.transform(outer, lambda p: p["lat"])
    return (areas.withColumn("west", F.array_min(lngs)).withColumn("east", F.array_max(lngs))
            .withColumn("south", F.array_min(lats)).withColumn("north", F.array_max(lats)))


def _leveled(areas: DataFrame, rings: str) -> DataFrame:
    """Add ``_v`` (vertices), the box and ``_lv``: the finest level at which the box spans some square root of them."""
    d = with_bounds(areas, rings).withColumns({b: F.col(b[1:]) for b in _BOX}).withColumn("_v", F.aggregate(F.col(rings), F.lit(0), lambda a, r: a + F.size(r)))
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    across = F.when(F.col("_v") <= WHOLE, 4.0).otherwise(F.least(F.lit(float(MOST_CELLS)), F.greatest(F.lit(8.0), F.sqrt("_v"))))
    level = F.lit(LEVELS[0])
    for lv in LEVELS[1:]:
        level = F.when(span <= across * (360.0 / (1 << lv)), lv).otherwise(level)
    return d.withColumn("_lv", level.cast("int"))


def _whole_cells(areas: DataFrame, rings: str) -> DataFrame:
    """Small polygons under the cells of their box, with all edges."""
    size = _size(F.col("_lv"))

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        edge = lambda i: F.struct(
            ring[i]["lng"].alias("ax"), ring[i]["lat"].alias("ay"), ring[F.pmod(i - 1, n)]["lng"].alias("bx"), ring[F.pmod(i - 1, n)]["lat"].alias("by"),
            F.lit(0).alias("fa"), F.lit(0).alias("fb"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), edge)).otherwise(F.array())

    rows = F.transform(F.col(rings), lambda r, i: F.struct((i > 0).alias("hole"), F.lit(0).alias("odd"), edges(r).alias("edges")))
    cover = lambda lo, hi, zero: F.explode(F.sequence(F.floor((F.col(lo) + zero) / size), F.floor((F.col(hi) + zero) / size)))
    d = areas.withColumn("_all", rows.cast(_RINGS))  # once a polygon, not once a cell
    # a ring crossed at its two upright sides only is a rectangle to the test: its box says all
    up = F.filter(F.col("_all")[0]["edges"], lambda e: e["ay"] != e["by"])
    side = lambda e, x: (e["ax"] == F.col(x)) & (e["bx"] == F.col(x)) & (F.least(e["ay"], e["by"]) == F.col("_south")) & (F.greatest(e["ay"], e["by"]) == F.col("_north"))
    plain = (F.size("_all") == 1) & (F.size(up) == 2) & F.exists(up, lambda e: side(e, "_west")) & F.exists(up, lambda e: side(e, "_east")) & (F.col("_west") < F.col("_east"))
    d = d.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    d = d.withColumn("_rings", F.when(F.col("_plain"), F.array().cast(_RINGS)).otherwise(F.col("_all"))).drop("_all")
    return d.withColumn("_cx", cover("_west", "_east", 180.0)).withColumn("_cy", cover("_south", "_north", 90.0))


def _x_at(lat, e: str = "") -> Column:
    """Where the edge meets a latitude: the same expression, in the same order, as in the exact test."""
    ax, ay, bx, by = (F.col(f"{e}{c}") for c in ("ax", "ay", "bx", "by"))
    return (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)) + ax


def _columns(ax: Column, ay: Column, bx: Column, by: Column, row: Column, size: Column) -> tuple[Column, Column]:
    """First and last column of the cells in ``row`` that an edge touches; nulls if it misses the row."""
    low = F.greatest(F.least(ay, by), row * size - 90.0 - EPS)
    high = F.least(F.greatest(ay, by), (row + 1) * size - 90.0 + EPS)
    x = lambda lat: ax + (bx - ax) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - ay) / (by - ay)))
    flat = ay == by
    lo = F.when(flat, F.least(ax, bx)).otherwise(F.least(x(low), x(high)))
    hi = F.when(flat, F.greatest(ax, bx)).otherwise(F.greatest(x(low), x(high)))
    col = lambda v: F.when(low <= high, F.floor((v + 180.0) / size))
    return col(lo - EPS), col(hi + EPS)


def _clipped_cells(areas: DataFrame, rings: str) -> DataFrame:
    """``_area``, ``_cx``, ``_cy``, ``_rings`` of the cells of large polygons (``_area``, ``_lv``, rings)."""
    size = _size(F.col("_lv"))

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        at = lambda i, c: ring[F.pmod(i, n)][c]
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            at(i, "lng").alias("ax"), at(i, "lat").alias("ay"), at(i - 1, "lng").alias("bx"), at(i - 1, "lat").alias("by"),
            at(i + 1, "lng").alias("nx"), at(i + 1, "lat").alias("ny"), at(i - 2, "lng").alias("qx"), at(i - 2, "lat").alias("qy")))

    each = areas.select("_area", "_lv", F.posexplode(rings).alias("_ring", "_points")).where(F.size("_points") > 0)
    e = each.select("_area", "_lv", "_ring", F.inline(edges(F.col("_points"))))
    row_of = lambda lat: F.floor((lat + 90.0) / size)
    e = e.withColumn("_cy", F.explode(F.sequence(row_of(F.least("ay", "by") - EPS), row_of(F.greatest("ay", "by") + EPS))))
    span = lambda a, b: _columns(F.col(f"{a}x"), F.col(f"{a}y"), F.col(f"{b}x"), F.col(f"{b}y"), F.col("_cy"), size)
    named = {}
    for k, (a, b) in {"e": ("a", "b"), "n": ("n", "a"), "q": ("b", "q")}.items():
        named[f"_{k}0"], named[f"_{k}1"] = span(a, b)
    mid = (F.col("_cy") + 0.5) * size - 90.0
    e = e.withColumns(named).where("_e0 is not null").withColumn("_mx", F.when((F.col("ay") > mid) != (F.col("by") > mid), _x_at(mid)))
    home = F.when(F.col("_mx").isNotNull(), F.least(F.col("_e1"), F.greatest(F.col("_e0"), F.floor((F.col("_mx") + 180.0) / size))))
    e = e.withColumn("_home", home).withColumn("_cx", F.explode(F.sequence("_e0", "_e1")))
    # the neighbour is no edge of this cell and not west of it
    far = lambda k: F.when(F.col(f"_{k}0").isNull() | (F.col(f"_{k}0") > F.col("_cx")), 1).otherwise(0)
    centre = (F.col("_cx") + 0.5) * size - 180.0
    crossed = F.when(F.col("_mx") > centre, 1).otherwise(0)
    e = e.withColumns({"fa": far("n"), "fb": far("q"), "_here": F.when(F.col("_home") == F.col("_cx"), 1).otherwise(0)})
    e = e.withColumns({"_right": F.col("_here") * crossed, "_near": crossed + F.col("fa") * (F.col("ay") > mid).cast("int") + F.col("fb") * (F.col("by") > mid).cast("int")})
    border = e.groupBy("_area", "_ring", "_cy", "_cx").agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by", "fa", "fb")).alias("edges"), F.sum("_here").alias("_here"), F.sum("_right").alias("_right"), F.sum("_near").alias("_near"))
    # edges that cross the middle of the row, counted from the east: what a point at the centre of a cell sees
    w = Window.partitionBy("_area", "_ring", "_cy").orderBy(F.col("_cx").desc())
    border = border.withColumns({"_east": F.coalesce(F.sum("_here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_next": F.lag("_cx").over(w)})
    hole = (F.col("_ring") > 0).alias("hole")
    touched = border.select("_area", "_cy", "_cx", hole, F.pmod(F.col("_east") + F.col("_right") + F.col("_near"), F.lit(2)).cast("int").alias("odd"), "edges")
    run = border.where("_next > _cx + 1 and pmod(_east, 2) = 1")
    inside = run.select("_area", "_cy", F.explode(F.sequence(F.col("_cx") + 1, F.col("_next") - 1)).alias("_cx"), hole, F.lit(1).alias("odd"), F.slice("edges", 1, 0).alias("edges"))
    cells = touched.unionByName(inside).groupBy("_area", "_cy", "_cx").agg(F.collect_list(F.struct("hole", "odd", "edges")).alias("_rings"))
    gone = F.exists("_rings", lambda r: r["hole"] & (F.size(r["edges"]) == 0))  # wholly in a hole
    return cells.where(F.exists("_rings", lambda r: ~r["hole"]) & ~gone).withColumn("_rings", F.col("_rings").cast(_RINGS))


def polygon_index(areas: DataFrame, rings: str = "rings") -> DataFrame:
    """The cells of all polygons: the columns of ``areas`` but ``rings``, the cell, the polygon's box, ``_plain`` if it is a
    rectangle, and else ``_rings``: per ring a parity and the edges that touch the cell.  Written, so that any number of joins can use it; jobs run when this is called.

    The first ring is the outer one, the others are holes.  Null or empty rings have no cells.
    """
    rest = [c for c in areas.columns if c != rings]
    d = _leveled(areas, rings).where(F.size(rings) > 0)
    small = _whole_cells(d.where(F.col("_v") <= WHOLE), rings).select(*rest, *_CELL, *_BOX, "_plain", "_rings")
    large = cut_lineage(d.where(F.col("_v") > WHOLE).select(*rest, rings, "_lv", *_BOX, F.monotonically_increasing_id().alias("_area")))
    cells = _clipped_cells(large, rings).join(large.drop(rings), "_area").select(*rest, *_CELL, *_BOX, F.lit(False).alias("_plain"), "_rings")
    return cut_lineage(small.unionByName(cells))


def in_rings(rings: Column, lng: Column, lat: Column) -> Column:
    """Inside the outer ring and outside every hole, from what a cell carries."""

    def odd(r: Column) -> Column:
        def crossing(e: Column) -> Column:
            x = (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
            above_a, above_b = e["ay"] > lat, e["by"] > lat
            return F.when((above_a != above_b) & (lng < x), 1).otherwise(0) + e["fa"] * above_a.cast("int") + e["fb"] * above_b.cast("int")

        return F.aggregate(r["edges"], r["odd"], lambda acc, e: acc + crossing(e)) % 2 == 1

    return F.forall(rings, lambda r: odd(r) != r["hole"])


def points_in_index(points: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of points (lng, lat) and the polygons of an index that contain them.

    A point is listed once per level that occurs.  A point with a null coordinate is in no polygon.
    """
    count = {r["_lv"]: r["count"] for r in index.groupBy("_lv").count().collect()}  # eleven rows at most
    levels = sorted(count)
    cell = lambda v, zero, lv: F.floor((F.col(v) + zero) / (360.0 / (1 << lv)))
    at = F.array(*[F.struct(F.lit(lv).alias("_lv"), cell("lng", 180.0, lv).alias("_cx"), cell("lat", 90.0, lv).alias("_cy")) for lv in levels or LEVELS[:1]])
    listed = points.withColumn("_at", F.explode(at)).select(*[F.col(c) for c in points.columns], "_at.*")
    if sum(count.values()) > BROADCAST_CELLS:
        listed = listed.hint("merge")  # exploded points look as small as their source to the planner: they must not be collected
    # a cell reaches beyond the polygon's box: what is outside the box is told by four comparisons, with room for rounding
    boxed = F.col("lng").between(F.col("_west") - EPS, F.col("_east") + EPS) & F.col("lat").between(F.col("_south") - EPS, F.col("_north") + EPS)
    rectangle = ((F.col("_south") > F.col("lat")) != (F.col("_north") > F.col("lat"))) & (F.col("lng") < F.col("_east")) & (F.col("lng") >= F.col("_west"))
    exact = F.when(F.col("_plain"), rectangle).otherwise(in_rings(F.col("_rings"), F.col("lng"), F.col("lat")))
    pairs = listed.join(index, _CELL).where(boxed & exact)
    return pairs.drop(*_CELL, *_BOX, "_plain", "_rings")
