"""Spatial joins written as equi-joins on cell keys, followed by the exact test.

Catalyst sees hash or sort-merge joins it can plan, broadcast by measured size and re-split when a cell is hot;
nothing here forces a broadcast or a nested loop.  Candidate pairs are aggregated in the stage that makes them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, geo, text
from ..functions.lookup import lookup
from . import polygons

# Fixed values.
SETTLEMENT_RANK = {"city": 4, "town": 3, "village": 2, "hamlet": 1}
TOWN_LIMIT_MI = 40.0
TOWN_BOX_DEG = (0.8, 0.6)
LINE_MATCH_M = 40.0
_BOX_LEVELS = (2, 5, 8, 11)


# --- radius joins ---------------------------------------------------------------------------------------------

def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows over all tasks before a step that makes many rows of each; a small file would else be one task's work."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def within_radius(
    points: DataFrame,
    targets: DataFrame,
    radius_m: float,
    earth: float = geo.EARTH_EQUATORIAL_M,
    strict: bool = False,
    extra: Column | None = None,
    on: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of a point (``lng``, ``lat``) and a target (``t_lng``, ``t_lat``) no further apart than the radius.

    Targets keep one row each; a point is listed under every cell its circle touches.  ``dist_m`` is added.  Both sides
    have the columns ``on`` and meet only where these are equal.
    """
    size = max(cells.size_for(radius_m), 1e-4)
    p = points.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).withColumn(
        "_cell", F.explode(cells.cells_around("lng", "lat", cells.size_for(radius_m), size))
    )
    t = targets.where(F.col("t_lng").isNotNull() & F.col("t_lat").isNotNull()).withColumn(
        "_cell", cells.cell_of("t_lng", "t_lat", size)
    )
    d = geo.haversine("lng", "lat", "t_lng", "t_lat", earth)
    box = F.abs(F.col("lat") - F.col("t_lat")) <= radius_m / 110000.0
    pairs = p.join(t, ["_cell", *on]).where(box)
    if extra is not None:
        pairs = pairs.where(extra)
    pairs = pairs.withColumn("dist_m", d)
    keep = F.col("dist_m") < radius_m if strict else F.col("dist_m") <= radius_m
    return pairs.where(keep).drop("_cell")


AT = ["lng", "lat"]


def locations(points: DataFrame) -> DataFrame:
    """Distinct positions: however many copies a position has, it is searched once."""
    return points.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select(*AT).distinct()


def nearest(pairs: DataFrame, keys: list[str], order: list[Column], pick: dict[str, Column]) -> DataFrame:
    """One row per key: the pair that sorts first.  Aggregates before the shuffle."""
    row = F.struct(*[c.alias(n) for n, c in pick.items()])
    best = pairs.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[n].alias(n) for n in pick])


def k_nearest(pairs: DataFrame, point_id: str, target_id: str, k: int, rank: str = "rank") -> DataFrame:
    """The k closest targets of every point; Spark prunes to k per task before it shuffles."""
    w = Window.partitionBy(point_id).orderBy("dist_m", target_id)
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def k_nearest_by_density(
    points: DataFrame, targets: DataFrame, point_id: str, target_id: str, k: int, max_m: float | None = None,
    earth: float = geo.EARTH_EQUATORIAL_M, on: tuple[str, ...] = (), finest_m: float = 15.0,
) -> DataFrame:
    """The k closest targets (``t_lng``, ``t_lat``) of every point, ties by id, at most ``max_m`` away (None: anywhere)."""
    p = points.select(*dict.fromkeys([*on, point_id, *AT]))
    return k_nearest(near_by_density(p, targets, k, max_m, earth, on, finest_m), point_id, target_id, k)


def near_by_density(
    points: DataFrame, targets: DataFrame, k: int, max_m: float | None = None, earth: float = geo.EARTH_EQUATORIAL_M,
    on: tuple[str, ...] = (), finest_m: float = 15.0, box: tuple[float, float] | None = None, step: float = 4.0,
) -> DataFrame:
    """Pairs that hold the k closest targets (``t_lng``, ``t_lat``) of every point and some multiple of k in all.

    The search radius follows the density: targets are counted in cells of a ladder of sizes, each ``1 / step`` of the one
    above.  If the cell around a point holds k of them, all lie within the cell's extent, so that radius is certain to
    reach the k closest; the smallest such cell is taken.  Where none holds k, the search goes to ``max_m``, or without one to
    all targets with equal ``on``, fewer than k in any cell.  A point so meets some multiple of k targets however many
    lie within ``max_m``.  With ``box`` only targets at most so many degrees of longitude and latitude away count.
    Rows without a position are left out on both sides; equal points are searched once.
    """
    top = max_m if max_m is not None else 20_100_000.0
    radii = [top]
    while radii[-1] / step >= finest_m:
        radii.append(radii[-1] / step)
    p = points.where(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    t = targets.where(F.col("t_lng").isNotNull() & F.col("t_lat").isNotNull())

    full = _on_ladder(t.select(*on, "t_lng", "t_lat"), radii).select(*on, "_level", cells.cell_of("t_lng", "t_lat", F.col("_size")).alias("_cell"))
    full = full.groupBy(*on, "_level", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    full = full.where(F.col("_n") >= k).select(*on, "_level", "_cell", F.lit(True).alias("_full"))
    fits = _extent(earth) <= F.col("_r")
    if box is not None:
        fits = fits & (cells.cell_width("lat", F.col("_size")) <= box[0]) & (F.col("_size") <= box[1])
    a = _on_ladder(p, radii).select(*p.columns, "_level", F.when(fits, cells.cell_of("lng", "lat", F.col("_size"))).alias("_cell"))
    a = a.join(full.hint("merge"), [*on, "_level", "_cell"], "left").groupBy(*p.columns).agg(
        F.max(F.when(F.col("_full"), F.col("_level")).otherwise(0)).alias("_level"))

    a, t = _listed(a, t, radii, everywhere=max_m is None)
    # an exploded table looks as small as its source to the planner: it must not be collected for a broadcast
    near = a.join(t.hint("merge"), [*on, "_level", "_cell"]).withColumn("dist_m", geo.haversine("lng", "lat", "t_lng", "t_lat", earth))
    reach = F.element_at(F.array(*[F.lit(r) for r in radii]), F.col("_level") + 1)
    near = near.where((F.col("dist_m") <= reach) if max_m is not None else (F.col("dist_m") <= reach) | (F.col("_level") == 0))
    if box is not None:
        near = near.where((F.abs(F.col("t_lng") - F.col("lng")) <= box[0]) & (F.abs(F.col("t_lat") - F.col("lat")) <= box[1]))
    return near.drop("_level", "_cell")


def _on_ladder(df: DataFrame, radii: list[float]) -> DataFrame:
    """Each row once per rung below the top: ``_level``, radius ``_r`` and height ``_size`` of its cells in degrees."""
    rungs = [F.struct(F.lit(i).alias("_level"), F.lit(r).alias("_r"), F.lit(r / 2.2 / 111_320.0).alias("_size")) for i, r in enumerate(radii)][1:]
    if not rungs:  # no rung fits: one that certifies nothing
        rungs = [F.struct(F.lit(0).alias("_level"), F.lit(0.0).alias("_r"), F.lit(1.0).alias("_size"))]
    return df.withColumn("_rung", F.explode(F.array(*rungs))).select(*df.columns, "_rung.*")


def _extent(earth: float) -> Column:
    """Metres that no two positions of the cell around a point can be apart: along the point's parallel to the other's
    longitude, then along the meridian."""
    return (F.col("_size") + cells.cell_width("lat", F.col("_size")) * F.abs(F.cos(F.radians("lat")))) * (math.pi / 180 * earth)


def _listed(points: DataFrame, targets: DataFrame, radii: list[float], everywhere: bool) -> tuple[DataFrame, DataFrame]:
    """Points under the cells around them at their own ``_level``, targets under their cell at every level; at level 0
    everything shares a cell if the search goes ``everywhere``."""
    here = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_level") + 1)
    reach, size = here([cells.size_for(r) for r in radii]), here([max(cells.size_for(r), 1e-4) for r in radii])
    around, at = cells.cells_around("lng", "lat", reach, size), cells.cell_of("t_lng", "t_lat", size)
    if everywhere:
        zero = F.lit(0).cast("bigint")
        around, at = F.when(F.col("_level") == 0, F.array(zero)).otherwise(around), F.when(F.col("_level") == 0, zero).otherwise(at)
    t = targets.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(len(radii))])))
    return points.withColumn("_cell", F.explode(around)), t.withColumn("_cell", at)


def best_by_density(
    points: DataFrame, targets: DataFrame, k: int, weight: float, on: tuple[str, ...] = (), worth: str = "worth",
    earth: float = geo.EARTH_EQUATORIAL_M, finest_m: float = 400.0,
) -> DataFrame:
    """Pairs that hold, for every point, the k targets with most ``worth - weight * log10(miles + 1)``, and some multiple of k in all.

    As ``near_by_density``, but a cell around a point stands for the k-th highest worth in it: k targets score at least
    that at the cell's extent, so one with the group's highest worth is beaten wherever its distance alone costs more.
    The cell with the smallest radius found so is taken; where no cell holds k, all targets with equal ``on`` are listed.
    """
    mi = geo.METRES_PER_MILE
    radii = [20_100_000.0]
    while radii[-1] / 2 >= finest_m:
        radii.append(radii[-1] / 2)
    p = points.where(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    t = targets.where(F.col("t_lng").isNotNull() & F.col("t_lat").isNotNull())

    h = _on_ladder(spread(t.select(*on, worth, "t_lng", "t_lat")), radii)
    h = h.select(*on, worth, "_level", cells.cell_of("t_lng", "t_lat", F.col("_size")).alias("_cell"))
    nth = F.row_number().over(Window.partitionBy(*on, "_level", "_cell").orderBy(F.desc(worth)))
    full = h.withColumn("_n", nth).where(F.col("_n") == k).select(*on, "_level", "_cell", F.col(worth).alias("_kth"))
    best = t.groupBy(*on).agg(F.max(worth).alias("_best"))
    ext = _extent(earth)
    a = _on_ladder(spread(p), radii).select(
        *p.columns, "_level", F.when(ext <= F.col("_r"), cells.cell_of("lng", "lat", F.col("_size"))).alias("_cell"), ext.alias("_ext"))
    a = a.join(full.hint("merge"), [*on, "_level", "_cell"], "left")
    a = a.join(best, list(on)) if on else a.crossJoin(best)
    cost = F.log10(F.col("_ext") / mi + 1) + (F.col("_best") - F.col("_kth")) / weight
    reach = (F.pow(F.lit(10.0), cost) - 1) * mi * 1.000001 + 0.01
    a = a.groupBy(*p.columns).agg(F.min(reach).alias("_reach"))
    level = F.lit(0)
    for i, r in enumerate(radii[1:], 1):
        level = F.when(F.col("_reach") <= r, i).otherwise(level)
    a, t = _listed(a.withColumn("_level", level), spread(t), radii, everywhere=True)
    d = geo.haversine("lng", "lat", "t_lng", "t_lat", earth)
    near = spread(a).join(t.hint("merge"), [*on, "_level", "_cell"])
    return near.where((d <= F.col("_reach")) | (F.col("_level") == 0)).drop("_level", "_cell", "_reach")


def nearest_town(places: DataFrame, limit_mi: float = TOWN_LIMIT_MI, only: DataFrame | None = None) -> DataFrame:
    """Best settlement anchor of every non-settlement place: distance discounted by how well known the town is.

    ``only`` limits the places that are asked about; towns always come from all ``places``.
    """
    rank = lookup("detail", SETTLEMENT_RANK)
    towns = (
        places.where(F.col("kind") == "locality")
        .withColumn("t_rank", rank)
        .where(F.col("t_rank").isNotNull())
        .groupBy("t_rank", F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"))
        .agg(F.min("place_id").alias("town_id"))
    )
    points = (places if only is None else only).where(F.col("kind") != "locality").select("place_id", *AT)
    # among towns of one rank the nearest is best, so only that one of each rank competes
    ranks = F.explode(F.array(*[F.lit(r) for r in SETTLEMENT_RANK.values()])).alias("t_rank")
    pairs = near_by_density(spread(locations(points), *AT).select(*AT, ranks), towns, 1, limit_mi * geo.METRES_PER_MILE,
                            on=("t_rank",), finest_m=1000.0, box=TOWN_BOX_DEG, step=2.0)
    score = F.col("dist_m") / (1 + 2 * F.col("t_rank"))
    best = nearest(pairs, AT, [score, F.col("town_id")], {"town_id": F.col("town_id"), "dist_m": F.col("dist_m")})
    names = places.where(F.col("kind") == "locality").groupBy(F.col("place_id").alias("town_id")).agg(F.first("name").alias("town"))
    return points.join(best, AT).drop(*AT).join(names, "town_id").select("place_id", "town_id", "town", "dist_m")


def relative_to(viewers: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Distance, bearing and direction of every node from its group's viewer (one viewer per group)."""
    v = viewers.select(group, F.col("lng").alias("v_lng"), F.col("lat").alias("v_lat"))
    j = nodes.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).join(v, group)
    m = geo.haversine("v_lng", "v_lat", "lng", "lat")
    brg = geo.bearing("v_lng", "v_lat", "lng", "lat")
    miles = F.col("dist_m") / geo.METRES_PER_MILE
    near = F.concat(geo.round_half_up(F.col("dist_m") * geo.FEET_PER_METRE).cast("string"), F.lit(" ft"))
    far = F.concat(
        F.when(miles < 10, text.fixed(miles, 2)).otherwise(text.fixed(miles, 1)), F.lit(" mi")
    )
    return (
        j.withColumn("dist_m", m)
        .withColumn("bearing", brg)
        .withColumn("direction", geo.cardinal("bearing"))
        .withColumn("text", F.concat(F.when(miles < 0.1, near).otherwise(far), F.lit(" "), F.col("direction")))
        .drop("v_lng", "v_lat")
    )


# --- lines ----------------------------------------------------------------------------------------------------

def line_segments(lines: DataFrame, line_id: str, parts: str = "parts") -> DataFrame:
    """One row per consecutive vertex pair inside each part; a gap between parts is never bridged.

    A feature without any pair keeps its lone vertices as ``single`` rows.
    """
    part = lines.select(line_id, F.posexplode(parts).alias("part", "_pts"))
    has_pair = part.groupBy(line_id).agg(F.max(F.size("_pts")).alias("_longest"))
    seg = part.where(F.size("_pts") > 1).select(
        line_id, "part",
        F.posexplode(F.arrays_zip(
            F.slice("_pts", F.lit(1), F.size("_pts") - 1).alias("a"), F.slice("_pts", F.lit(2), F.size("_pts") - 1).alias("b")
        )).alias("seq", "_s"),
    ).select(line_id, "part", "seq", F.col("_s.a.lng").alias("alng"), F.col("_s.a.lat").alias("alat"),
             F.col("_s.b.lng").alias("blng"), F.col("_s.b.lat").alias("blat"), F.lit(False).alias("single"))
    lone = (
        part.join(has_pair.where(F.col("_longest") == 1), line_id, "left_semi")
        .where(F.size("_pts") == 1)
        .select(line_id, "part", F.lit(0).alias("seq"), F.col("_pts")[0]["lng"].alias("alng"),
                F.col("_pts")[0]["lat"].alias("alat"), F.col("_pts")[0]["lng"].alias("blng"),
                F.col("_pts")[0]["lat"].alias("blat"), F.lit(True).alias("single"))
    )
    return seg.unionByName(lone)


def nearest_line_within(
    points: DataFrame, segments: DataFrame, point_id: str, line_id: str, max_m: float = LINE_MATCH_M
) -> DataFrame:
    """Nearest line strictly closer than ``max_m`` for every point that has one.

    Segments are listed under every cell their buffer touches; a point looks in its own cell only.
    """
    reach = cells.size_for(max_m)
    size = max(4 * reach, 0.002)
    steps = F.greatest(
        F.lit(1),
        F.ceil(F.greatest(F.abs(F.col("blng") - F.col("alng")), F.abs(F.col("blat") - F.col("alat"))) / (size / 2)),
    )
    # Copies of one geometry tie at every point, and the lowest id wins a tie: keep only that one.
    shape = ["alng", "alat", "blng", "blat", "single"]
    s = segments.groupBy(*shape).agg(F.min(line_id).alias(line_id)).withColumn("_n", steps)
    at = F.transform(
        F.sequence(F.lit(0), F.col("_n").cast("int")),
        lambda i: cells.cells_around(
            F.col("alng") + (F.col("blng") - F.col("alng")) * (i / F.col("_n")),
            F.col("alat") + (F.col("blat") - F.col("alat")) * (i / F.col("_n")),
            reach + size / 4,
            size,
        ),
    )
    s = s.withColumn("_cell", F.explode(F.array_distinct(F.flatten(at))))
    p = locations(points).withColumn("_cell", cells.cell_of("lng", "lat", size))
    flat = geo.segment_distance_m("lng", "lat", "alng", "alat", "blng", "blat")
    d = F.when(F.col("single"), geo.haversine("lng", "lat", "alng", "alat")).otherwise(flat)
    pairs = p.join(s, "_cell").withColumn("dist_m", d).where(F.col("dist_m") < max_m)
    best = nearest(pairs, AT, [F.col("dist_m"), F.col(line_id)],
                   {line_id: F.col(line_id), "dist_m": F.col("dist_m")})
    return points.select(point_id, *AT).join(best, AT).drop(*AT)


# --- boxes and polygons ---------------------------------------------------------------------------------------

def _level_size(level: int) -> float:
    return 360.0 / (1 << level)


def box_cells(boxes: DataFrame) -> DataFrame:
    """List a box (west, south, east, north) under the cells of the finest level where it spans at most 9 x 9."""
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.lit(_BOX_LEVELS[0])
    for lv in _BOX_LEVELS[1:]:
        level = F.when(span <= 8 * _level_size(lv), lv).otherwise(level)
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_lv"))

    def rng(lo, hi):
        return F.sequence(F.floor(lo / size), F.floor(hi / size))

    return (
        boxes.withColumn("_lv", level.cast("int"))
        .withColumn("_cx", F.explode(rng(F.col("west") + 180.0, F.col("east") + 180.0)))
        .withColumn("_cy", F.explode(rng(F.col("south") + 90.0, F.col("north") + 90.0)))
    )


def point_levels(points: DataFrame) -> DataFrame:
    """List a point once per box level."""
    rows = F.array(*[
        F.struct(
            F.lit(lv).alias("_lv"),
            F.floor((F.col("lng") + 180.0) / _level_size(lv)).alias("_cx"),
            F.floor((F.col("lat") + 90.0) / _level_size(lv)).alias("_cy"),
        )
        for lv in _BOX_LEVELS
    ])
    return points.withColumn("_l", F.explode(rows)).select(*[F.col(c) for c in points.columns], "_l.*")


BOX_SHARE = 4096  # copies of one box that ride in one array


def points_in_boxes(points: DataFrame, boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """Pairs of points and the boxes (plus a margin in degrees) that hold them, edges included.

    Boxes of equal extent are searched as one and listed again only in the rows that leave the join.
    """
    b = boxes
    if margin:
        b = (b.withColumn("west", F.col("west") - margin).withColumn("east", F.col("east") + margin)
             .withColumn("south", F.col("south") - margin).withColumn("north", F.col("north") + margin))
    extent = ["west", "south", "east", "north"]
    rest = [c for c in boxes.columns if c not in extent]
    if rest:
        nth = F.row_number().over(Window.partitionBy(*extent).orderBy(rest[0]))
        b = b.withColumn("_share", F.floor((nth - 1) / BOX_SHARE)).groupBy(*extent, "_share").agg(F.collect_list(F.struct(*rest)).alias("_boxes")).drop("_share")
    inside = F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    d = point_levels(spread(points)).join(box_cells(b), ["_lv", "_cx", "_cy"]).where(inside).drop("_lv", "_cx", "_cy")
    if not rest:
        return d
    return d.withColumn("_box", F.explode("_boxes")).select(*points.columns, *[F.col(c) if c in extent else F.col("_box")[c].alias(c) for c in boxes.columns])


def box_ring() -> Column:
    """Closed ring of a box row, as the outer ring of a polygon."""
    corner = lambda x, y: F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))
    return F.array(F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"),
                           corner("west", "north"), corner("west", "south")))


def points_in_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of points and the polygons that contain them.  Parts of a multipolygon are separate rows.

    Only clipped edges meet the points; for many joins with the same polygons make ``polygons.polygon_index`` once.
    """
    return polygons.points_in_index(points, polygons.polygon_index(areas))


def recover_labels(areas: DataFrame, labels: DataFrame, same_kind_first: bool = True) -> DataFrame:
    """Name of an unnamed polygon from a label point inside it: a label of its own kind first, else any."""
    lab = labels.select("label_id", F.col("name").alias("label"), F.col("kind").alias("label_kind"), "lng", "lat")
    pairs = points_in_areas(lab, areas)
    order = [F.col("label_id")]
    if same_kind_first:
        order = [F.col("label_kind") != F.col("kind"), *order]
    return nearest(pairs, ["area_id"], order, {"name": F.col("label"), "label_id": F.col("label_id")})


# --- water ----------------------------------------------------------------------------------------------------

# Fixed values.
STILL_WATER_KINDS = ["water", "lake", "reservoir", "pond", "lagoon", "basin"]
FLOWING_KINDS = ["river", "stream", "canal"]
FISHABLE_KINDS = ["water", "lake", "reservoir", "river", "stream", "canal", "pond", "basin", "lagoon"]
FLOWING_NAME = r"\b(river|creek|brook|stream|slough|canal|ditch|bayou|wash)\b"
STILL_NAME = r"\b(lake|reservoir|pond|lagoon|basin)\b"


def distance_to_water(points: DataFrame, water: DataFrame, radius_m: float = 3000.0) -> DataFrame:
    """Distance to the nearest vertex of fishable water; null when there is none within the radius.

    A plain radius, where an interactive map would also clip to the screen.
    """
    vertices = (
        water.where(F.col("kind").isin(FISHABLE_KINDS))
        .select(F.explode(F.flatten("parts")).alias("v"))
        .select(F.col("v.lng").alias("t_lng"), F.col("v.lat").alias("t_lat"))
        .distinct()
    )
    near = within_radius(locations(points), vertices, radius_m, geo.EARTH_MEAN_M)
    return points.join(near.groupBy(*AT).agg(F.min("dist_m").alias("water_m")), AT, "left")


def water_label(name, kind) -> Column:
    name, kind = geo.col(name), geo.col(kind)
    low = F.lower(name)
    return (
        F.when(kind == "river", "river").when(kind == "stream", "creek").when(kind == "canal", "canal")
        .when((kind == "reservoir") | low.rlike(r"\breservoir\b"), "reservoir")
        .when(low.rlike(r"\bcreek\b"), "creek")
        .when(low.rlike(r"\briver\b|\bslough\b|\bbayou\b"), "river")
        .when(low.rlike(r"\bcanal\b|\bditch\b"), "canal")
        .otherwise("lake")
    )


def water_anchor_points(water: DataFrame) -> DataFrame:
    """One point per named water feature: the point itself, or the middle vertex of the longest part of a line."""
    longest = F.aggregate(
        "parts", F.col("parts")[0], lambda best, part: F.when(F.size(best) >= F.size(part), best).otherwise(part)
    )
    still_or_flow = F.col("kind").isin(STILL_WATER_KINDS + FLOWING_KINDS)
    point = F.when((F.col("geom_type") == "Point") & still_or_flow, F.col("parts")[0][0]).when(
        (F.col("geom_type") == "LineString") & F.col("kind").isin(FLOWING_KINDS),
        F.element_at(longest, F.floor(F.size(longest) / 2).cast("int") + 1),
    )
    return (
        water.where(F.coalesce(F.col("name"), F.lit("")) != "")
        .withColumn("_p", point)
        .where(F.col("_p").isNotNull())
        .select("water_id", "name", "kind", F.col("_p.lng").alias("t_lng"), F.col("_p.lat").alias("t_lat"))
    )


def _miles_pairs(points: DataFrame, water_points: DataFrame, max_mi: float) -> DataFrame:
    # The cells must be generous enough for the radius in miles of this job's own Earth.
    pairs = within_radius(locations(points), water_points, max_mi * 1615.0)
    return pairs.withColumn("dist_mi", geo.haversine("lng", "lat", "t_lng", "t_lat", geo.EARTH_MEAN_MI)).where(
        F.col("dist_mi") <= max_mi
    )


def nearby_water(points: DataFrame, water_points: DataFrame, point_id: str, max_mi: float = 80.0) -> DataFrame:
    """Nearest instance of every water name around a point, labelled.

    A device reads a capped number of tiles per zoom; here every feature within the radius is considered.
    """
    instances = water_points.where(F.col("t_lng").isNotNull() & F.col("t_lat").isNotNull()).groupBy("name", "t_lng", "t_lat").agg(
        F.min_by(F.struct("water_id", "kind"), "water_id").alias("w")
    ).select("name", "t_lng", "t_lat", "w.*")
    # the water is listed under all cells in reach and a point under its own, so that a cell's points get their whole answer at once
    reach = cells.size_for(max_mi * 1615.0)
    here = locations(points).withColumn("_cell", cells.cell_of("lng", "lat", reach / 4))
    around = instances.withColumn("_cell", F.explode(cells.cells_around("t_lng", "t_lat", reach, reach / 4)))
    kinds = dict(instances.dtypes)
    schema = ", ".join([f"{c} double" for c in AT] + [f"{c} {kinds[c]}" for c in ("name", "water_id", "kind", "t_lng", "t_lat")] + ["dist_mi double"])
    best = here.groupBy("_cell").cogroup(around.groupBy("_cell")).applyInArrow(lambda p, t: _nearest_of_each_name(p, t, max_mi), schema)
    named = best.withColumn("label", water_label("name", "kind"))
    return points.select(point_id, *AT).join(named, AT).drop(*AT)


PAIR_BLOCK = 500_000  # distances worked out at once


def _nearest_of_each_name(points: pa.Table, water: pa.Table, max_mi: float) -> pa.Table:
    """The nearest water of every name at most ``max_mi`` from each point, equal distances by the lowest id."""
    water = water.sort_by([("name", "ascending"), ("water_id", "ascending")])
    lng, lat, t_lng, t_lat = (np.radians(c.to_numpy()) for c in (points["lng"], points["lat"], water["t_lng"], water["t_lat"]))
    at, of, metres = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(t_lng):
        names = water["name"].combine_chunks()
        starts = np.append(0, np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1)
        width, cos_t, no = np.diff(np.append(starts, len(t_lng))), np.cos(t_lat), np.arange(len(t_lng))
        rows = max(1, PAIR_BLOCK // len(t_lng))
        for lo in range(0, len(lng), rows):
            x, y = lng[lo : lo + rows, None], lat[lo : lo + rows, None]
            s = np.sin((t_lat - y) / 2) ** 2 + np.cos(y) * cos_t * np.sin((t_lng - x) / 2) ** 2
            d = (2.0 * geo.EARTH_MEAN_MI) * np.arcsin(np.sqrt(np.minimum(s, 1.0)))
            least = np.minimum.reduceat(d, starts, axis=1)
            first = np.minimum.reduceat(np.where(d == np.repeat(least, width, axis=1), no, len(no)), starts, axis=1)
            i, j = np.nonzero(least <= max_mi)
            at.append(i + lo), of.append(first[i, j]), metres.append(least[i, j])
    p, t = points.select(AT).take(np.concatenate(at)), water.take(np.concatenate(of))
    out = {c: p[c] for c in AT} | {c: t[c] for c in ("name", "water_id", "kind", "t_lng", "t_lat")}
    return pa.table(out | {"dist_mi": np.concatenate(metres)})


def nearest_lake_name(points: DataFrame, water_points: DataFrame, point_id: str, max_mi: float = 3.0) -> DataFrame:
    """Nearest still-water name; a flowing name is out unless it also says lake, pond and the like."""
    low = F.lower("name")
    still = water_points.where(
        ~F.col("kind").isin(FLOWING_KINDS) & ~(low.rlike(FLOWING_NAME) & ~low.rlike(STILL_NAME))
    ).groupBy("t_lng", "t_lat").agg(F.min("water_id").alias("water_id"), F.min_by("name", "water_id").alias("name"))
    pairs = _miles_pairs(points, still, max_mi)
    best = nearest(pairs, AT, [F.col("dist_mi"), F.col("water_id")],
                   {"lake": F.col("name"), "dist_mi": F.col("dist_mi")})
    return points.select(point_id, *AT).join(best, AT).drop(*AT)


# --- tiles and runs -------------------------------------------------------------------------------------------

def tile_range(boxes: DataFrame, zmin, zmax) -> DataFrame:
    """Tile ranges x0..x1, y0..y1 of every box at every zoom, clamped to the map."""
    z = F.col("z")
    last = (F.pow(F.lit(2.0), z) - 1).cast("bigint")

    def clamp(v):
        return F.greatest(F.lit(0).cast("bigint"), F.least(last, F.floor(v)))

    lim = 85.05112877980659
    lng = lambda c: F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.col(c)))
    zmin = zmin if isinstance(zmin, Column) else F.lit(zmin)
    zmax = zmax if isinstance(zmax, Column) else F.lit(zmax)
    return (
        boxes.where((F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")) & (zmin <= zmax))
        .withColumn("z", F.explode(F.sequence(zmin, zmax)))
        .withColumn("x0", clamp(cells.tile_xf(lng("west"), z)))
        .withColumn("x1", clamp(cells.tile_xf(lng("east"), z)))
        .withColumn("y0", clamp(cells.tile_yf(cells.clamp_lat("north", lim), z)))
        .withColumn("y1", clamp(cells.tile_yf(cells.clamp_lat("south", lim), z)))
        .withColumn("tiles", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))
    )


def tile_cover(boxes: DataFrame, zmin, zmax) -> DataFrame:
    """Every tile of every zoom that covers the boxes."""
    return (
        tile_range(boxes, zmin, zmax)
        .withColumn("x", F.explode(F.sequence("x0", "x1")))
        .withColumn("y", F.explode(F.sequence("y0", "y1")))
        .drop("x0", "x1", "y0", "y1", "tiles")
    )


_RUN_SHIFTS = (6, 12, 18, 24, 30, 36)


def run_range_join(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Match ``id`` into the run ``[start, start + run_length)`` that holds it; unmatched ids are dropped.

    A run is listed under the buckets it touches at a bucket width close to its own length.
    """
    shift = F.lit(_RUN_SHIFTS[-1])
    for k in reversed(_RUN_SHIFTS[:-1]):
        shift = F.when(F.col("run_length") <= (1 << (k + 4)), k).otherwise(shift)
    b = runs.where(F.col("run_length") > 0).withColumn("_k", shift.cast("int")).withColumn(
        "_b",
        F.explode(F.expr("sequence(shiftright(start, _k), shiftright(start + run_length - 1, _k))")),
    )
    a = ids.withColumn("_l", F.explode(F.array(*[
        F.struct(F.lit(k).alias("_k"), F.shiftright("id", k).alias("_b")) for k in _RUN_SHIFTS
    ]))).select(*[F.col(c) for c in ids.columns], "_l.*")
    hit = (F.col("id") >= F.col("start")) & (F.col("id") < F.col("start") + F.col("run_length"))
    return a.join(b, ["_k", "_b"]).where(hit).drop("_k", "_b")
