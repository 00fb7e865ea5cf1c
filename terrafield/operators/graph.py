"""Road graphs: building, components, stitching, snapping and batch shortest paths."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, geo
from ..functions.lookup import first_match, lookup
from ..session import cut_lineage, forget
from . import ordered, spatial

# Fixed values.
CLASS_COST = {"major_road": 1.0, "minor_road": 1.35, "path": 6.0}
DETAIL_COST = {"track": 2.5, "steps": 40.0, "sidewalk": 12.0, "crossing": 12.0, "footway": 10.0, "pier": 20.0,
               "corridor": 20.0, "raceway": 20.0}
OTHER_COST = 3.0
NODE_MASK = {"major_road": 1, "minor_road": 2}
MAJOR = 1
STITCH_M, MAJOR_STITCH_M, MAX_LINKS = 25.0, 250.0, 4
SNAP_CANDIDATES, SNAP_M, SNAP_SLACK_M, ON_ROAD_M, ON_ROAD_SLACK_M = 60, 1000.0, 250.0, 25.0, 60.0
ROUTE_SNAP_M = 2000.0
ZOOMS = [14, 13, 12, 11, 10]
MAX_TILES = 1400
MIN_PAD_M, MAX_PAD_M, PAD_SHARE = 3000.0, 15000.0, 0.35


# --- building -------------------------------------------------------------------------------------------------

def routable(segs: DataFrame) -> DataFrame:
    """Roads and paths with at least two points; rail and runways are out."""
    detail = F.coalesce("detail", F.lit(""))
    return segs.where(F.col("kind").isin(list(CLASS_COST)) & ~detail.isin("runway", "taxiway") & (F.size("coords") >= 2))


def node_key(lng, lat) -> Column:
    """Vertices equal to six decimals share this id; it needs no lookup and no shuffle."""
    q = lambda v: (F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5)).cast("bigint")
    return (q(geo.col(lng)) + 180_000_000) * 268_435_456 + q(geo.col(lat)) + 90_000_000


def road_name() -> Column:
    generic = F.when(F.col("detail") == "track", "forest road").when(F.col("kind") == "path", "trail").otherwise("unnamed road")
    return F.coalesce(F.nullif("ref", F.lit("")), F.nullif("name", F.lit("")), generic)


def build_graph(segs: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a road table; every edge carries cost, metres and the road it belongs to.

    ``within``: columns of ``segs`` that tell graphs apart, such as the pair whose corridor a road lies in.  A road may be
    in any number of graphs; nodes and edges carry the columns too.
    """
    s = routable(segs)
    v = s.select(*within, "seg_id", "kind", F.posexplode("coords").alias("pos", "c")).select(
        *within, "seg_id", "pos", node_key("c.lng", "c.lat").alias("node_id"), F.col("c.lng").alias("lng"), F.col("c.lat").alias("lat"),
        lookup("kind", NODE_MASK, 4).alias("mask"),
    )
    nodes = v.groupBy(*within, "node_id").agg(
        F.min_by(F.struct("lng", "lat"), F.struct("seg_id", "pos")).alias("c"), F.bit_or("mask").alias("mask")
    ).select(*within, "node_id", "c.lng", "c.lat", "mask")

    cost = F.coalesce(lookup("detail", DETAIL_COST), lookup("kind", CLASS_COST), F.lit(OTHER_COST))
    n = F.size("coords")
    pairs = F.arrays_zip(F.slice("coords", F.lit(1), n - 1).alias("a"), F.slice("coords", F.lit(2), n - 1).alias("b"))
    e = s.select(*within, "seg_id", "kind", road_name().alias("name"), F.coalesce("oneway", F.lit(False)).alias("oneway"), cost.alias("mult"),
                 F.explode(pairs).alias("p"))
    e = e.select(*within, "seg_id", "kind", "name", "oneway", "mult", node_key("p.a.lng", "p.a.lat").alias("src"),
                 node_key("p.b.lng", "p.b.lat").alias("dst")).where("src <> dst")
    at = lambda p: nodes.select(*within, F.col("node_id").alias(p), F.col("lng").alias(f"{p}_lng"), F.col("lat").alias(f"{p}_lat"))
    e = e.join(at("src"), [*within, "src"]).join(at("dst"), [*within, "dst"])
    e = e.withColumn("meters", geo.haversine("src_lng", "src_lat", "dst_lng", "dst_lat", geo.EARTH_MEAN_M))
    both = F.when(F.col("oneway"), F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    edges = e.withColumn("_d", F.explode(both)).select(
        *within, "_d.src", "_d.dst", (F.col("meters") * F.col("mult")).alias("cost"), "meters", "seg_id", "name", "kind"
    )
    return nodes, edges


def segment_endpoints(segs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Node ids at either end of every routable segment."""
    ends = F.array(F.element_at("coords", 1), F.element_at("coords", -1))
    return routable(segs).select(*within, F.explode(ends).alias("c")).select(*within, node_key("c.lng", "c.lat").alias("node_id")).distinct()


# --- components -----------------------------------------------------------------------------------------------

#: Edges whose components one task settles by itself.
LOCAL_EDGES = 500_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node id it is connected to, ignoring direction."""
    label = _labels(cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    ))
    return nodes.drop("comp").join(label, "node_id", "left").withColumn("comp", F.coalesce("comp", "node_id"))


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node each is connected to by them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u):], np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return ids, ids[root]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _local_roots(batches):
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if parts:
        ids, root = _roots(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["node_id", "comp"])


def _labels(e: DataFrame) -> DataFrame:
    """Smallest connected id (``comp``) of the ends of undirected edges (``u``, ``v``; a result of ``cut_lineage``).

    Each range of edges is settled in its task; what is left are links between the roots of nodes that lie in more than
    one range, a graph of its own.  Where that hardly shrinks, as when ranges have nothing to do with the
    map, stars take over.
    """
    n = e.count()
    tasks = math.ceil(n / LOCAL_EDGES) or 1
    local = cut_lineage(e.repartitionByRange(tasks, "u", "v").mapInArrow(_local_roots, "node_id bigint, comp bigint"))
    if tasks == 1:
        return local
    first = local.groupBy("node_id").agg(F.min("comp").alias("v"), F.max("comp").alias("_x")).where("v <> _x").drop("_x")
    links = cut_lineage(local.join(first, "node_id").where("comp <> v").select(F.col("comp").alias("u"), "v").distinct())
    above = _labels(links) if links.count() <= n / 2 else _stars(links)
    up = above.select(F.col("node_id").alias("comp"), F.col("comp").alias("_up"))
    return local.join(up, "comp", "left").groupBy("node_id").agg(F.min(F.coalesce("_up", "comp")).alias("comp"))


def _stars(e: DataFrame) -> DataFrame:
    """``_labels`` by alternating large-star and small-star steps (Kiveris et al., 2014).

    Each is a map-side minimum per node and an equi-join, and the number of rounds grows with the logarithm of the
    graph, not with its diameter.  Rounds go on until nothing changes; each round's table is deleted once the next is written.
    """
    before, written = None, e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        ).distinct()
        last, e = written, cut_lineage(e)
        forget(last)
        written = e
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == before:
            return e.select(F.col("u").alias("node_id"), F.col("v").alias("comp"))
        before = row


def component_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"))


# --- stitching ------------------------------------------------------------------------------------------------

def stitch_links(endpoints: DataFrame, nodes: DataFrame, tol_m: float = STITCH_M, within: tuple[str, ...] = ()) -> DataFrame:
    """Gaps to bridge: a segment end and up to four nearest vertices of other components.

    The tolerance is wider between two major roads.  Distances are exact everywhere; a grid whose width comes from
    the mean latitude could miss a pair far north of it.
    """
    wide = max(tol_m, MAJOR_STITCH_M)
    ends = nodes.join(endpoints.select("node_id").distinct(), "node_id", "left_semi")
    targets = nodes.select(*within, F.col("node_id").alias("t_id"), F.col("mask").alias("t_mask"), F.col("comp").alias("t_comp"),
                           F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"))
    both_major = F.col("mask").bitwiseAND(F.col("t_mask")).bitwiseAND(F.lit(MAJOR)) > 0
    pairs = spatial.within_radius(ends, targets, wide, geo.EARTH_MEAN_M, extra=F.col("comp") != F.col("t_comp"), on=within)
    pairs = pairs.where(F.col("dist_m") <= F.when(both_major, wide).otherwise(tol_m))
    near = spatial.k_nearest(pairs, "node_id", "t_id", MAX_LINKS)
    return near.groupBy(F.least("node_id", "t_id").alias("a"), F.greatest("node_id", "t_id").alias("b")).agg(
        F.min("dist_m").alias("meters")
    )


def _numbered(nodes: DataFrame, edges: DataFrame, ends: DataFrame, within: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids that are unique over all graphs, in the order of graph and node id; ``vertex`` keeps the node's own id."""
    key = [*within, "node_id"]
    n = nodes.repartitionByRange(*key).sortWithinPartitions(*key).withColumnRenamed("node_id", "vertex")
    n = cut_lineage(n.withColumn("node_id", F.monotonically_increasing_id()))
    own = lambda name: n.select(*within, F.col("vertex").alias(name), F.col("node_id").alias(f"_{name}"))
    e = edges.join(own("src"), [*within, "src"]).join(own("dst"), [*within, "dst"])
    e = e.withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).drop("_src", "_dst")
    ids = ends.withColumnRenamed("node_id", "vertex").join(n.select(*within, "vertex", "node_id"), [*within, "vertex"]).select("node_id")
    return n, e, ids


def plain_graph(segs: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with their components, edges, ends of segments) before any gap is bridged; written once, read by every stitching."""
    nodes, edges = build_graph(segs, within)
    ends = segment_endpoints(segs, within)
    if within:
        nodes, edges, ends = _numbered(nodes, edges, ends, within)
    edges = cut_lineage(edges)
    return cut_lineage(components(nodes, edges)), edges, cut_lineage(ends)


def stitched_graph(segs: DataFrame, tol_m: float = STITCH_M, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Graph with gaps bridged by free links in both directions, and components over the result.

    With ``within`` there is a graph for every value of these columns, all built together: roads of one graph never
    join, stitch or connect those of another.  Node ids are then numbers of their own (``vertex`` has the usual id).
    """
    return stitch(*plain_graph(segs, within), tol_m, within)


def stitch(nodes: DataFrame, edges: DataFrame, ends: DataFrame, tol_m: float, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``stitched_graph`` of a ``plain_graph``; links connect whole components, so that only these are labelled again."""
    links = cut_lineage(stitch_links(ends, nodes, tol_m, within))
    if links.limit(1).count() == 0:
        return nodes, edges
    comp = lambda end: nodes.select(F.col("node_id").alias(end), F.col("comp").alias(f"_{end}"))
    joined = links.join(comp("a"), "a").join(comp("b"), "b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v"))
    top = _labels(cut_lineage(joined.distinct())).select(F.col("node_id").alias("comp"), F.col("comp").alias("_top"))
    none = F.lit(None)
    link = links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                          F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("d"), "meters").select(
        "d.src", "d.dst", F.col("meters").alias("cost"), "meters", none.cast("bigint").alias("seg_id"),
        none.cast("string").alias("name"), none.cast("string").alias("kind"))
    if within:
        link = link.join(nodes.select(F.col("node_id").alias("src"), *within), "src")
    edges = cut_lineage(edges.unionByName(link))
    nodes = nodes.join(top, "comp", "left").withColumn("comp", F.coalesce("_top", "comp")).drop("_top")
    return cut_lineage(nodes), edges


# --- snapping -------------------------------------------------------------------------------------------------

def knn_nodes(points: DataFrame, nodes: DataFrame, point_id: str, k: int = SNAP_CANDIDATES, max_m: float = SNAP_M, within: tuple[str, ...] = ()) -> DataFrame:
    """Up to k nearest graph nodes within a radius; with ``within`` nodes of the point's own graph."""
    t = nodes.select(*within, "node_id", "comp", F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"))
    near = spatial.k_nearest_by_density(points, t, point_id, "node_id", k, max_m, geo.EARTH_MEAN_M, on=within)
    return near.select(point_id, "node_id", "comp", "dist_m", "rank")


def snap_pairs(od: DataFrame, nodes: DataFrame, max_m: float = SNAP_M, k: int = SNAP_CANDIDATES, within: tuple[str, ...] = ()) -> DataFrame:
    """Start and goal node of every pair: in one component, with the smallest summed distance.

    A point may pass over its nearest node, but only so far: 60 m when it is on a road, 250 m otherwise, or four
    times the nearest distance.
    """
    def side(name: str) -> DataFrame:
        p = od.select(*dict.fromkeys(["od_id", *within]), F.col(f"{name}.lng").alias("lng"), F.col(f"{name}.lat").alias("lat"))
        c = knn_nodes(p, nodes, "od_id", k, max_m, within)
        # the candidate list has at most k rows per pair, so this window is bounded
        near = F.min("dist_m").over(Window.partitionBy("od_id"))
        slack = F.greatest(F.when(near <= ON_ROAD_M, ON_ROAD_SLACK_M).otherwise(SNAP_SLACK_M), near * 4)
        c = c.withColumn("_max", F.least(F.lit(max_m), slack)).where("dist_m <= _max")
        return c.groupBy("od_id", "comp").agg(F.min(F.struct("dist_m", "node_id")).alias(name))

    j = side("from").join(side("to"), ["od_id", "comp"])
    total = F.col("from.dist_m") + F.col("to.dist_m")
    best = j.groupBy("od_id").agg(F.min(F.struct(total.alias("sum"), F.col("from").alias("f"), F.col("to").alias("t"))).alias("b"))
    return best.select("od_id", F.col("b.f.node_id").alias("start"), F.col("b.t.node_id").alias("goal"),
                       F.col("b.f.dist_m").alias("snapped_from_m"), F.col("b.t.dist_m").alias("snapped_to_m"))


# --- corridors ------------------------------------------------------------------------------------------------

def corridor_boxes(od: DataFrame) -> DataFrame:
    """Box around both ends of a pair, padded by a share of the direct distance, unwrapped at the antimeridian."""
    fl, fa, tl, ta = F.col("from.lng"), F.col("from.lat"), F.col("to.lng"), F.col("to.lat")
    direct = geo.haversine(fl, fa, tl, ta, geo.EARTH_MEAN_M)
    pad = F.least(F.greatest(F.lit(MIN_PAD_M), F.col("direct_m") * PAD_SHARE), F.lit(MAX_PAD_M))
    pad_lng = pad / (geo.METRES_PER_DEG_LNG * F.greatest(F.lit(0.2), F.cos(F.radians((fa + ta) / 2))))
    pad_lat = pad / geo.METRES_PER_DEG_LNG
    turn = F.when(F.abs(tl - fl) > 180, tl + F.when(tl < fl, 360.0).otherwise(-360.0)).otherwise(tl)
    return od.withColumn("direct_m", direct).withColumn("_tl", turn).select(
        *od.columns, "direct_m",
        (F.least(fl, F.col("_tl")) - pad_lng).alias("west"), (F.greatest(fl, F.col("_tl")) + pad_lng).alias("east"),
        (F.least(fa, ta) - pad_lat).alias("south"), (F.greatest(fa, ta) + pad_lat).alias("north"),
    )


def corridors(od: DataFrame, zooms: list[int] = ZOOMS, max_tiles: int = MAX_TILES) -> DataFrame:
    """Tile range per zoom for every pair, only zooms within the tile budget."""
    z = F.col("z")
    d = corridor_boxes(od).withColumn("z", F.explode(F.array(*[F.lit(i) for i in zooms])))
    d = (
        d.withColumn("x0", F.floor(cells.tile_xf("west", z))).withColumn("x1", F.floor(cells.tile_xf("east", z)))
        .withColumn("y0", F.floor(cells.tile_yf("north", z))).withColumn("y1", F.floor(cells.tile_yf("south", z)))
    )
    return d.withColumn("tiles", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).where(F.col("tiles") <= max_tiles)


# --- shortest paths -------------------------------------------------------------------------------------------

def cheapest_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered node pair: the cheapest, then the lowest road id."""
    own = [c for c in ("od_id",) if c in edges.columns]  # a graph per pair: both nodes are this pair's
    best = edges.groupBy("src", "dst", *own).agg(
        F.min_by(F.struct("cost", "meters", "seg_id", "name", "kind"), F.struct("cost", F.coalesce("seg_id", F.lit(-1)))).alias("e")
    )
    return best.select("src", "dst", *own, "e.*")


def _in_box(lng: float, lat: float, west: float, south: float, east: float, north: float) -> bool:
    """``west`` or ``east`` may lie beyond the antimeridian."""
    return south <= lat <= north and any(west <= lng + turn <= east for turn in (0.0, 360.0, -360.0))


def _straight_m(lng: float, lat: float, to_lng: float, to_lat: float) -> float:
    a, b = math.radians(lat), math.radians(to_lat)
    s = math.sin(math.radians(to_lat - lat) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(to_lng - lng) / 2) ** 2
    return 2 * geo.EARTH_MEAN_M * math.asin(math.sqrt(min(s, 1.0)))


def _relax_block(key: tuple, labels: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Settle every pair's labels inside one block and hand over the labels that leave it; none leaves its pair's box.

    Labels are taken in the order of cost plus straight line to the goal, so that those which cannot beat the best known way to it
    stay out and a short way costs little in a large block.  Of equal costs the one by the lowest node stays.
    """
    src, dst, node = (d[c].to_numpy() for d, c in ((edges, "src"), (edges, "dst"), (labels, "node")))
    ids = np.unique(np.concatenate([src, dst, node]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    lng, lat = np.empty(len(ids)), np.empty(len(ids))
    for i, x, y in ((s, edges["slng"], edges["slat"]), (d, edges["dlng"], edges["dlat"]), (np.searchsorted(ids, node), labels["lng"], labels["lat"])):
        lng[i], lat[i] = x, y
    order = np.argsort(s, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]).tolist()
    to, weight, stays = d[order].tolist(), edges["cost"].to_numpy()[order].tolist(), edges["inside"].to_numpy()[order].tolist()
    lng, lat, name = lng.tolist(), lat.tolist(), ids.tolist()
    boxed = "west" in labels.columns
    labels = labels.sort_values("od_id", kind="stable")
    od = labels["od_id"].to_numpy()
    cuts = [0, *(np.flatnonzero(od[1:] != od[:-1]) + 1).tolist(), len(od)]
    at = np.searchsorted(ids, labels["node"].to_numpy()).tolist()
    cost, pred, active = labels["cost"].tolist(), labels["pred"].tolist(), labels["active"].tolist()
    goals, to_lngs, to_lats, bounds = (labels[c].tolist() for c in ("_goal", "_gl", "_ga", "_bound"))
    boxes = list(zip(*(labels[c].tolist() for c in ("west", "south", "east", "north")))) if boxed else None
    od_col, node_col, cost_col, pred_col, cross_col = [], [], [], [], []
    for lo, hi in zip(cuts, cuts[1:]):
        goal, to_lng, to_lat, bound = goals[lo], to_lngs[lo], to_lats[lo], bounds[lo]
        limit = math.inf if bound is None or math.isnan(bound) else bound * (1 + 1e-9)
        box = boxes[lo] if boxed else None
        dist, came, ahead = {}, {}, {}
        for i in range(lo, hi):
            n = at[i]
            if not active[i] and (n not in dist or (cost[i], pred[i]) < (dist[n], came[n])):
                dist[n], came[n] = cost[i], pred[i]
        better, leaving, heap = set(), {}, []
        for i in range(lo, hi):
            n = at[i]
            if active[i] and (n not in dist or (cost[i], pred[i]) < (dist[n], came[n])):
                if cost[i] < dist.get(n, math.inf):
                    ahead[n] = _straight_m(lng[n], lat[n], to_lng, to_lat)
                    heap.append((cost[i] + ahead[n], cost[i], n))
                dist[n], came[n] = cost[i], pred[i]
                better.add(n)
        heapq.heapify(heap)
        while heap:
            f, c, n = heapq.heappop(heap)
            if f > limit:
                break
            if c > dist[n]:
                continue
            own = name[n]
            for k in range(first[n], first[n + 1]):
                m, t = to[k], c + weight[k]
                if stays[k]:
                    known = dist.get(m, math.inf)
                    if t > known or t == known and (own >= came[m] or c == t):
                        continue
                else:
                    known, by = leaving.get(m, (math.inf, 0))
                    if t > known or t == known and own >= by:
                        continue
                if box and not _in_box(lng[m], lat[m], *box):
                    continue
                left = ahead.get(m)
                if left is None:
                    left = ahead[m] = _straight_m(lng[m], lat[m], to_lng, to_lat)
                if t + left > limit:
                    continue
                if name[m] == goal:
                    limit = t * (1 + 1e-9)
                if stays[k]:
                    dist[m], came[m] = t, own
                    better.add(m)
                    if t < known:
                        heapq.heappush(heap, (t + left, t, m))
                else:
                    leaving[m] = (t, own)
        found = [(n, dist[n], came[n], False) for n in better] + [(n, *x, True) for n, x in leaving.items()]
        # what the goal, if it was reached meanwhile, has shown to be of no use stays out
        found = [x for x in found if limit == math.inf or x[1] + ahead.get(x[0], 0.0) <= limit]
        od_col += [int(od[lo])] * len(found)
        for col, i in ((node_col, 0), (cost_col, 1), (pred_col, 2), (cross_col, 3)):
            col += [x[i] for x in found]
    goal_of = dict(zip(od.tolist(), goals))
    return pd.DataFrame({
        "od_id": od_col, "node": [name[n] for n in node_col], "cost": cost_col, "pred": pred_col, "crossed": cross_col,
        "is_goal": [name[n] == goal_of[o] for n, o in zip(node_col, od_col)], "lng": [lng[n] for n in node_col], "lat": [lat[n] for n in node_col]})


#: Nodes that a block may hold in the first round and in late ones, pairs and labels of a task, and sides of blocks to choose from, in degrees.
BLOCK_NODES, LATE_NODES = 30_000, 400_000
PAIRS, LATE_PAIRS = 1024, 32
BLOCK_SIDES = [0.1 * 2 ** k for k in range(13)]
_LABEL = "od_id bigint, node bigint, cost double, pred bigint, crossed boolean, is_goal boolean, lng double, lat double"


def _block(lng: Column, lat: Column, side: float) -> Column:
    return (F.floor(lng / side) * 1_000_000 + F.floor(lat / side)).cast("bigint")


def _block_sides(nodes: DataFrame, lot: list[Column]) -> tuple[float, float]:
    """The largest sides at which no block (of one ``lot`` of graphs) holds more than ``BLOCK_NODES`` and ``LATE_NODES`` nodes, else the smallest."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _block(F.col("lng"), F.col("lat"), s).alias("block")) for s in BLOCK_SIDES]))
    n = nodes.select("lng", "lat", *lot).select(*[c for c in ("salt",) if lot], sides.alias("s"))
    n = n.groupBy("s", *[c for c in ("salt",) if lot]).count().groupBy("s.side").agg(F.max("count").alias("most")).collect()
    most = lambda limit: max([r.side for r in n if r.most <= limit], default=BLOCK_SIDES[0])
    return most(BLOCK_NODES), most(LATE_NODES)


def _lots(n: int, each: int) -> Column:
    return F.pmod(F.xxhash64("od_id"), F.lit(max(1, math.ceil(n / each)))).cast("bigint")


def _search(
    od: DataFrame, nodes: DataFrame, edges: DataFrame, block_deg: float | None = None, pairs_per_task: int | None = None,
) -> tuple[DataFrame, DataFrame, float]:
    """Labels found in all rounds (several of a pair and node; the least cost, then the lowest ``pred`` holds), pairs with their
    goals, and the side of the largest blocks.

    The map is cut into blocks, as large as a task can hold unless ``block_deg`` is given.  A round settles all active (pair, block) groups at once, each with the block's own
    edges, then hands labels that cross a border to the neighbouring block.  Rounds count block crossings, not
    hops, and blocks grow from round to round: many short ways end in the first, few long ones go on and share large blocks.  A round
    reads and writes the labels of the pairs that are still on their way only.  Edges with an ``od_id`` serve that pair alone; else pairs that start in one block
    share a task, and its edges.  Labels that cannot beat the best goal cost, straight line included, or that leave the pair's box (west,
    south, east, north, if given) are dropped.  A group holds one block and a bounded number of pairs.
    """
    spark = od.sparkSession
    cores = spark.sparkContext.defaultParallelism
    own = "od_id" in edges.columns
    each = pairs_per_task or (16 if own else PAIRS)
    n_od = od.count()
    tasks = max(1, min(4 * cores, math.ceil(n_od / 16)))
    salt = _lots(n_od, each).alias("salt")
    side, most = (block_deg, block_deg) if block_deg else _block_sides(nodes, [salt] if own and "od_id" in nodes.columns else [])
    place = nodes.select(F.col("node_id").alias("node"), "lng", "lat")
    at = lambda end: place.select(F.col("node").alias(end), F.col("lng").alias(f"{end[0]}lng"), F.col("lat").alias(f"{end[0]}lat"))
    e = cheapest_edges(edges).select("src", "dst", "cost", *[salt] * own).join(at("src"), "src").join(at("dst"), "dst")
    road = ["src", "dst", "cost", "slng", "slat", "dlng", "dlat"]
    e = cut_lineage(e.select(*["salt"] * own, *road))
    boxed = "west" in od.columns
    box = ["west", "south", "east", "north"] if boxed else []
    goals = od.select("od_id", F.col("goal").alias("_goal"), *box).join(
        place.select(F.col("node").alias("_goal"), F.col("lng").alias("_gl"), F.col("lat").alias("_ga")), "_goal"
    )
    start = od.select("od_id", F.col("start").alias("node"), (F.col("start") == F.col("goal")).alias("is_goal")).join(place, "node")
    log = [cut_lineage(start.select("od_id", "node", F.lit(0.0).alias("cost"), F.col("node").alias("pred"), F.lit(True).alias("crossed"), "is_goal", "lng", "lat"))]
    if own:
        goals = goals.select("*", salt)
    else:
        starts = log[0].select("od_id", _block(F.col("lng"), F.col("lat"), side).alias("_from"))
        lots = starts.groupBy("_from").agg(F.ceil(F.count(F.lit(1)) / each).alias("_lots"))
        lot = F.xxhash64("_from", F.pmod(F.xxhash64("od_id"), "_lots"))
        goals = goals.join(starts.join(lots, "_from").select("od_id", lot.alias("salt")), "od_id")
    goals = cut_lineage(goals)
    tables = lambda made: spark.read.schema(_LABEL).parquet(*[t.scratch for t in made])

    for turn in range(1 << 30):
        bound = tables(log).where("is_goal").groupBy("od_id").agg(F.min("cost").alias("_bound"))
        front = log[-1].where("crossed").join(goals, "od_id").join(bound, "od_id", "left")
        reach = F.col("cost") + geo.haversine("lng", "lat", "_gl", "_ga", geo.EARTH_MEAN_M)
        useful = F.col("_bound").isNull() | (reach <= F.col("_bound") * (1 + 1e-9))
        if boxed:
            turned = [(F.col("lng") + t).between(F.col("west"), F.col("east")) for t in (0.0, 360.0, -360.0)]
            useful = useful & (turned[0] | turned[1] | turned[2]) & F.col("lat").between(F.col("south"), F.col("north"))
        front = cut_lineage(front.where(useful))
        n = front.agg(F.count_distinct("od_id")).first()[0]
        if n == 0:
            return tables(log), goals, most
        now = min(most, side * 2 ** max(0, turn - 1))
        if turn > 1 and not own:  # larger blocks, fewer pairs a task, and no fewer tasks than cores while there are pairs
            few = max(LATE_PAIRS, each >> turn)
            front = front.withColumn("salt", _lots(n, min(few, max(2, n // (2 * cores)))))
        block = _block(F.col("lng"), F.col("lat"), now).alias("block")
        front = front.select("*", block)
        told = front.select("od_id", "block", "salt", "_goal", "_gl", "_ga", "_bound", *box).dropDuplicates(["od_id", "block"])
        cols = ["block", "salt", "od_id", "node", "lng", "lat", "cost", "pred", "active", "_goal", "_gl", "_ga", "_bound", *box]
        past = log[-1].where("not crossed").unionByName(tables(log[:-1])) if turn else log[-1].where("false")
        work = front.withColumn("active", F.lit(True)).select(*cols).unionByName(
            past.select("od_id", "node", "lng", "lat", "cost", "pred", block, F.lit(False).alias("active")).join(told, ["od_id", "block"]).select(*cols))
        needed = told.select(F.col("block").alias("_rb"), F.col("salt").alias("_rs")).distinct()
        there = _block(F.col("dlng"), F.col("dlat"), now)
        roads = e.withColumn("block", _block(F.col("slng"), F.col("slat"), now)).withColumn("inside", F.col("block") == there)
        mine = F.col("block") == F.col("_rb")
        roads = roads.join(needed, mine & (F.col("salt") == F.col("_rs")) if own else mine).select("_rb", "_rs", *road, "inside")
        # dealt over a fixed number of tasks: groups are short rows but much work
        work, roads = work.repartition(tasks, "block", "salt"), roads.repartition(tasks, "_rb", "_rs")
        found = work.groupBy("block", "salt").cogroup(roads.groupBy("_rb", "_rs")).applyInPandas(_relax_block, _LABEL)
        log.append(cut_lineage(found))


def shortest_costs(od: DataFrame, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Cheapest cost from each pair's start to every node that can matter for its goal (od_id, node, cost, and ``pred``, the node before)."""
    return _best(*_search(od, nodes, edges, **options)[:2])


def _best(log: DataFrame, goals: DataFrame) -> DataFrame:
    best = log.groupBy("od_id", "node").agg(F.min(F.struct("cost", "pred", "lng", "lat")).alias("b")).select("od_id", "node", "b.*")
    bound = log.where("is_goal").groupBy("od_id").agg(F.min("cost").alias("_bound"))
    reach = F.col("cost") + geo.haversine("lng", "lat", "_gl", "_ga", geo.EARTH_MEAN_M)
    best = best.join(goals.select("od_id", "_gl", "_ga"), "od_id").join(bound, "od_id", "left")
    return best.where(F.col("_bound").isNull() | (reach <= F.col("_bound") * (1 + 1e-9))).drop("_gl", "_ga", "_bound")


def shortest_paths(od: DataFrame, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Cost of the cheapest path for every pair whose goal can be reached."""
    log, _, _ = _search(od, nodes, edges, **options)
    best = log.where("is_goal").groupBy("od_id").agg(F.min("cost").alias("cost"))
    return od.join(best, "od_id").select("od_id", "start", "goal", "cost")


def _walk_back(key: tuple, at: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """From each pair's node back to its start or out of the block; the last row of a walk that goes on is the node outside."""
    pred = dict(zip(zip(labels["od_id"].tolist(), labels["node"].tolist()), labels["pred"].tolist()))
    rows = []
    for od, n, back in zip(at["od_id"].tolist(), at["node"].tolist(), at["back"].tolist()):
        while (p := pred.get((od, n))) is not None and p != n:
            rows.append((od, n, p, back, False))
            n, back = p, back + 1
        rows.append((od, n, n, back, p is None))
    return pd.DataFrame(rows, columns=["od_id", "node", "up", "back", "more"])


def trace_paths(od: DataFrame, costs: DataFrame, edges: DataFrame, side: float | None = None) -> DataFrame:
    """Node sequence of every cheapest path (od_id, hop, node, cheapest edge into it), equal costs by lowest node id.

    Paths are walked back from the goal, block by block (``side`` degrees), all pairs at once.
    """
    e = cheapest_edges(edges)
    side = side or BLOCK_SIDES[0]
    n = od.count()
    lot = _lots(n, LATE_PAIRS).alias("lot")
    labels = cut_lineage(costs.select("od_id", "node", "pred", "lng", "lat"))
    at = labels.select("od_id", "node", lot, _block(F.col("lng"), F.col("lat"), side).alias("block"))
    front = od.select("od_id", F.col("goal").alias("node"), F.lit(0).cast("bigint").alias("back"))
    path = None
    while True:
        front = cut_lineage(front.join(at, ["od_id", "node"]))
        if front.limit(1).count() == 0:
            break
        here = labels.select("od_id", "node", "pred", _block(F.col("lng"), F.col("lat"), side).alias("block"), lot).join(
            front.select("od_id", "block").distinct(), ["od_id", "block"], "left_semi")
        walked = cut_lineage(front.groupBy("lot", "block").cogroup(here.groupBy("lot", "block")).applyInPandas(
            _walk_back, "od_id bigint, node bigint, up bigint, back bigint, more boolean"))
        path = walked.where("not more") if path is None else path.unionByName(walked.where("not more"))
        front = walked.where("more").select("od_id", "node", "back")
    if path is None:
        path = od.select("od_id", F.col("goal").alias("node"), F.col("goal").alias("up"), F.lit(0).cast("bigint").alias("back")).where("false")
    length = path.groupBy("od_id").agg(F.max("back").alias("_len"))
    d = path.join(length, "od_id").withColumn("hop", F.col("_len") - F.col("back"))
    into = e.select(F.col("src").alias("up"), F.col("dst").alias("node"), "meters", "seg_id", "name", "kind")
    return d.join(into, ["up", "node"], "left").select("od_id", "hop", "node", "meters", "seg_id", "name", "kind")


def route_steps(path_edges: DataFrame) -> DataFrame:
    """Consecutive edges of one name merged; edges without a name add no step and break no run."""
    named = path_edges.where(F.coalesce("name", F.lit("")) != "")
    d = ordered.with_neighbours(named, ["od_id"], "hop", {"_before": "name"})
    change = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("name")), 1).otherwise(0)
    d = ordered.running_sum(d, ["od_id"], "hop", change, "step_no")
    return d.groupBy("od_id", "step_no").agg(F.first("name").alias("name"), F.sum("meters").alias("meters"))


def assemble_routes(od: DataFrame, snaps: DataFrame, path_edges: DataFrame) -> DataFrame:
    """One row per routed pair: metres along the path, direct metres, trail use and snap distances."""
    r = path_edges.groupBy("od_id").agg(
        F.sum("meters").alias("meters"), F.coalesce(F.bool_or(F.col("kind") == "path"), F.lit(False)).alias("used_trail"),
        F.max("hop").alias("hops"),
    ).where("hops > 0")
    direct = geo.haversine("from.lng", "from.lat", "to.lng", "to.lat", geo.EARTH_MEAN_M)
    return od.select("od_id", direct.alias("direct_m")).join(r, "od_id").join(
        snaps.select("od_id", "snapped_from_m", "snapped_to_m"), "od_id")


def route(od: DataFrame, segs: DataFrame, tol_m: float = STITCH_M, snap_m: float = SNAP_M, within: tuple[str, ...] = (), **options):
    """(routes, path edges) for a table of pairs over one road table; ``within=("od_id",)``: over each pair's own roads."""
    return route_over(od, *stitched_graph(segs, tol_m, within), snap_m, within, **options)


def route_over(od: DataFrame, nodes: DataFrame, edges: DataFrame, snap_m: float = SNAP_M, within: tuple[str, ...] = (), **options):
    """``route`` over a ``stitched_graph``."""
    snaps = cut_lineage(snap_pairs(od, nodes, snap_m, within=within).where("start <> goal"))
    log, goals, side = _search(snaps, nodes, edges, **options)
    path = cut_lineage(trace_paths(snaps, _best(log, goals), edges, side))
    return assemble_routes(od, snaps, path), path


def stitch_for(zoom: int) -> float:
    """Stitch tolerance of a zoom: coarser tiles leave wider gaps."""
    return float(math.floor(25 * 2 ** (14 - zoom) + 0.5))


def corridor_roads(plan: DataFrame, roads: DataFrame) -> DataFrame:
    """The roads of every pair's corridor (``plan``: rows of ``corridors`` of one zoom), with ``od_id``: those with a vertex in one
    of its tiles.  A road comes once for each pair whose corridor it is in."""
    z = F.col("z")
    turn = F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)))  # a corridor may reach beyond the antimeridian
    box = plan.select(
        "od_id", "z", "x0", "x1", "y0", "y1", turn.alias("_t"), cells.tile_lng("x0", "z").alias("_w"), cells.tile_lng(F.col("x1") + 1, "z").alias("_e"),
        cells.tile_lat("y0", "z").alias("_n"), cells.tile_lat(F.col("y1") + 1, "z").alias("_s"))
    box = box.withColumns({"west": F.col("_w") + F.col("_t"), "east": F.col("_e") + F.col("_t"), "south": F.col("_s"), "north": F.col("_n")}).where("west <= 180 and east >= -180")
    at = roads.select("seg_id", F.explode("coords").alias("c")).select("seg_id", "c.lng", "c.lat")
    near = spatial.points_in_boxes(at, box.drop("_t", "_w", "_e", "_n", "_s"), 1e-9)
    n = F.pow(F.lit(2.0), z).cast("long")
    inside = (F.pmod(F.floor(cells.tile_xf("lng", z)) - F.col("x0"), n) <= F.col("x1") - F.col("x0")) & F.floor(cells.tile_yf("lat", z)).between(F.col("y0"), F.col("y1"))
    return roads.drop("od_id").join(near.where(inside).select("od_id", "seg_id").distinct(), "seg_id")


def route_with_fallback(od: DataFrame, segs_by_zoom: DataFrame, zooms: list[int] = ZOOMS, max_tiles: int = MAX_TILES, **options) -> DataFrame:
    """Routes at the finest zoom that works for each pair; pairs too far apart are reported as such.

    All unresolved pairs try a level together, each on a graph of the roads of its own corridor: components, stitches
    and snaps know no other pair's roads.  ``approx``: the route needed four times the zoom's stitch tolerance.
    """
    within = ("od_id",)
    plan = cut_lineage(corridors(od, zooms, max_tiles))
    done = None
    for z in zooms:
        at_zoom = segs_by_zoom.where(F.col("z") == z).drop("z")
        graph = None
        for factor in (1, 4):
            todo = plan.where(F.col("z") == z)
            if done is not None:
                todo = todo.join(done.select("od_id"), "od_id", "left_anti")
            if graph is None:
                todo = cut_lineage(todo)
                roads = cut_lineage(corridor_roads(todo, at_zoom))
                if roads.limit(1).count() == 0:
                    break  # no open pair has a road here, with either tolerance
                graph = nodes, edges, ends = plain_graph(roads, within)
            else:
                todo = cut_lineage(todo)
                if todo.limit(1).count() == 0:
                    break
                open_ = todo.select("od_id")
                nodes, edges = (d.join(open_, "od_id", "left_semi") for d in (nodes, edges))
                ends = ends.join(nodes, "node_id", "left_semi")
            found, _ = route_over(todo.select(*od.columns), *stitch(nodes, edges, ends, stitch_for(z) * factor, within), ROUTE_SNAP_M, within, **options)
            found = cut_lineage(found.withColumn("z", F.lit(z)).withColumn("approx", F.lit(factor != 1)))
            done = found if done is None else cut_lineage(done.unionByName(found))
    far = od.join(plan.select("od_id").distinct(), "od_id", "left_anti").withColumn("_far", F.lit(True)).select("od_id", "_far")
    status = F.when(F.col("_far"), "too far").when(F.col("z").isNull(), "no route").otherwise("routed")
    out = od.select("od_id").join(far, "od_id", "left")
    if done is None:
        return out.withColumn("z", F.lit(None).cast("int")).withColumn("status", status).drop("_far")
    return out.join(done, "od_id", "left").withColumn("status", status).drop("_far")
