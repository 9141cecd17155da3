"""Walls of a mesh and what runs into them: wall segments, distance to reachable walls, rays through links.

Meshes are the tables of operators.meshes. A link goes from an edge of one polygon to another polygon; over a tile's border it has a range of the edge,
bmin to bmax in 255ths. Links to polygons that a walker may not enter are left out by the caller, and what they covered is wall.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .meshes import LINK_STEPS
from .rounds import cut

# Fixed value: below it a ray is parallel to an edge.
PARALLEL = 1e-6


def _ranged(links: DataFrame) -> DataFrame:
    """(from_ref, to_ref, edge, bmin, bmax): a link without a range covers its edge."""
    low, high = (F.coalesce(F.col("bmin"), F.lit(0)), F.coalesce(F.col("bmax"), F.lit(LINK_STEPS))) if "bmin" in links.columns else (F.lit(0), F.lit(LINK_STEPS))
    return links.select("from_ref", "to_ref", "edge", low.cast("int").alias("bmin"), high.cast("int").alias("bmax"))


def wall_segments(edges: DataFrame, links: DataFrame, with_portals: bool = False) -> DataFrame:
    """(ref, edge, bmin, bmax, to_ref, ax .. bz): the parts of each edge that no link covers, to_ref null; with `with_portals` also what each link covers.

    The ranges of an edge are put in order; a wall lies between the furthest end so far and the next start, the edge's own ends included. Ranges that overlap are
    so merged. A link without width covers nothing.
    """
    covers = _ranged(links).withColumnsRenamed({"from_ref": "ref"}).filter("bmin < bmax")
    every = edges.select("ref", "edge", F.lit(LINK_STEPS).alias("bmin"), F.lit(LINK_STEPS).alias("bmax"), F.lit(None).cast("long").alias("to_ref"))
    # of ranges from one step the longest covers the others, so an edge has one row for each step, however many links
    longest = covers.groupBy("ref", "edge", "bmin").agg(F.max("bmax").alias("bmax"))
    events = longest.unionByName(every.select(*longest.columns))
    before = Window.partitionBy("ref", "edge").orderBy("bmin", "bmax").rowsBetween(Window.unboundedPreceding, -1)
    gaps = events.withColumn("start", F.coalesce(F.max("bmax").over(before), F.lit(0))).filter("start < bmin")
    parts = gaps.select("ref", "edge", F.col("start").alias("bmin"), F.col("bmin").alias("bmax"), F.lit(None).cast("long").alias("to_ref"))
    if with_portals:
        parts = parts.unionByName(covers.select(*parts.columns))
    sides = parts.join(edges.select("ref", "edge", *(f"{p}{v}" for p in "ab" for v in "xyz")), ["ref", "edge"])
    ends = [(F.col(f"a{v}") + (F.col(f"b{v}") - F.col(f"a{v}")) * (F.col(t) / float(LINK_STEPS))).alias(f"{p}{v}") for p, t in (("a", "bmin"), ("b", "bmax")) for v in "xyz"]
    return sides.select(*parts.columns, *ends)


def faces(edges: DataFrame, links: DataFrame, costs: DataFrame) -> DataFrame:
    """(ref, cost, sides, doors): a row for each polygon that may be entered, with its edges and its links to such polygons. `costs` has (ref, cost) of those."""
    side = F.struct("edge", *(f"{p}{v}" for p in "ab" for v in "xyz"))
    sides = edges.groupBy("ref").agg(F.array_sort(F.collect_list(side)).alias("sides"))  # a polygon's edges
    open_links = _ranged(links).join(costs.select(F.col("ref").alias("to_ref")), "to_ref", "left_semi")
    doors = open_links.groupBy(F.col("from_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("edge", "to_ref", "bmin", "bmax"))).alias("doors"))
    out = sides.join(costs, "ref").join(doors, "ref", "left")
    return out.withColumn("doors", F.coalesce("doors", F.array().cast(dict(doors.dtypes)["doors"])))


_SIDE = ("ax", "az", "bx", "bz")
#: Points of a tile that one task takes, and pairs of a point and a polygon that are worked at once.
CROWD, PAIRS = 100_000, 1 << 20


def _distance_2d(side: list[np.ndarray], x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """From each point to its side (ax, az, bx, bz), over the ground, as by segment_t()."""
    ax, az, bx, bz = side
    ex, ez = bx - ax, bz - az
    length = ex * ex + ez * ez
    t = np.where(length > 0, np.minimum(np.maximum(((x - ax) * ex + (z - az) * ez) / np.where(length > 0, length, 1.0), 0.0), 1.0), 0.0)
    dx, dz = ax + t * ex - x, az + t * ez - z
    return np.sqrt(dx * dx + dz * dz)


class _Sides:
    """Sides of a tile by their polygon's number: rows of `of`, which is put in order, with their coordinates and what else is given for each."""

    def __init__(self, n: int, of: np.ndarray, coordinates: list[np.ndarray], more: np.ndarray):
        order = np.argsort(of, kind="stable")
        self.of, self.coordinates, self.more = of[order], [c[order] for c in coordinates], more[order]
        self.count = np.bincount(of, minlength=n)
        self.first = np.cumsum(self.count) - self.count

    def met(self, polygons: np.ndarray, point: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `polygons`, row, distance) of each side of each of `polygons`, which are asked for a point each."""
        n = self.count[polygons]
        place = np.repeat(np.arange(len(polygons)), n)
        row = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + self.first[polygons][place]
        at = point[place]
        return place, row, _distance_2d([c[row] for c in self.coordinates], x[at], z[at])


def _first_walls(start: np.ndarray, x: np.ndarray, z: np.ndarray, doors: _Sides, walls: _Sides, n: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(point, row of the wall, at, distance) for those of the points, in polygons `start` of `n`, that meet a wall. A round enters polygons from those that were entered nearer than before, all points at once."""
    point, ref, entered = np.arange(len(start)), start, np.zeros(len(start))
    keys, least = point * n + ref, entered.copy()  # what is entered so far, in order
    while len(point):
        place, row, far = doors.met(ref, point, x, z)
        near = np.flatnonzero(far <= radius)
        key, by = point[place[near]] * n + doors.more[row[near]], np.maximum(entered[place[near]], far[near])
        order = np.lexsort((by, key))
        order = order[np.diff(key[order], prepend=-1) != 0]
        key, by = key[order], by[order]
        at = np.searchsorted(keys, key)
        known = keys[np.minimum(at, len(keys) - 1)] == key
        better = ~known
        better[known] = by[known] < least[at[known]]
        least[at[known & better]] = by[known & better]
        keys, least = np.insert(keys, at[~known], key[~known]), np.insert(least, at[~known], by[~known])
        point, ref, entered = key[better] // n, key[better] % n, by[better]
    # a polygon's walls are met once, from where it was entered at the least
    point = keys // n
    place, row, far = walls.met(keys % n, point, x, z)
    near = np.flatnonzero(far <= radius)
    point, row, far, at = point[place[near]], row[near], far[near], np.maximum(least[place[near]], far[near])
    order = np.lexsort((walls.more[row], walls.of[row], far, at, point))
    best = order[np.diff(point[order], prepend=-1) != 0]
    return point[best], row[best], at[best], far[best]


def _walls_of_tile(sides: pa.Table, points: pa.Table, radius: float):
    """Batches (request_id, at, distance, ref, edge) of what the points of a tile meet among its sides; polygons are numbered in their own order."""
    refs = pc.unique(sides["ref"].combine_chunks())
    refs = refs.take(pc.sort_indices(refs))
    number = lambda column: pc.index_in(column, refs).fill_null(-1).to_numpy().astype(np.int64)
    of, to, edge = number(sides["ref"]), number(sides["to_ref"]), sides["edge"].fill_null(-1).to_numpy().astype(np.int64)
    is_wall, known = sides["to_ref"].is_null().to_numpy(), to >= 0  # what is beyond a door without sides here has none in reach
    coordinates = [sides[v].to_numpy() for v in _SIDE]
    doors, walls = (_Sides(len(refs), of[s], [c[s] for c in coordinates], more[s]) for s, more in ((~is_wall & known, to), (is_wall, edge)))
    start, x, z = number(points["ref"]), points["ax"].to_numpy(), points["az"].to_numpy()
    some = np.flatnonzero(start >= 0)
    rows = max(1, PAIRS // len(refs))
    for i in range(0, len(some), rows):
        mine = some[i : i + rows]
        point, row, at, far = _first_walls(start[mine], x[mine], z[mine], doors, walls, len(refs), radius)
        request = points["request_id"].take(pa.array(mine[point])).combine_chunks()
        yield pa.RecordBatch.from_arrays([request, pa.array(at), pa.array(far), refs.take(pa.array(walls.of[row])), pa.array(walls.more[row])], names=["request_id", "at", "distance", "ref", "edge"])


def reachable_wall(points: DataFrame, around: DataFrame, radius: float) -> DataFrame:
    """(request_id, distance, ref, edge): the wall that a circle growing about each point (request_id, ref, x, z) meets first, within `radius`; `around` is faces().

    A circle spreads from its polygon through the edges it touches that have a link, so a polygon is entered at the least, over all ways to it, of the greatest
    distance of an edge on the way. A wall counts from where both its polygon is entered and it's touched; walls of another floor, or behind
    the wall, don't. An edge with a link isn't a wall. An edge without a place, or not a number, is touched by none.

    Only edges within `radius` of a point have a part in it, whatever way leads to them, so points and edges are shuffled once, by tile: an edge to each tile that is within `radius` of it, a point to
    its own. A task reads a tile's edges, of which a mesh has a bounded number, and then its points, as they come. The points of a crowded tile are dealt to several tasks, each with the edges.
    """
    around = cut(around)  # walls and links read it
    sides = around.select("ref", F.explode(F.filter("sides", lambda s: ~F.exists("doors", lambda d: d["edge"] == s["edge"]))).alias("s"))
    walls = sides.select("ref", F.lit(None).cast(dict(around.dtypes)["ref"]).alias("to_ref"), *(F.col(f"s.{v}").alias(v) for v in ("edge", *_SIDE)))
    doors = F.transform("doors", lambda d: F.struct(d["to_ref"].alias("to_ref"), F.get(F.filter("sides", lambda s: s["edge"] == d["edge"]), 0).alias("side")))
    doors = around.select("ref", F.explode(F.array_distinct(doors)).alias("d"))
    doors = doors.select("ref", "d.to_ref", *(F.col(f"d.side.{v}").alias(v) for v in ("edge", *_SIDE))).filter("to_ref IS NOT NULL")
    there = lambda *names: [F.abs(F.col(v)) < float("inf") for v in names]
    sides = reduce(DataFrame.filter, there(*_SIDE), walls.unionByName(doors)).filter("ref IS NOT NULL")
    # tiles aren't much smaller than an edge, so an edge is in few
    long = sides.agg(F.avg(F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("az") - F.col("bz"))))).first()[0]
    size = max(8.0 * radius, long or 0.0) or 1.0

    def spread(p: str, q: str) -> Column:
        low, high = F.least(p, q) - radius, F.greatest(p, q) + radius
        # a little wider, so that rounding loses no tile; the exact test follows
        return F.explode(F.sequence(F.floor((low - F.abs(low) * 1e-12 - 1e-9) / size), F.floor((high + F.abs(high) * 1e-12 + 1e-9) / size)))

    at = cut(reduce(DataFrame.filter, there("x", "z"), points.select("request_id", "ref", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))))
    at = at.withColumns({"tx": F.floor(F.col("x") / size), "tz": F.floor(F.col("z") / size)})
    # tiles of more than CROWD points are few: no more than points, divided by CROWD
    crowded = cut(at.groupBy("tx", "tz").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares")).filter("shares > 1"))
    shares = F.coalesce("shares", F.lit(1))
    dealt = at.join(F.broadcast(crowded), ["tx", "tz"], "left").withColumn("share", F.pmod(F.xxhash64("request_id"), shares).cast("int"))
    laid = sides.withColumn("tx", spread("ax", "bx")).withColumn("tz", spread("az", "bz")).join(F.broadcast(crowded), ["tx", "tz"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    asked, ref = dict(points.dtypes)["request_id"], dict(around.dtypes)["ref"]
    tile = ["tx", "tz", "share"]
    rows = laid.select(*tile, F.lit(False).alias("is_point"), F.lit(None).cast(asked).alias("request_id"), "ref", "to_ref", F.col("edge").cast("long").alias("edge"), *(F.col(v).cast("double").alias(v) for v in _SIDE))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("to_ref", ref), ("edge", "long"))]
    rows = rows.unionByName(dealt.select(*tile, F.lit(True).alias("is_point"), "request_id", F.col("ref").cast(ref).alias("ref"), *nothing, F.col("x").alias("ax"), F.col("z").alias("az"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("bz")))

    def run(batches):
        kept = None  # the sides of the last tile so far
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = (table if kept is None else pa.concat_tables([kept, table])).combine_chunks()
            numbers = np.stack([table[t].to_numpy() for t in tile])
            begins = np.flatnonzero(np.concatenate(([True], (numbers[:, 1:] != numbers[:, :-1]).any(axis=0))))
            is_point = table["is_point"].to_numpy(zero_copy_only=False)
            for begin, end in zip(begins, [*begins[1:], table.num_rows], strict=True):
                n = end - begin - is_point[begin:end].sum()
                kept = table.slice(begin, n)
                if 0 < n < end - begin:
                    yield from _walls_of_tile(kept, table.slice(begin + n, end - begin - n), radius)

    # a tile's sides come before its points
    found = rows.repartition(*tile).sortWithinPartitions(*tile, "is_point").mapInArrow(run, f"request_id {asked}, at double, distance double, ref {ref}, edge long")
    first = F.min(F.struct("at", "distance", "ref", "edge")).alias("w")
    return found.groupBy("request_id").agg(first).select("request_id", "w.distance", "w.ref", F.col("w.edge").cast(dict(sides.dtypes)["edge"]).alias("edge"))


_STATE = "request_id ref sx sy sz gx gy gz t px py pz cost polys".split()


def walk_rays(rays: DataFrame, around: DataFrame) -> DataFrame:
    """(request_id, t, clear, nx, nz, cost, polys, ref): how far each ray (request_id, start_ref, sx .. gz) gets through the polygons of `around`, which is faces().

    In each polygon a ray is cut by the edges: it leaves at the first of those that it crosses outward, and goes on through a link of that edge, if the link's range
    has the place, else it ends there: t is its share of the way, nx and nz the wall's normal. A ray whose end lies in the polygon
    is clear. cost is the length over the ground times each polygon's cost, polys the polygons entered, ref the last. Rays that are under way are one table; a round takes all of
    them one polygon on. A ray whose start isn't in its polygon ends at once, without a normal; one whose polygon isn't in `around` isn't returned.
    """
    around = cut(around)  # rounds read it; it isn't worked out anew in each
    c = {n: F.col(n) for n in (*_STATE, "sides", "doors")}
    dx, dz = c["gx"] - c["sx"], c["gz"] - c["sz"]

    def crossing(s: Column) -> Column:
        ex, ez = s["bx"] - s["ax"], s["bz"] - s["az"]
        inside = ez * (c["sx"] - s["ax"]) - ex * (c["sz"] - s["az"])
        turn = dz * ex - dx * ez
        return F.struct((inside / F.when(F.abs(turn) >= PARALLEL, turn)).alias("t"), s["edge"].alias("edge"), inside.alias("inside"), turn.alias("turn"))

    met = F.transform("sides", crossing)
    enters = F.greatest(F.lit(0.0), F.array_max(F.transform(F.filter("met", lambda m: m["turn"] <= -PARALLEL), lambda m: m["t"])))
    leaves = F.array_min(F.transform(F.filter("met", lambda m: m["turn"] >= PARALLEL), lambda m: F.struct(m["t"].alias("t"), m["edge"].alias("edge"))))
    beside = F.exists("met", lambda m: (F.abs(m["turn"]) < PARALLEL) & (m["inside"] < 0))
    at = cut(rays.select("request_id", F.col("start_ref").alias("ref"), *(f"{p}{v}" for p in "sg" for v in "xyz"), F.lit(0.0).alias("t"), *(F.col(f"s{v}").alias(f"p{v}") for v in "xyz"), F.lit(0.0).alias("cost"), F.lit(0).alias("polys")))
    ended = []
    while not at.isEmpty():
        stepped = at.join(around.withColumnRenamed("cost", "ground"), "ref").withColumn("met", met).withColumns({"out": leaves, "missed": beside})
        stepped = stepped.withColumn("missed", F.col("missed") | (F.coalesce(enters, F.lit(0.0)) > F.least(F.coalesce("out.t", F.lit(1.0)), F.lit(1.0))))
        stepped = stepped.withColumn("inside", ~F.col("missed") & (F.coalesce("out.t", F.lit(1.0)) >= 1.0)).drop("met")
        side = F.get(F.filter("sides", lambda s: s["edge"] == F.col("out.edge")), 0)
        stepped = stepped.withColumn("side", side).withColumn("t", F.when(F.col("missed") | F.col("inside"), F.col("t")).otherwise(F.greatest("t", "out.t")))
        ex, ez = F.col("side.bx") - F.col("side.ax"), F.col("side.bz") - F.col("side.az")
        qx, qz = c["sx"] + dx * c["t"], c["sz"] + dz * c["t"]
        along = F.when(ex * ex > ez * ez, (qx - F.col("side.ax")) / ex).otherwise((qz - F.col("side.az")) / ez)
        stepped = stepped.withColumn("along", along)
        open_doors = F.filter("doors", lambda d: (d["edge"] == F.col("side.edge")) & (F.col("along") * LINK_STEPS >= d["bmin"]) & (F.col("along") * LINK_STEPS <= d["bmax"]))
        whole = F.filter("doors", lambda d: (d["edge"] == F.col("side.edge")) & (d["bmin"] == 0) & (d["bmax"] == LINK_STEPS))
        to = F.array_min(F.transform(F.concat(whole, open_doors), lambda d: d["to_ref"]))
        stepped = stepped.withColumn("to", F.when(~F.col("missed") & ~F.col("inside"), to))
        nx, ny, nz = (F.when(F.col("inside"), c[f"g{v}"]).otherwise(q) for v, q in (("x", qx), ("y", F.col("side.ay") + (F.col("side.by") - F.col("side.ay")) * F.col("along")), ("z", qz)))
        length = F.sqrt((nx - c["px"]) * (nx - c["px"]) + (ny - c["py"]) * (ny - c["py"]) + (nz - c["pz"]) * (nz - c["pz"]))
        wide = F.sqrt(ex * ex + ez * ez)
        stepped = stepped.select(
            "request_id", "ref", *(f"{p}{v}" for p in "sg" for v in "xyz"), "t",
            *(F.when(F.col("missed"), c[f"p{v}"]).otherwise(q).alias(f"p{v}") for v, q in zip("xyz", (nx, ny, nz), strict=True)),
            F.when(F.col("missed"), c["cost"]).otherwise(c["cost"] + length * F.col("ground")).alias("cost"), F.when(F.col("missed"), c["polys"]).otherwise(c["polys"] + 1).alias("polys"),
            "to", "inside", F.when(~F.col("missed") & ~F.col("inside"), ez / wide).alias("nx"), F.when(~F.col("missed") & ~F.col("inside"), -ex / wide).alias("nz"),
        )
        stepped = cut(stepped)
        ended.append(stepped.filter("to IS NULL").select("request_id", "t", F.col("inside").alias("clear"), "nx", "nz", "cost", "polys", "ref"))
        at = stepped.filter("to IS NOT NULL").select("request_id", F.col("to").alias("ref"), *_STATE[2:])
    if not ended:
        return rays.selectExpr("request_id", "0D AS t", "true AS clear", "0D AS nx", "0D AS nz", "0D AS cost", "0 AS polys", "start_ref AS ref").limit(0)
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out
