"""What lies around a place of a mesh: convex shapes that overlap, polygons within a circle or a convex shape, neighbourhoods without overlap.

Shapes are arrays of corners (structs with x and z) around a convex polygon, in either direction. Requests are rows with a request_id and all advance by one
ring of polygons in a round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import segment_t
from .rounds import cut

# Fixed value: what ranges on an axis may share and still be apart.
TOUCH = 1e-4
PARALLEL = 1e-6


def shape(*points: tuple[Column, Column]) -> Column:
    """Corners (x, z) as a shape."""
    return F.array(*(F.struct(x.alias("x"), z.alias("z")) for x, z in points))


def _sides(corners: Column) -> Column:
    """Each corner with the next one."""
    return F.transform(corners, lambda p, i: F.struct(p["x"].alias("ax"), p["z"].alias("az"), F.get(corners, (i + 1) % F.size(corners))["x"].alias("bx"), F.get(corners, (i + 1) % F.size(corners))["z"].alias("bz")))


def _above(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p > q as Spark has it: what isn't a number is above all numbers."""
    return (p > q) | (np.isnan(p) & ~np.isnan(q))


def _apart_on_sides(ofx: np.ndarray, ofz: np.ndarray, otherx: np.ndarray, otherz: np.ndarray) -> np.ndarray:
    """Whether an edge of the first shape of each pair (arrays: corner, pair) has a normal on which the two shapes' shadows don't meet."""
    apart = np.zeros(ofx.shape[1], bool)
    for i in range(len(ofx)):
        nx, nz = ofz[(i + 1) % len(ofx)] - ofz[i], ofx[i] - ofx[(i + 1) % len(ofx)]
        here, there = nx * ofx + nz * ofz, nx * otherx + nz * otherz
        apart |= _above(np.fmin.reduce(here) + TOUCH, there.max(axis=0)) | _above(np.fmin.reduce(there), here.max(axis=0) - TOUCH)
    return apart


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """convex_overlap() of pairs of shapes; pairs with as many corners are taken side by side, and null stands where a corner is missing."""
    shapes = []
    for s in (a, b):
        corners, size = s.flatten(), s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x, z = (pc.struct_field(corners, v) for v in "xz")
        known = pc.and_(x.is_valid(), z.is_valid()).to_numpy(zero_copy_only=False)
        shapes.append((size, np.cumsum(size) - size, *(v.cast(pa.float64()).fill_null(0.0).to_numpy() for v in (x, z)), known))
    (size, start, x, z, known), (size2, start2, x2, z2, known2) = shapes
    out, whole = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for n, m in {*zip(size.tolist(), size2.tolist(), strict=True)}:
        if n and m:
            at = np.flatnonzero((size == n) & (size2 == m))
            of, other = start[at] + np.arange(n)[:, None], start2[at] + np.arange(m)[:, None]
            one, two = (x[of], z[of]), (x2[other], z2[other])
            out[at] = ~_apart_on_sides(*one, *two) & ~_apart_on_sides(*two, *one)
            whole[at] = known[of].all(axis=0) & known2[other].all(axis=0)
    return pa.array(out, mask=~whole)


def convex_overlap(a: Column, b: Column) -> Column:
    """Whether two convex shapes overlap: no edge normal of either separates them. Shapes that only touch don't; null where a shape has no corners or lacks a coordinate."""
    return F.arrow_udf(_overlap, "boolean")(a, b)


def overlapping(left: DataFrame, right: DataFrame, bucket: float = 16.0) -> DataFrame:
    """(id, other) of the shapes (id, corners) in `left` and `right` that overlap. Boxes meet in grid buckets, and a pair is kept in the bucket of
    its boxes' common corner, so once."""

    def boxed(df: DataFrame, names: tuple[str, str], prefix: str) -> DataFrame:
        box = [f(f"corners.{v}").alias(f"{prefix}{n}{v}") for v in "xz" for n, f in (("lo", F.array_min), ("hi", F.array_max))]
        out = df.select(F.col("id").alias(names[0]), F.col("corners").alias(names[1]), *box)
        for v in "xz":
            out = out.withColumn(f"b{v}", F.explode(F.sequence(F.floor(F.col(f"{prefix}lo{v}") / bucket), F.floor(F.col(f"{prefix}hi{v}") / bucket))))
        return out

    pairs = boxed(left, ("id", "corners"), "l").join(boxed(right, ("other", "other_corners"), "r"), ["bx", "bz"])
    for v in "xz":
        pairs = pairs.filter((F.col(f"llo{v}") <= F.col(f"rhi{v}")) & (F.col(f"rlo{v}") <= F.col(f"lhi{v}")) & (F.col(f"b{v}") == F.floor(F.greatest(f"llo{v}", f"rlo{v}") / bucket)))
    return pairs.filter(convex_overlap(F.col("corners"), F.col("other_corners"))).select("id", "other")


def sides_of(corners: Column) -> Column:
    """A convex shape's sides (ax, az, bx, bz), turned so that its inside lies on the side that segment_meets_sides() takes as inner."""
    sides = _sides(corners)
    turn = F.aggregate(sides, F.lit(0.0), lambda total, s: total + s["ax"] * s["bz"] - s["az"] * s["bx"])
    turned = F.transform(sides, lambda s: F.struct(s["bx"].alias("ax"), s["bz"].alias("az"), s["ax"].alias("bx"), s["az"].alias("bz")))
    return F.when(turn > 0, turned).otherwise(sides)


def segment_meets_sides(ax: Column, az: Column, bx: Column, bz: Column, sides: Column) -> Column:
    """Whether a segment has a point in the convex shape of sides_of(): it enters across sides before it leaves."""
    dx, dz = bx - ax, bz - az

    def cross(so_far: Column, s: Column) -> Column:
        ex, ez = s["bx"] - s["ax"], s["bz"] - s["az"]
        inside, d = ez * (ax - s["ax"]) - ex * (az - s["az"]), dz * ex - dx * ez
        return F.struct(
            F.when(d <= -PARALLEL, F.greatest(so_far["enters"], inside / d)).otherwise(so_far["enters"]).alias("enters"),
            F.when(d >= PARALLEL, F.least(so_far["leaves"], inside / d)).otherwise(so_far["leaves"]).alias("leaves"),
            (so_far["beside"] | ((F.abs(d) < PARALLEL) & (inside < 0))).alias("beside"),
        )

    start = F.struct(F.lit(0.0).alias("enters"), F.lit(1.0).alias("leaves"), F.lit(False).alias("beside"))
    return F.aggregate(sides, start, cross, lambda m: ~m["beside"] & (m["enters"] <= m["leaves"]))


def segment_in_circle(ax: Column, az: Column, bx: Column, bz: Column, x: Column, z: Column, radius: Column) -> Column:
    t = segment_t(x, z, ax, az, bx, bz)
    dx, dz = ax + t * (bx - ax) - x, az + t * (bz - az) - z
    return dx * dx + dz * dz <= radius * radius


_DOOR = ["ax", "az", "bx", "bz"]


def polygons_around(requests: DataFrame, doors: DataFrame, costs: DataFrame, meets: Callable[..., Column], carry: list[str]) -> DataFrame:
    """(request_id, ref, cost): the polygons that each request (request_id, start_ref, sx, sy, sz, and the columns `carry` of its circle or shape) reaches through portals
    that meets(portal ends, *carry) takes, with the cost of the cheapest way of that kind, through portal midpoints; the start costs 0.

    `doors` is search.portals(), `costs` has (ref, cost) of polygons that may be entered. A round moves only what was reached more cheaply than before.
    """
    enter = doors.join(costs.select(F.col("ref").alias("to_ref")).hint("merge"), "to_ref", "left_semi").join(costs.select(F.col("ref").alias("from_ref"), F.col("cost").alias("ground")).hint("merge"), "from_ref")
    # what is read from few bytes of keys is taken for small and broadcast through the driver, so these joins are merges, and what rounds join is a table of its real size
    enter = cut(enter.select("from_ref", "to_ref", "portal", "ground", *_DOOR, *(f"m{v}" for v in "xyz")))
    carried = [F.col(f"_{i}") for i in range(len(carry))]
    names = [f"_{i}" for i in range(len(carry))]
    at = cut(requests.join(costs.select(F.col("ref").alias("start_ref")).hint("merge"), "start_ref", "left_semi").select("request_id", F.col("start_ref").alias("ref"), *(F.col(f"s{v}").alias(f"p{v}") for v in "xyz"), F.lit(0.0).alias("cost"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True))))
    reached = [at.select("request_id", "ref", F.lit(None).cast("long").alias("portal"), "cost")]
    known = None
    while not at.isEmpty():
        step = at.join(enter, F.col("ref") == F.col("from_ref")).filter(meets(*(F.col(v) for v in _DOOR), *carried))
        length = F.sqrt((F.col("mx") - F.col("px")) * (F.col("mx") - F.col("px")) + (F.col("my") - F.col("py")) * (F.col("my") - F.col("py")) + (F.col("mz") - F.col("pz")) * (F.col("mz") - F.col("pz")))
        step = step.select("request_id", F.col("to_ref").alias("ref"), "portal", *(F.col(f"m{v}").alias(f"p{v}") for v in "xyz"), (F.col("cost") + length * F.col("ground")).alias("cost"), *names)
        best = step.groupBy("request_id", "portal").agg(F.min("cost").alias("cost"), *(F.first(c).alias(c) for c in ("ref", "px", "py", "pz", *names)))
        if known is not None:
            before = known.groupBy("request_id", "portal").agg(F.min("cost").alias("before"))
            best = best.join(before, ["request_id", "portal"], "left").filter("before IS NULL OR cost < before")
        at = cut(best.select("request_id", "ref", "px", "py", "pz", "cost", "portal", *names))
        part = at.select("request_id", "ref", "portal", "cost")
        known = part if known is None else known.unionByName(part)
        reached.append(part)
        at = at.drop("portal")
    out = reached[0]
    for part in reached[1:]:
        out = out.unionByName(part)
    return out.groupBy("request_id", "ref").agg(F.min("cost").alias("cost"))


def local_neighbourhood(points: DataFrame, around: DataFrame, radius: float) -> DataFrame:
    """(request_id, ref, ring): polygons about each point (request_id, ref, x, z) in rings of links whose edge is within `radius`, none of which overlaps another that it
    has no link with; `around` is walls.faces().

    Rings are decided one after the other, and within a ring the smaller ref goes first: in each round, candidates without an undecided
    smaller rival are taken, and those that overlap a taken polygon without a link go. A polygon that went isn't asked again.
    """
    around = cut(around)
    body = cut(around.select("ref", F.transform("sides", lambda s: F.struct(s["ax"].alias("x"), s["az"].alias("z"))).alias("corners"), F.transform("doors", lambda d: d["to_ref"]).alias("near")))
    doors = cut(around.select("ref", F.explode(F.transform("doors", lambda d: F.struct(d["to_ref"].alias("to_ref"), F.get(F.filter("sides", lambda s: s["edge"] == d["edge"]), 0).alias("s")))).alias("d")).select("ref", "d.to_ref", *(F.col(f"d.s.{v}").alias(v) for v in _DOOR)))
    asked = points.select("request_id", "x", "z")
    taken = cut(points.select("request_id", "ref").join(body, "ref").withColumn("ring", F.lit(0)))
    last, seen, ring = taken, taken.select("request_id", "ref"), 0
    parts = [taken]
    clash = convex_overlap(F.col("corners"), F.col("other_corners")) & ~F.array_contains("near", F.col("other")) & ~F.array_contains("other_near", F.col("ref"))

    def rival(df: DataFrame) -> DataFrame:
        return df.select("request_id", F.col("ref").alias("other"), F.col("corners").alias("other_corners"), F.col("near").alias("other_near"))

    def all_taken() -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    while not last.isEmpty():
        ring += 1
        met = last.select("request_id", "ref").join(asked, "request_id").join(doors, "ref")
        met = met.filter(segment_in_circle(*(F.col(v) for v in _DOOR), F.col("x"), F.col("z"), F.lit(radius))).select("request_id", F.col("to_ref").alias("ref")).distinct()
        waiting = cut(met.join(seen, ["request_id", "ref"], "left_anti").join(body, "ref").select("request_id", "ref", "corners", "near"))
        seen = seen.unionByName(waiting.select("request_id", "ref"))
        before = all_taken()
        fresh: list[DataFrame] = []
        while not waiting.isEmpty():
            lost = waiting.join(rival(before), "request_id").filter(clash).select("request_id", "ref").distinct()
            left = cut(waiting.join(lost, ["request_id", "ref"], "left_anti"))
            first = left.join(rival(left), "request_id").filter((F.col("other") < F.col("ref")) & clash).select("request_id", "ref").distinct()
            before = cut(left.join(first, ["request_id", "ref"], "left_anti").withColumn("ring", F.lit(ring)))
            fresh.append(before)
            waiting = left.join(before.select("request_id", "ref"), ["request_id", "ref"], "left_anti")
        parts += fresh
        if not fresh:
            break
        last = fresh[0]
        for part in fresh[1:]:
            last = last.unionByName(part)
    return all_taken().select("request_id", "ref", "ring")
