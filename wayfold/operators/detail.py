"""Heights and closest points on detail meshes: each polygon's surface as triangles over its own corners and points inside it.

A detail mesh is a row (ref, points, tris): points inside the polygon (structs x, y, z), and triangles (structs a, b, c, flags) whose corners below the polygon's number are the
polygon's own, the others its points in turn. flags has two bits for each side of a triangle, ab, bc, ca from the low end; 1 marks a side on the polygon's boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SEGMENT_EPSILON

BOUNDARY = 1


def surfaces(edges: DataFrame, details: DataFrame) -> DataFrame:
    """(ref, outline, tris): the corners of each polygon, and its triangles as (i, a, b, c, flags) with corners in place of numbers; a polygon without a detail mesh has the fan
    about its first corner, whose outer sides are boundary."""
    corner = lambda s: F.struct(*(s[f"a{v}"].alias(v) for v in "xyz"))
    outline = edges.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("edge", "ax", "ay", "az"))).alias("s")).select("ref", F.transform("s", corner).alias("outline"))  # a polygon's corners
    n = F.size("outline")

    def side(i: Column) -> Column:
        outer_first = F.when(i == 1, BOUNDARY).otherwise(0)
        outer_last = F.when(i == n - 2, BOUNDARY << 4).otherwise(0)
        return F.struct(F.lit(0).alias("a"), i.alias("b"), (i + 1).alias("c"), (outer_first + F.lit(BOUNDARY << 2) + outer_last).alias("flags"))

    fan = F.when(n > 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), side)).otherwise(F.array().cast("array<struct<a:int,b:int,c:int,flags:int>>"))
    joined = outline.join(details.select("ref", "points", "tris"), "ref", "left")
    every = F.concat("outline", F.coalesce("points", F.array().cast(dict(outline.dtypes)["outline"])))
    chosen = F.coalesce("tris", fan)
    placed = F.transform(chosen, lambda t, i: F.struct(i.alias("i"), *(F.get(F.col("every"), t[c]).alias(c) for c in "abc"), t["flags"].alias("flags")))
    return joined.withColumn("every", every).select("ref", "outline", placed.alias("tris"))


#: The sides of a triangle in order: the numbers of its two corners, and the first of its bits in flags.
SIDES = ((2, 0, 4), (0, 1, 0), (1, 2, 2))
#: Pairs that are worked at once.
ROWS = 1000


def _numbers(values: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `wide` numbers each, and whether they are null."""
    return values.to_numpy(zero_copy_only=False).reshape(-1, wide), values.is_null().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b as Spark has it: NaN is above all others."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _over(px: np.ndarray, pz: np.ndarray, known: np.ndarray, outline: pa.ListArray) -> np.ndarray:
    """Whether each point is over its polygon, as by crosses_edge()."""
    n = outline.value_lengths().to_numpy(zero_copy_only=False) // 2
    of, end = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    at, absent = _numbers(outline.flatten(), 2)
    prior = np.arange(len(of)) - 1
    some = n > 0
    prior[(end - n)[some]] = end[some] - 1
    (ax, az), (bx, bz), x, z = at.T, at[prior].T, px[of], pz[of]
    crossed = (_above(az, z) != _above(bz, z)) & _above((bx - ax) * (z - az) / (bz - az) + ax, x) & ~(absent | absent[prior]).any(1) & known[of]
    return np.bincount(of[crossed], minlength=len(n)) % 2 == 1


def _heights(px: np.ndarray, pz: np.ndarray, of: np.ndarray, at: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a triangle over their point, and the height of the first one, as by triangle_height()."""
    ax, ay, az, bx, by, bz, cx, cy, cz = at.T
    v0x, v0z, v1x, v1z, v2x, v2z = cx - ax, cz - az, bx - ax, bz - az, px[of] - ax, pz[of] - az
    det = v0x * v1z - v0z * v1x
    sign, area = np.where(det < 0, -1.0, 1.0), np.abs(det)
    u, v = sign * (v1z * v2x - v1x * v2z), sign * (v0x * v2z - v0z * v2x)
    height = ay + ((cy - ay) * u + (by - ay) * v) / area
    inside = ~(area <= SEGMENT_EPSILON) & ~(u < 0) & ~(v < 0) & ~_above(u + v, area) & ~absent.any(1)
    hit = np.flatnonzero(inside)
    first = hit[np.diff(of[hit], prepend=-1) != 0]
    return of[first], height[first]


def _nearest(px: np.ndarray, pz: np.ndarray, known: np.ndarray, over: np.ndarray, of: np.ndarray, at: np.ndarray, absent: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a side to take, the nearest point of it (x, y, z), the first side of equals, and whether those are null."""
    ends = [[[3 * s[k] + v for v in range(3)] for s in SIDES] for k in (0, 1)]
    outer = np.stack([flags >> s[2] & BOUNDARY != 0 for s in SIDES], axis=1)
    taken = (over[of][:, None] | outer).ravel()
    of = np.repeat(of, len(SIDES))[taken]
    p, q = (at[:, e].reshape(-1, 3)[taken] for e in ends)
    p_absent, q_absent = (absent[:, e].reshape(-1, 3)[taken] for e in ends)
    x, z, step, on_absent = px[of], pz[of], q - p, p_absent | q_absent
    length = step[:, 0] * step[:, 0] + step[:, 2] * step[:, 2]
    flat = on_absent[:, 0] | on_absent[:, 2]
    t = np.fmin(np.maximum(((x - p[:, 0]) * step[:, 0] + (z - p[:, 2]) * step[:, 2]) / length, 0.0), 1.0)
    t = np.where((length <= 0) | flat | ~known[of], 0.0, t)
    on = p + t[:, None] * step
    d = (on[:, 0] - x) * (on[:, 0] - x) + (on[:, 2] - z) * (on[:, 2] - z)
    d[flat | ~known[of]] = -1.0  # null comes before all distances
    start = np.flatnonzero(np.diff(of, prepend=-1))
    best = start
    if len(start):
        size = np.diff(start, append=len(of))
        least = np.repeat(np.fmin.reduceat(d, start), size)
        best = np.minimum.reduceat(np.where((d == least) | np.isnan(least), np.arange(len(of)), len(of)), start)
    return of[best], on[best], on_absent[best]


def surface_points(pairs: DataFrame, surface: DataFrame) -> DataFrame:
    """(request_id, ref, over, x, y, z) for pairs (request_id, px, py, pz, ref) and surfaces(): over the polygon, the place itself at the height of the first triangle that has it, or
    of the nearest side of any triangle where rounding leaves it in none; beside it, the nearest point of the boundary sides; null where there are none. The pairs are dealt by ref."""
    numbers = lambda values: F.flatten(values).cast("array<double>")
    outline = numbers(F.transform("outline", lambda p: F.array(p["x"], p["z"])))
    at = numbers(F.transform("tris", lambda t: F.array(*(t[c][v] for c in "abc" for v in "xyz"))))
    flat = surface.select("ref", outline.alias("outline"), at.alias("at"), F.col("tris.flags").cast("array<int>").alias("flags"))
    own = pairs.select("request_id", "ref", *(F.col(v).cast("double").alias(v) for v in ("px", "pz")))
    met = own.join(flat.hint("merge"), "ref").select("request_id", "ref", "px", "pz", "outline", "at", "flags")

    def run(batches):
        for part in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            px, pz, tris = (part.column(c) for c in ("px", "pz", "flags"))
            known = px.is_valid().to_numpy(zero_copy_only=False) & pz.is_valid().to_numpy(zero_copy_only=False)
            x, z = (v.to_numpy(zero_copy_only=False) for v in (px, pz))
            of = np.repeat(np.arange(part.num_rows), tris.value_lengths().to_numpy(zero_copy_only=False))
            corners, absent = _numbers(part.column("at").flatten(), 9)
            with np.errstate(all="ignore"):
                over = _over(x, z, known, part.column("outline"))
                rows, near, near_absent = _nearest(x, z, known, over, of, corners, absent, tris.flatten().fill_null(0).to_numpy(zero_copy_only=False))
                high, height = _heights(x, z, of, corners, absent)
            found, missing = np.zeros((part.num_rows, 3)), np.ones((part.num_rows, 3), bool)
            found[rows], missing[rows] = near, near_absent
            found[over, 0], found[over, 2], missing[over, 0], missing[over, 2] = x[over], z[over], False, False
            high, height = high[over[high]], height[over[high]]
            found[high, 1], missing[high, 1] = height, False
            yield pa.RecordBatch.from_arrays([part.column("request_id"), part.column("ref"), pa.array(over), *(pa.array(found[:, v], mask=missing[:, v]) for v in range(3))], names=["request_id", "ref", "over", "x", "y", "z"])

    kept = ", ".join(f"{c} {t}" for c, t in met.dtypes if c in ("request_id", "ref"))
    return met.mapInArrow(run, f"{kept}, over boolean, x double, y double, z double")
