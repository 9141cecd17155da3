"""Marking of spans by volumes: boxes, convex prisms and cylinders, the last volume winning; and growing of convex outlines.

Volumes are rows (seq, area, kind, minx, miny, minz, maxx, maxy, maxz, corners, px, pz, radius) in world units: a box has its bounds, a prism its corners (structs with x and z) and
miny, maxy, a cylinder its axis, radius and miny, maxy. Spans are (span_id, x, z, y, area): cell and height in voxels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crosses_edge

BOX, PRISM, CYLINDER = "box", "prism", "cylinder"
# How far a corner may stick out, in offsets, before it's cut, and the square of a length that counts as none.
MITER_LIMIT, NO_LENGTH = 1.2, 1e-6


def _next(corners: Column, i: Column, by: int) -> Column:
    return F.get(corners, (i + by + F.size(corners)) % F.size(corners))


def in_outline(x: Column, z: Column, corners: Column) -> Column:
    """Whether a place lies in an outline, by the even-odd rule."""
    hits = F.filter(corners, lambda p, i: F.coalesce(crosses_edge(x, z, p["x"], p["z"], _next(corners, i, -1)["x"], _next(corners, i, -1)["z"]), F.lit(False)))
    return F.size(hits) % 2 == 1


def mark_volumes(spans: DataFrame, volumes: DataFrame, cell: float = 1.0, height: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), bucket: int = 8) -> DataFrame:
    """`spans` with the area of the last volume, by seq, that each lies in; spans of area 0 stay as they are.

    A volume covers the cells and heights that its bounds, cut to whole voxels, take in; of those a prism has the cells whose middle lies in its outline, a cylinder those whose
    middle is nearer to the axis than its radius. Volumes and spans meet in squares of `bucket` cells, each volume in those that it covers.
    """
    ox, oy, oz = origin
    low = {v: F.when(F.col("kind") == BOX, F.col(f"min{v}")).when(F.col("kind") == PRISM, F.array_min(f"corners.{v}")).otherwise(F.col(f"p{v}") - F.col("radius")) for v in "xz"}
    high = {v: F.when(F.col("kind") == BOX, F.col(f"max{v}")).when(F.col("kind") == PRISM, F.array_max(f"corners.{v}")).otherwise(F.col(f"p{v}") + F.col("radius")) for v in "xz"}

    def voxel(value: Column, start: float, size: float) -> Column:
        return ((value - start) / size).cast("int")  # cut toward zero

    boxed = volumes.select(
        "seq", F.col("area").alias("to_area"), "kind", "corners", "px", "pz", "radius",
        *(voxel(side[v], o, cell).alias(f"{n}{v}") for n, side in (("lo", low), ("hi", high)) for v, o in (("x", ox), ("z", oz))),
        voxel(F.col("miny"), oy, height).alias("loy"), voxel(F.col("maxy"), oy, height).alias("hiy"),
    ).filter("hix >= lox AND hiz >= loz")
    for v in "xz":
        boxed = boxed.withColumn(f"b{v}", F.explode(F.sequence(F.floor(F.col(f"lo{v}") / bucket), F.floor(F.col(f"hi{v}") / bucket))))
    here = spans.filter("area <> 0").select("span_id", "x", "z", "y").withColumns({"bx": F.floor(F.col("x") / bucket), "bz": F.floor(F.col("z") / bucket)})
    met = here.join(boxed, ["bx", "bz"]).filter("x BETWEEN lox AND hix AND z BETWEEN loz AND hiz AND y BETWEEN loy AND hiy")
    mx, mz = F.col("x") * cell + (ox + 0.5 * cell), F.col("z") * cell + (oz + 0.5 * cell)
    near = (mx - F.col("px")) * (mx - F.col("px")) + (mz - F.col("pz")) * (mz - F.col("pz")) < F.col("radius") * F.col("radius")
    met = met.filter(F.when(F.col("kind") == BOX, True).when(F.col("kind") == PRISM, in_outline(mx, mz, F.col("corners"))).otherwise(near))
    marked = met.groupBy("span_id").agg(F.max_by("to_area", "seq").alias("to_area"))
    return spans.join(marked, "span_id", "left").withColumn("area", F.coalesce("to_area", "area")).drop("to_area")


def offset_outline(corners: Column, offset: Column | float) -> Column:
    """A convex outline (structs with x and z) that turns from x to z, with each side moved out by `offset`; a corner that would stick out too far is cut in two. The sides
    of an outline that turns the other way move in."""
    grow = offset if isinstance(offset, Column) else F.lit(offset)

    def unit(a: Column, b: Column) -> Column:
        dx, dz = b["x"] - a["x"], b["z"] - a["z"]
        return F.transform(F.array(F.struct(dx.alias("x"), dz.alias("z"), (dx * dx + dz * dz).alias("square"))), scaled)[0]

    def scaled(d: Column) -> Column:
        scale = F.when(d["square"] > NO_LENGTH, 1 / F.sqrt(d["square"])).otherwise(1.0)
        return F.struct((d["x"] * scale).alias("x"), (d["z"] * scale).alias("z"))

    # a lambda's expressions are worked out anew wherever they're named, so each step is a pass of its own that keeps what the next one names more than once
    def turned(p: Column, i: Column) -> Column:
        (x0, z0), (x1, z1) = ((u["x"], u["z"]) for u in (p["before"], p["after"]))
        mx, mz = (-z0 - z1) * 0.5, (x0 + x1) * 0.5
        return F.struct(p["x"].alias("x"), p["z"].alias("z"), x0.alias("x0"), z0.alias("z0"), x1.alias("x1"), z1.alias("z1"), mx.alias("mx"), mz.alias("mz"), ((1.0 - (x0 * x1 + z0 * z1)) * 0.5).alias("d"))

    def measured(p: Column) -> Column:
        square = p["mx"] * p["mx"] + p["mz"] * p["mz"]
        return F.struct(p.alias("p"), square.alias("square"))

    def corner(m: Column) -> Column:
        p, square = m["p"], m["square"]
        x0, z0, x1, z1, mx, mz, d = (p[n] for n in ("x0", "z0", "x1", "z1", "mx", "mz", "d"))
        scale = F.when(square > NO_LENGTH, 1 / square).otherwise(1.0)
        cut = (square * (MITER_LIMIT * MITER_LIMIT) < 1.0) & (x1 * z0 - x0 * z1 < 0)
        one = F.array(F.struct((p["x"] - mx * scale * grow).alias("x"), (p["z"] - mz * scale * grow).alias("z")))
        two = F.array(*(F.struct((p["x"] + x * grow).alias("x"), (p["z"] + z * grow).alias("z")) for x, z in ((z0 + x0 * d, -x0 + z0 * d), (z1 - x1 * d, -x1 - z1 * d))))
        return F.when(cut, two).otherwise(one)

    ends = F.transform(corners, lambda p, i: F.struct(p["x"].alias("x"), p["z"].alias("z"), unit(_next(corners, i, -1), p).alias("before"), unit(p, _next(corners, i, 1)).alias("after")))
    measures = F.transform(F.transform(ends, turned), measured)
    return F.flatten(F.transform(measures, corner))
