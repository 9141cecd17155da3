"""World geometry and polygon meshes as tables.

Geometry is verts (tile, vid, x, y, z) and tris (tile, tid, a, b, c, area). Polygons are convex: polys (ref, area) with
edges (ref, edge, ax, ay, az, bx, by, bz, nei), where nei is the neighbour's ref inside the tile, -1 for a wall, or -2 - side for an
edge on the tile's border (side 0 x-, 1 z+, 2 x+, 3 z-).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import decode_ref, overlaps, rotate_zyx

# The steepest slope, the deepest look-up of parents, city flags, and tolerances of border links.
MAX_SLOPE = 55.0
MAX_DEPTH = 10
CITY_FLAGS = 0x28
BORDER_GAP, BORDER_SHRINK, LINK_STEPS = 0.01, 0.01, 255
#: Shares into which the edges of a border are dealt, and tasks that pair them.
BORDER_SHARES, BORDER_TASKS = 16, 64
HALF_UNIT, UNIT = 533.33333 / 256, 533.33333 / 128


def clean(verts: DataFrame, tris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unused vertices go; of equal vertices the first stays; triangles are renamed to those, and of equal ones (same corners in the
    same order) the first stays, with its area."""
    used = tris.select("tile", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    kept = verts.join(used, ["tile", "vid"], "left_semi")
    first = kept.groupBy("tile", "x", "y", "z").agg(F.min("vid").alias("keep"))
    named = kept.join(first, ["tile", "x", "y", "z"]).select("tile", "vid", "keep")
    out = tris
    for corner in ("a", "b", "c"):
        out = out.join(named.select("tile", F.col("vid").alias(corner), F.col("keep").alias(f"{corner}_keep")), ["tile", corner])
    out = out.select("tile", "tid", *(F.col(f"{c}_keep").alias(c) for c in "abc"), "area")
    merged = out.groupBy("tile", "a", "b", "c").agg(F.min("tid").alias("tid"), F.min_by("area", "tid").alias("area"))
    return first.select("tile", F.col("keep").alias("vid"), "x", "y", "z"), merged.select("tile", "tid", "a", "b", "c", "area")


def clip(verts: DataFrame, tris: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices within their tile's bounds (tile, minx, maxx, miny, maxy, minz, maxz), edges included, and triangles that keep all corners."""
    inside = (F.col("x").between(F.col("minx"), F.col("maxx"))) & (F.col("y").between(F.col("miny"), F.col("maxy"))) & (F.col("z").between(F.col("minz"), F.col("maxz")))
    kept = verts.join(bounds, "tile").filter(inside).select(*verts.columns)
    out = tris
    for corner in ("a", "b", "c"):
        out = out.join(kept.select("tile", F.col("vid").alias(corner)), ["tile", corner], "left_semi")
    return kept, out.select(*tris.columns)


def append(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_corners(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """`tris` with the coordinates of their corners: ax to cz."""
    for c in "abc":
        tris = tris.join(verts.select("tile", F.col("vid").alias(c), *(F.col(v).alias(f"{c}{v}") for v in "xyz")), ["tile", c])
    return tris


def slope_area(max_slope: float = MAX_SLOPE) -> Column:
    """A triangle's area (columns ax to cz, area), or 0 where its normal leans more than the slope allows, or has no direction."""
    e0 = {v: F.col(f"b{v}") - F.col(f"a{v}") for v in "xyz"}
    e1 = {v: F.col(f"c{v}") - F.col(f"a{v}") for v in "xyz"}
    nx, ny, nz = e0["y"] * e1["z"] - e0["z"] * e1["y"], e0["z"] * e1["x"] - e0["x"] * e1["z"], e0["x"] * e1["y"] - e0["y"] * e1["x"]
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    steep = F.coalesce(ny / F.when(length > 0, length) <= math.cos(math.radians(max_slope)), F.lit(True))
    return F.when(steep, 0).otherwise(F.col("area"))


def place(verts: DataFrame, placements: DataFrame) -> DataFrame:
    """(placement, vid, x, y, z): each model's vertices (model, vid, x, y, z) for each of its placements (placement, model, rx, ry, rz in radians, scale,
    px, py, pz): scaled, turned, moved. A model without vertices has none."""
    joined = placements.join(verts, "model")
    turned = rotate_zyx(*(F.col(v) * F.col("scale") for v in "xyz"), F.col("rx"), F.col("ry"), F.col("rz"))
    joined = joined.withColumn("t", turned)
    return joined.select("placement", "vid", *((F.col(f"t.{v}") + F.col(f"p{v}")).alias(v) for v in "xyz"))


def replace_tiles(tiles: DataFrame, new: DataFrame) -> DataFrame:
    """`tiles` with those of `new` in place of any with the same map, position and layer."""
    keys = ["map_id", "tile_x", "tile_y", "layer"]
    return tiles.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def valid_refs(refs: DataFrame, tiles: DataFrame) -> DataFrame:
    """The rows of `refs` (ref, ...) whose polygon is there: their tile's number is one of `tiles` (tile, salt, polys), it still has the ref's salt, and the polygon's number is below its polys."""
    at = decode_ref(F.col("ref"))
    known = tiles.select(F.col("tile").cast("long").alias("_tile"), F.col("salt").cast("long").alias("_salt"), F.col("polys").alias("_polys"))
    found = refs.withColumns({"_tile": at["tile"].cast("long"), "_salt": at["salt"].cast("long"), "_poly": at["poly"]}).join(known, ["_tile", "_salt"])
    return found.filter((F.col("ref") > 0) & (F.col("_poly") < F.col("_polys"))).select(*refs.columns)


def set_polygons(polys: DataFrame, changes: DataFrame) -> DataFrame:
    """`polys` (ref, area, flags, ...) with the area and flags that `changes` (ref, seq, area, flags) set: for each of both the last by seq that isn't null; changes of refs that aren't there do nothing."""
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("seq"))).alias(f"_{v}") for v in ("area", "flags")]
    return polys.join(changes.groupBy("ref").agg(*last), "ref", "left").withColumns({v: F.coalesce(f"_{v}", v) for v in ("area", "flags")}).select(*polys.columns)


def centroids(edges: DataFrame) -> DataFrame:
    """(ref, x, y, z): the mean of each polygon's corners."""
    return edges.groupBy("ref").agg(*(F.avg(f"a{v}").alias(v) for v in "xyz"))


def is_liquid(area: Column) -> Column:
    return area.between(16, 27)


def terrain_vertices(chunks: DataFrame) -> DataFrame:
    """(chunk, i, row, col, x, y, z) of each chunk (chunk, x, y, z, heights of 145): rows of nine and eight vertices in turn, eight rows between."""
    cells = chunks.select("chunk", "x", "y", "z", F.posexplode("heights").alias("i", "h"))
    pair, rest = F.floor(F.col("i") / 17).cast("int"), (F.col("i") % 17).cast("int")
    odd = rest >= 9
    cells = cells.withColumns({"row": 2 * pair + F.when(odd, 1).otherwise(0), "col": F.when(odd, rest - 9).otherwise(rest)})
    y = F.col("y") - F.col("col") * UNIT - F.when(F.col("row") % 2 == 1, HALF_UNIT).otherwise(0.0)
    return cells.select("chunk", "i", "row", "col", (F.col("x") - F.col("row") * HALF_UNIT).alias("x"), y.alias("y"), (F.col("z") + F.col("h")).alias("z"))


def is_hole(holes: Column, row: Column, col: Column) -> Column:
    """Whether the bit mask cuts out the quad of the inner vertex at (row, col): a bit for two columns and four rows."""
    bit = (F.floor(col / 2) + 4 * F.floor(row / 4)).cast("int")
    return F.shiftright(holes, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0


def terrain_triangles(vertices: DataFrame, holes: DataFrame) -> DataFrame:
    """(chunk, a, b, c): four triangles about each inner vertex that is no hole; `holes` has (chunk, holes)."""
    inner = vertices.filter("row % 2 = 1").join(holes, "chunk").filter(~is_hole(F.col("holes"), F.col("row"), F.col("col")))
    i = F.col("i")
    fans = F.array(*(F.struct((i + p).alias("a"), i.alias("b"), (i + q).alias("c")) for p, q in ((-9, -8), (9, 8), (-8, 9), (8, -9))))
    return inner.select("chunk", F.explode(fans).alias("t")).select("chunk", "t.a", "t.b", "t.c")


def ancestors(areas: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, faction, city): each area's nearest faction that isn't 0 and whether any ancestor is a city, itself included, up to `depth` areas;
    `areas` has (id, parent, flags, faction). A parent of 0 or itself, or one that is missing, ends the chain."""
    at = areas.select("id", F.col("id").alias("now"), F.lit(0).alias("faction"), F.lit(False).alias("city"))
    node = areas.select(F.col("id").alias("area"), F.col("parent"), F.col("flags"), F.col("faction").alias("own"), F.lit(None).cast("long").alias("none")).filter("area IS NOT NULL").hint("merge")  # broadcast, the tables of all rounds would lie in one task
    for _ in range(depth):
        # chains that have ended match nothing, and would all meet in the task of null
        ended = F.when(F.col("now").isNull(), F.xxhash64("id"))
        seen = at.withColumn("ended", ended).join(node, F.col("now").eqNullSafe(F.col("area")) & F.col("ended").eqNullSafe(F.col("none")), "left")
        faction = F.when(F.col("faction") != 0, F.col("faction")).otherwise(F.coalesce("own", F.lit(0)))
        city = F.col("city") | F.coalesce(F.col("flags").bitwiseAND(CITY_FLAGS) != 0, F.lit(False))
        up = F.when((F.col("parent") != 0) & (F.col("parent") != F.col("now")), F.col("parent"))
        at = seen.select("id", up.alias("now"), faction.alias("faction"), city.alias("city"))
    return at.select("id", "faction", "city")


def first_wins(files: DataFrame, name: Column, *priority: Column) -> DataFrame:
    """Of rows with one name, the first by priority: an overlay of archives."""
    order = Window.partitionBy("_name").orderBy(*priority)
    return files.withColumn("_name", name).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_name", "_n")


def internal_links(edges: DataFrame) -> DataFrame:
    """(from_ref, to_ref, edge) of edges with a neighbour in their tile."""
    return edges.filter("nei >= 0").select(F.col("ref").alias("from_ref"), F.col("nei").alias("to_ref"), "edge")


def shared_edges(edges: DataFrame) -> DataFrame:
    """(from_ref, to_ref, edge): polygons with an edge between the same two vertices (va, vb), for each polygon's edge the first other one."""
    low, high = F.least("va", "vb"), F.greatest("va", "vb")
    mine = edges.select(F.col("ref").alias("from_ref"), "edge", low.alias("low"), high.alias("high"))
    other = mine.select(F.col("from_ref").alias("to_ref"), "low", "high")
    return mine.join(other, ["low", "high"]).filter("from_ref <> to_ref").groupBy("from_ref", "edge").agg(F.min("to_ref").alias("to_ref")).select("from_ref", "to_ref", "edge")


def border_links(edges: DataFrame, climb: float) -> DataFrame:
    """(from_ref, to_ref, edge, bmin, bmax) over the borders of tiles.

    `edges` has tile_x and tile_y besides. Two border edges on opposite sides of neighbour tiles link if they lie on one line within BORDER_GAP,
    overlap along it once shrunk by BORDER_SHRINK at each end, and come within two climbs of each other or cross in height. The
    shared range of the first edge is given in 255ths. Coordinates are joined by hundredths, to either side.
    """
    side = (-2 - F.col("nei")).cast("int")
    along_x = side % 2 == 1
    line = F.when(along_x, F.col("az")).otherwise(F.col("ax"))

    def ends(axis: Column, other: Column):
        return F.when(along_x, axis).otherwise(other)

    a, b = ends(F.col("ax"), F.col("az")), ends(F.col("bx"), F.col("bz"))
    open_edges = edges.filter("nei <= -2").select("ref", "edge", "tile_x", "tile_y", side.alias("side"), line.alias("line"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a <= b, F.col("ay")).otherwise(F.col("by")).alias("lo_y"), F.when(a <= b, F.col("by")).otherwise(F.col("ay")).alias("hi_y"), a.alias("start"), b.alias("stop"))
    step = F.element_at(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1, 0), (0, 1), (1, 0), (0, -1)))), F.col("side") + 1)
    place = F.floor(F.col("line") / BORDER_GAP)
    mine = open_edges.withColumns({"to_x": F.col("tile_x") + step["x"], "to_y": F.col("tile_y") + step["y"], "to_side": (F.col("side") + 2) % 4, "slot": F.explode(F.array(place - 1, place, place + 1))})
    names = {"ref": "to_ref", "tile_x": "to_x", "tile_y": "to_y", "side": "to_side", "line": "line2", "lo": "lo2", "hi": "hi2", "lo_y": "lo2_y", "hi_y": "hi2_y"}
    other = open_edges.withColumn("slot", place).select(*(F.col(k).alias(v) for k, v in names.items()), "slot")
    # a border's edges are few bytes, but their pairs are the square of them: they're dealt to tasks by number, each share with all of the other side
    key = ["to_x", "to_y", "to_side", "slot", "share"]
    mine = mine.withColumn("share", F.pmod(F.xxhash64("ref", "edge"), F.lit(BORDER_SHARES)).cast("int")).repartition(BORDER_TASKS, *key)
    other = other.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(BORDER_SHARES - 1)))).repartition(BORDER_TASKS, *key)
    pairs = mine.join(other.hint("merge"), key).filter(F.abs(F.col("line") - F.col("line2")) <= BORDER_GAP)
    low, high = F.greatest("lo", "lo2"), F.least("hi", "hi2")

    def height(at: Column, n: str) -> Column:
        lo, hi = F.col(f"lo{n}"), F.col(f"hi{n}")
        return F.col(f"lo{n}_y") + (F.col(f"hi{n}_y") - F.col(f"lo{n}_y")) * (at - lo) / F.when(hi > lo, hi - lo)

    at_low, at_high = low + BORDER_SHRINK, high - BORDER_SHRINK
    d0, d1 = height(at_low, "2") - height(at_low, ""), height(at_high, "2") - height(at_high, "")
    near = (at_low <= at_high) & ((d0 * d1 < 0) | (F.abs(d0) <= 2 * climb) | (F.abs(d1) <= 2 * climb))
    pairs = pairs.filter(overlaps(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")) & near)
    t0, t1 = (low - F.col("start")) / (F.col("stop") - F.col("start")), (high - F.col("start")) / (F.col("stop") - F.col("start"))

    def steps(t: Column) -> Column:
        return F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * LINK_STEPS + 0.5).cast("int")

    return pairs.select(F.col("ref").alias("from_ref"), "to_ref", "edge", steps(F.least(t0, t1)).alias("bmin"), steps(F.greatest(t0, t1)).alias("bmax"))


def wall_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of polygons that no link goes through."""
    return edges.join(links.select(F.col("from_ref").alias("ref"), "edge"), ["ref", "edge"], "left_anti")


def snap_to_border(value: Column, size: int, within: int = 2) -> Column:
    """A vertex coordinate in cells, moved to the tile's border if it is nearer than `within`."""
    return F.when(value < within, 0).when(value > size - within, size).otherwise(value)


def by_area(polys: DataFrame) -> DataFrame:
    """(tile, area, n) of walkable polygons; 63 is plain ground."""
    walkable = polys.filter("area <> 0").withColumn("area", F.when(F.col("area") == 63, 1).otherwise(F.col("area")))
    return walkable.groupBy("tile", "area").agg(F.count("*").alias("n"))
