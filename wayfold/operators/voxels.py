"""Triangles to voxels, and distances over walkable cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WALKER_CLIMB, WALKER_RADIUS
from .rounds import cut, relax

# The highest voxel, and steps of the chamfer distance to straight and diagonal neighbours.
MAX_HEIGHT, STRAIGHT, DIAGONAL = 8191, 2, 3

SPANS = "tile long, x int, z int, smin int, smax int, area int"


#: Pieces of triangles that are cut at once, and tasks that triangles are dealt to.
PIECES, TASKS = 1 << 15, 64

#: Convex polygons side by side: an array of each axis (corner, polygon), and how many corners each polygon has.
Polygons = tuple[dict[str, np.ndarray], np.ndarray]


def _cut(polygons: Polygons, axis: str, side: int, plane: np.ndarray) -> tuple[Polygons, np.ndarray]:
    """What lies on one side of each polygon's plane across an axis, and which of the polygons it is of."""
    poly, count = polygons
    far = side * (poly[axis] - plane)
    out = {v: np.empty((2 * len(far), far.shape[1])) for v in poly}
    filled = np.zeros(far.shape[1], np.int64)
    for i in range(len(far)):
        there = i < count
        last = i + 1 == count
        after = np.where(last, far[0], far[(i + 1) % len(far)])
        at = np.flatnonzero(there & (far[i] >= 0))
        for v in poly:
            out[v][filled[at], at] = poly[v][i, at]
        filled[at] += 1
        at = np.flatnonzero(there & ((far[i] < 0) != (after < 0)))
        t = far[i, at] / (far[i, at] - after[at])
        to = np.where(last[at], 0, (i + 1) % len(far))
        for v in poly:
            here = poly[v][i, at]
            out[v][filled[at], at] = here + (poly[v][to, at] - here) * t
        filled[at] += 1
    kept = np.flatnonzero(filled >= 3)
    most = filled.max(initial=0)
    return ({v: a[:most, kept] for v, a in out.items()}, filled[kept]), kept


def _range(polygons: Polygons, axis: str) -> tuple[np.ndarray, np.ndarray]:
    poly, count = polygons
    there = np.arange(len(poly[axis]))[:, None] < count
    return np.where(there, poly[axis], np.inf).min(axis=0, initial=np.inf), np.where(there, poly[axis], -np.inf).max(axis=0, initial=-np.inf)


def _strips(polygons: Polygons, axis: str, cell: float) -> Iterator[tuple[Polygons, np.ndarray, np.ndarray]]:
    """Polygons cut into strips of a cell's width across an axis, a bounded number at a time however large a polygon is: the pieces, the polygon of each, and the number of its strip."""
    poly, count = polygons
    if not len(count):
        return
    low, high = (np.floor(e / cell) for e in _range(polygons, axis))
    if not (np.maximum(np.abs(low), np.abs(high)) < 2**31).all():
        raise ValueError("a triangle's corner isn't a number, or lies outside the field")
    low, high = low.astype(np.int64), high.astype(np.int64)
    ends = np.cumsum(high - low + 1)
    for start in range(0, int(ends[-1]), PIECES):
        number = np.arange(start, min(start + PIECES, int(ends[-1])))
        of = np.searchsorted(ends, number, side="right")
        strip = high[of] - (ends[of] - 1 - number)
        pieces = {v: a[:, of] for v, a in poly.items()}, count[of]
        for side in (1, -1):
            pieces, kept = _cut(pieces, axis, side, (strip if side == 1 else strip + 1) * cell)
            of, strip = of[kept], strip[kept]
        yield pieces, of, strip


def _spans(corners: dict[str, np.ndarray], cell: float, height: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the triangle, x, z, smin, smax) of triangles (arrays x, y and z, three rows each, from the field's origin) in each cell that they meet: first rows, then cells of a row."""
    triangles = corners, np.full(corners["x"].shape[1], 3)
    for (rows, count), of, z in _strips(triangles, "z", cell):
        for cells, row, x in _strips(({v: rows[v] for v in "xy"}, count), "x", cell):
            least, most = _range(cells, "y")
            low = np.clip(np.floor(least / height), 0, MAX_HEIGHT)
            yield of[row], x, z[row], low, np.minimum(np.maximum(np.ceil(most / height), low + 1), MAX_HEIGHT)


def spans_of(corners: list[tuple], cell: float, height: float) -> Iterator[tuple[int, int, int, int]]:
    """(x, z, smin, smax) of one triangle in each cell that it meets."""
    for _, *span in _spans({v: np.array([[c[k]] for c in corners], float) for k, v in enumerate("xyz")}, cell, height):
        yield from zip(*(c.astype(int).tolist() for c in span), strict=True)


def _merged(spans: list[np.ndarray], climb: int) -> list[np.ndarray]:
    """Spans (tile, x, z, smin, smax, area) of which those of a cell that overlap or touch are one; it has a row for each top that is within a climb of its own, with the largest area
    there. What spans join it later can only put its top higher, so columns.coalesce_spans() makes the same of these rows."""
    order = np.lexsort((spans[4], *(spans[k] for k in (3, 1, 2, 0))))
    tile, x, z, low, high, area = (c[order] for c in spans)
    first = np.ones(len(low), bool)
    first[1:] = (np.diff(tile) != 0) | (np.diff(x) != 0) | (np.diff(z) != 0)
    above = np.cumsum(first) * (MAX_HEIGHT + 2)  # cells one over another, so that one running maximum serves all
    first[1:] |= low[1:] + above[1:] > np.maximum.accumulate(high + above)[:-1]
    starts, of = np.flatnonzero(first), np.cumsum(first) - 1
    kept = np.flatnonzero(np.maximum.reduceat(high, starts)[of] - high <= climb)
    kept = kept[np.lexsort((area[kept], high[kept], of[kept]))]
    last = np.ones(len(kept), bool)
    last[:-1] = (np.diff(of[kept]) != 0) | (np.diff(high[kept]) != 0)
    kept = kept[last]
    return [tile[kept], x[kept], z[kept], low[starts][of[kept]], high[kept], area[kept]]


def rasterize(tris: DataFrame, cell: float, height: float, merge: bool = False) -> DataFrame:
    """(tile, x, z, smin, smax, area): the raw spans of triangles (tile, ax to cz, area), each by itself, so work is spread by triangle; those of a batch are cut side by side.
    With `merge`, for columns.coalesce_spans() by tile: a task's spans that overlap are one before they leave it, with what that needs for its area."""
    names = [f"{c}{v}" for c in "abc" for v in "xyz"]
    unset = -(2**63)

    def run(batches):
        def given(spans):
            tile, *numbers = (pa.array(c, mask=c == unset) for c in spans)
            return pa.RecordBatch.from_arrays([tile, *(c.cast(pa.int32()) for c in numbers)], names=["tile", "x", "z", "smin", "smax", "area"])

        held = []
        for batch in batches:
            tile, area = (batch[n].cast(pa.int64()).fill_null(unset).to_numpy() for n in ("tile", "area"))
            for of, *span in _spans({v: np.stack([batch[f"{c}{v}"].to_numpy() for c in "abc"]) for v in "xyz"}, cell, height):
                spans = [tile[of], *(c.astype(np.int64) for c in span), area[of]]
                if not len(of):
                    continue
                if not merge:
                    yield given(spans)
                    continue
                held.append(_merged(spans, WALKER_CLIMB))
                if sum(len(h[0]) for h in held) > 8 * PIECES:
                    held = [_merged([np.concatenate(c) for c in zip(*held, strict=True)], WALKER_CLIMB)]
                    if len(held[0][0]) > 4 * PIECES:
                        yield given(held.pop())
        if held:
            yield given(_merged([np.concatenate(c) for c in zip(*held, strict=True)], WALKER_CLIMB))

    whole = tris.select("tile", *(F.col(n).cast("double").alias(n) for n in names), "area").filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
    # few bytes a triangle and much work, so triangles are dealt by what they are
    return whole.repartition(TASKS, *names).mapInArrow(run, SPANS)


def edge_distance(spans: DataFrame, links: DataFrame) -> DataFrame:
    """(x, z, layer, distance): chamfer distance of each walkable span to the nearest one that lacks a neighbour; `links` are those of
    columns.neighbour_links and `spans` the walkable (x, z, layer). Diagonal steps go by two links at right angles."""
    node = F.struct("x", "z", "layer")
    dirs = {0: (-1, 0), 1: (0, 1), 2: (1, 0), 3: (0, -1)}
    dx = F.element_at(F.array(*(F.lit(dirs[i][0]) for i in range(4))), F.col("dir") + 1)
    dz = F.element_at(F.array(*(F.lit(dirs[i][1]) for i in range(4))), F.col("dir") + 1)
    links = cut(links)
    steps = links.select(node.alias("node"), "dir", F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z"), F.col("to_layer").alias("layer")).alias("to_node"))
    turn = steps.select(F.col("node").alias("to_node"), F.col("dir").alias("dir2"), F.col("to_node").alias("end"))
    diagonal = steps.join(turn, "to_node").filter((F.col("dir") + F.col("dir2")) % 2 == 1).select("node", F.col("end").alias("to_node"), F.lit(float(DIAGONAL)).alias("weight")).distinct()
    arcs = steps.select("node", "to_node", F.lit(float(STRAIGHT)).alias("weight")).unionByName(diagonal)
    inner = steps.groupBy("node").agg(F.count("*").alias("n")).filter("n = 4")
    rim = spans.select(node.alias("node")).join(inner, "node", "left_anti").select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))
    return relax(rim, arcs).select("node.x", "node.z", "node.layer", F.col("cost").cast("int").alias("distance"))


def erode(spans: DataFrame, links: DataFrame, radius: int = WALKER_RADIUS) -> DataFrame:
    """The walkable spans that are at least `radius` cells from any edge."""
    far = edge_distance(spans, links).filter(F.col("distance") >= 2 * radius).select("x", "z", "layer")
    return spans.join(far, ["x", "z", "layer"], "left_semi")


def _turned(direction: str, by: int) -> Column:
    return (F.col(direction) + by) % 4


def _step_targets(links: DataFrame) -> DataFrame:
    """(node, dir, to_node) of columns.neighbour_links."""
    step = F.element_at(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in ((-1, 0), (0, 1), (1, 0), (0, -1)))), F.col("dir") + 1)
    return links.select(F.struct("x", "z", "layer").alias("node"), "dir", F.struct((F.col("x") + step["dx"]).alias("x"), (F.col("z") + step["dz"]).alias("z"), F.col("to_layer").alias("layer")).alias("to_node"))


def distance_field(spans: DataFrame, links: DataFrame) -> DataFrame:
    """(x, z, layer, distance): how far each walkable span (x, z, layer, area) is from the next border of its area, in halves of a cell: the least sum over ways of
    links, 2 for one and 3 for two at right angles. A span without four neighbours of its own area is a border; one that no border can be reached from, by links,
    isn't returned. Only what became nearer is moved on in a round."""
    steps = _step_targets(links)
    area = spans.select(F.struct("x", "z", "layer").alias("node"), "area")
    alike = steps.join(area, "node").join(area.select(F.col("node").alias("to_node"), F.col("area").alias("to_area")), "to_node").filter("area = to_area")
    inner = alike.groupBy("node").agg(F.count("*").alias("n")).filter("n = 4").select("node")
    turn = steps.select(F.col("node").alias("to_node"), F.col("dir").alias("dir2"), F.col("to_node").alias("end"))
    diagonal = steps.join(turn, "to_node").filter(F.col("dir2") == _turned("dir", 3)).select(F.col("end").alias("node"), F.col("node").alias("to_node"), F.lit(float(DIAGONAL)).alias("weight"))
    arcs = steps.select(F.col("to_node").alias("node"), F.col("node").alias("to_node"), F.lit(float(STRAIGHT)).alias("weight")).unionByName(diagonal)
    arcs = arcs.groupBy("node", "to_node").agg(F.min("weight").alias("weight"))
    rim = area.select("node").join(inner, "node", "left_anti").select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))
    return relax(rim, arcs).select("node.x", "node.z", "node.layer", F.col("cost").cast("int").alias("distance"))


def blurred(distances: DataFrame, links: DataFrame, threshold: int = 1) -> DataFrame:
    """`distances` with each that is above twice the `threshold` replaced by the rounded mean of it and its eight neighbours'; a neighbour that no link leads
    to counts as the span itself, a missing straight one also for the diagonal behind it."""
    steps = _step_targets(links)
    own = distances.select(F.struct("x", "z", "layer").alias("node"), F.col("distance").alias("own"))
    value = own.select(F.col("node").alias("to_node"), F.col("own").alias("value"))
    asked = own.filter(F.col("own") > 2 * threshold).withColumn("dir", F.explode(F.array(*map(F.lit, range(4)))))
    straight = asked.join(steps, ["node", "dir"], "left").join(value, "to_node", "left").withColumn("dir2", _turned("dir", 1))
    behind = steps.select(F.col("node").alias("to_node"), F.col("dir").alias("dir2"), F.col("to_node").alias("end"))
    both = straight.join(behind, ["to_node", "dir2"], "left").join(value.select(F.col("to_node").alias("end"), F.col("value").alias("value2")), "end", "left")
    total = F.sum(F.coalesce("value", "own") + F.coalesce("value2", "own"))
    mean = both.groupBy("node").agg(F.floor((total + F.first("own") + 5) / 9).cast("int").alias("mean"))
    return own.join(mean, "node", "left").select("node.x", "node.z", "node.layer", F.coalesce("mean", "own").alias("distance"))
