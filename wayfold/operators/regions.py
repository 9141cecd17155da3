"""Rectangles over points and cells: range joins by grid bucket, look-ups, and area marking.

Spark has no range join but the nested loop. Here a rectangle is put in each bucket of a square grid that it touches and a point in its
own; the join is an equi-join on the bucket with the exact test as a residual. Buckets are sized to the rectangles, so a rectangle
touches few; a bucket of very many points is a skewed key of a join that adaptive execution splits.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 33.3334
WATER_TOLERANCE = 0.5
# Areas that marking tests for or sets.
GROUND, ROAD, CITY, WMO, LAST_DOODAD, WATER, LAST_LIQUID, WALKABLE = 1, 4, 7, 10, 15, 16, 27, 63


def in_buckets(rects: DataFrame, size: float = BUCKET) -> DataFrame:
    """`rects` (minx, maxx, minz, maxz) once for each bucket (bx, bz) that they touch."""

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    return rects.withColumn("bx", span("minx", "maxx")).withColumn("bz", span("minz", "maxz"))


def rects_at(points: DataFrame, rects: DataFrame, size: float = BUCKET) -> DataFrame:
    """Each point (x, z) with each rectangle that has it, edges included."""
    placed = points.withColumns({"bx": F.floor(F.col("x") / size), "bz": F.floor(F.col("z") / size)})
    inside = "x >= minx AND x <= maxx AND z >= minz AND z <= maxz"
    return placed.join(in_buckets(rects, size), ["bx", "bz"]).filter(inside).drop("bx", "bz")


def water_height(x: Column, z: Column) -> Column:
    """Height of a rectangle's surface over (x, z): bilinear between its corners h0 (minx, minz), h1 (maxx, minz), h2 (minx, maxz), h3."""
    def share(v: Column, low: Column, high: Column) -> Column:
        return F.when(high > low, F.least(F.greatest((v - low) / F.when(high > low, high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    tx, tz = share(x, F.col("minx"), F.col("maxx")), share(z, F.col("minz"), F.col("maxz"))
    near, far = F.col("h0") + (F.col("h1") - F.col("h0")) * tx, F.col("h2") + (F.col("h3") - F.col("h2")) * tx
    return near + (far - near) * tz


def water_at(points: DataFrame, rects: DataFrame, key: str) -> DataFrame:
    """(key, height, type) of the highest water over each point that has any; the first rectangle of equal heights."""
    found = rects_at(points, rects).withColumn("height", water_height(F.col("x"), F.col("z")))
    best = F.max_by(F.struct("height", "type"), F.struct(F.col("height"), -F.col("rect_seq"))).alias("w")
    return found.groupBy(key).agg(best).select(key, "w.height", "w.type")


def covered(points: DataFrame, rects: DataFrame, key: str) -> DataFrame:
    """The points that a rectangle covers."""
    return points.join(rects_at(points, rects).select(key).distinct(), key, "left_semi")


def _first_rect(spans: DataFrame, rects: DataFrame, columns: list[str], extra: Column | None = None) -> DataFrame:
    """(span_id, and `columns` of the first rectangle over the span's cell for which `extra` holds)."""
    found = rects_at(spans, rects, 8.0)
    if extra is not None:
        found = found.filter(extra)
    return found.groupBy("span_id").agg(F.min_by(F.struct(*columns), "rect_seq").alias("first")).select("span_id", *(f"first.{c}" for c in columns))


def mark_water(spans: DataFrame, rects: DataFrame, cell_height: float) -> DataFrame:
    """Spans (span_id, x, z, y, area, cells by (x, z)) with the type of the first water rectangle over them as area.

    The span's top must be no higher than the rectangle's highest corner and WATER_TOLERANCE. Liquids and structures keep their areas, and so
    does a span that has a structure at most three cells above it in its column.
    """
    open_area = ~F.col("area").between(WATER, LAST_LIQUID) & ~F.col("area").between(WMO, LAST_DOODAD)
    top = F.greatest("h0", "h1", "h2", "h3") + WATER_TOLERANCE
    # a cell's height is a decimal fraction, so whole cells are taken times it without its error as a double: 63 cells of 0.2 are 12.6
    step = Fraction(str(cell_height))
    wet = _first_rect(spans.filter(open_area), rects, ["type"], F.col("y") * float(step.numerator) / float(step.denominator) <= top)
    above = spans.filter(F.col("area").between(WMO, LAST_DOODAD)).select("x", "z", F.col("y").alias("y_above"))
    near = (F.col("y_above") > F.col("y")) & ((F.col("y_above") - F.col("y")) * cell_height <= 3 * cell_height)
    bridges = spans.join(above, ["x", "z"]).filter(near).select("span_id").distinct()
    marked = wet.join(bridges, "span_id", "left_anti")
    return spans.join(marked, "span_id", "left").withColumn("area", F.coalesce("type", "area")).drop("type")


def mark_ground(spans: DataFrame, rects: DataFrame, area: int) -> DataFrame:
    """Spans of plain ground under a rectangle get `area`; a road or city."""
    plain = F.col("area").isin(WALKABLE, GROUND)
    under = rects_at(spans.filter(plain), rects, 8.0).select("span_id").distinct().withColumn("under", F.lit(True))
    return spans.join(under, "span_id", "left").withColumn("area", F.when(F.col("under"), area).otherwise(F.col("area"))).drop("under")


def mark_factions(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """Neutral areas under a rectangle become those of the faction of the first one."""
    neutral = F.col("area").between(1, LAST_LIQUID) & ((F.col("area") - 1) % 3 == 0)
    first = _first_rect(spans.filter(neutral), rects, ["faction"])
    return spans.join(first, "span_id", "left").withColumn("area", F.col("area") + F.coalesce("faction", F.lit(0))).drop("faction")


def mark_all(spans: DataFrame, water: DataFrame, roads: DataFrame, cities: DataFrame, factions: DataFrame, cell_height: float) -> DataFrame:
    """Water, then roads, then cities, then factions."""
    marked = mark_ground(mark_ground(mark_water(spans, water, cell_height), roads, ROAD), cities, CITY)
    return mark_factions(marked, factions)
