"""Heightfield columns: spans per cell, their merging, the walkability filters, and neighbour links.

Spans are rows of (x, z, smin, smax, area) with smin < smax, in voxels. Filters look along a cell's column through windows and at its four
neighbours through joins on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Fixed values, in voxels: height, climb and radius of a walker, and the most layers that links count.
WALKER_HEIGHT, WALKER_CLIMB, WALKER_RADIUS, MAX_LAYER, OPEN_TOP = 10, 6, 3, 62, 0xFFFF
#: Steps to the neighbours in the order of their directions.
DIRECTIONS = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _column() -> WindowSpec:
    return Window.partitionBy("x", "z").orderBy("smin", "smax")


def coalesce_spans(spans: DataFrame) -> DataFrame:
    """(x, z, layer, smin, smax, area): spans that overlap or touch are one; its area is the largest among those whose top is within
    a climb of its own."""
    # equal spans are one from here on, so the order below has no ties and both windows agree
    spans = spans.groupBy("x", "z", "smin", "smax").agg(F.max("area").alias("area"))
    before = Window.partitionBy("x", "z").orderBy("smin", "smax").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("starts", F.coalesce(F.col("smin") > F.max("smax").over(before), F.lit(True)).cast("int"))
    islands = marked.withColumn("layer", F.sum("starts").over(_column().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    tops = islands.withColumn("top", F.max("smax").over(Window.partitionBy("x", "z", "layer")))
    area = F.max(F.when(F.col("top") - F.col("smax") <= WALKER_CLIMB, F.col("area")))
    return tops.groupBy("x", "z", "layer").agg(F.min("smin").alias("smin"), F.max("smax").alias("smax"), area.alias("area"))


def filter_low_obstacles(spans: DataFrame, climb: int = WALKER_CLIMB) -> DataFrame:
    """A span of no area takes that of a walkable span right below it, if its top is within a climb; such areas aren't passed on."""
    below_area, below_top = F.lag("area").over(_column()), F.lag("smax").over(_column())
    steps_up = (F.col("area") == 0) & (below_area > 0) & (F.col("smax") - below_top <= climb)
    return spans.withColumn("area", F.when(steps_up, below_area).otherwise(F.col("area")))


def filter_low_ceilings(spans: DataFrame, height: int = WALKER_HEIGHT) -> DataFrame:
    """Spans with less than the walker's height above them have no area."""
    room = F.coalesce(F.lead("smin").over(_column()), F.lit(OPEN_TOP)) - F.col("smax")
    return spans.withColumn("area", F.when(room < height, 0).otherwise(F.col("area")))


def with_open_space(spans: DataFrame) -> DataFrame:
    """`spans` with floor and ceiling of the space above each."""
    return spans.withColumns({"floor": F.col("smax"), "ceiling": F.coalesce(F.lead("smin").over(_column()), F.lit(OPEN_TOP))})


def _steps() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for d, (dx, dz) in enumerate(DIRECTIONS)))).alias("step")


def filter_ledges(spans: DataFrame, width: int, depth: int, height: int = WALKER_HEIGHT, climb: int = WALKER_CLIMB) -> DataFrame:
    """Walkable spans beside a drop of more than a climb, or on a slope whose reachable neighbours differ by more than one, have no area.

    The field is width x depth cells. A neighbour column's gap under its lowest span counts as a drop, and a cell beyond the field
    always does; reachable are spans alone.
    """
    open_spans = with_open_space(spans).withColumn("span_id", F.struct("x", "z", "smin", "smax"))
    asked = open_spans.filter("area > 0").select("span_id", "floor", "ceiling", "x", "z", _steps())
    asked = asked.select("span_id", "floor", "ceiling", (F.col("x") + F.col("step.dx")).alias("x"), (F.col("z") + F.col("step.dz")).alias("z"))
    lowest = open_spans.groupBy("x", "z").agg(F.min("smin").alias("n_ceiling")).select("x", "z", "n_ceiling", F.lit(-climb).alias("n_floor"), F.lit(False).alias("solid"))
    gaps = open_spans.select("x", "z", F.col("ceiling").alias("n_ceiling"), F.col("floor").alias("n_floor"), F.lit(True).alias("solid")).unionByName(lowest)
    beside = asked.join(gaps, ["x", "z"], "left")
    beside = beside.select("span_id", "floor", "ceiling", (~F.col("x").between(0, width - 1) | ~F.col("z").between(0, depth - 1)).alias("outside"), F.coalesce("n_floor", F.lit(-climb)).alias("n_floor"), F.coalesce("n_ceiling", F.lit(OPEN_TOP)).alias("n_ceiling"), F.coalesce("solid", F.lit(False)).alias("solid"))
    fits = F.least("ceiling", "n_ceiling") - F.greatest("floor", "n_floor") > height
    drop = F.col("n_floor") - F.col("floor")
    reachable = fits & F.col("solid") & (F.abs(drop) <= climb) & ~F.col("outside")
    seen = beside.groupBy("span_id").agg(F.min(F.when(fits | F.col("outside"), drop)).alias("drop"), F.min(F.when(reachable, F.col("n_floor"))).alias("low"), F.max(F.when(reachable, F.col("n_floor"))).alias("high"))
    floor = F.col("span_id.smax")
    bad = seen.filter((F.coalesce("drop", F.lit(OPEN_TOP)) < -climb) | (F.greatest(F.coalesce("high", floor), floor) - F.least(F.coalesce("low", floor), floor) > climb))
    kept = open_spans.join(bad.select("span_id").withColumn("ledge", F.lit(True)), "span_id", "left")
    return kept.withColumn("area", F.when(F.col("ledge"), 0).otherwise(F.col("area"))).select(*spans.columns)


def neighbour_links(spans: DataFrame, height: int = WALKER_HEIGHT, climb: int = WALKER_CLIMB) -> DataFrame:
    """(x, z, layer, dir, to_layer): from each walkable span to the first one of each neighbour cell that a walker can step to."""
    layer = F.row_number().over(_column()) - 1
    space = with_open_space(spans).filter("area > 0").withColumn("layer", layer).filter(F.col("layer") <= MAX_LAYER)
    asked = space.select("x", "z", "layer", "floor", "ceiling", _steps())
    asked = asked.withColumns({"nx": F.col("x") + F.col("step.dx"), "nz": F.col("z") + F.col("step.dz")})
    others = space.select(F.col("x").alias("nx"), F.col("z").alias("nz"), F.col("layer").alias("to_layer"), F.col("floor").alias("n_floor"), F.col("ceiling").alias("n_ceiling"))
    room = F.least("ceiling", "n_ceiling") - F.greatest("floor", "n_floor")
    steps = asked.join(others, ["nx", "nz"]).filter((room >= height) & (F.abs(F.col("n_floor") - F.col("floor")) <= climb))
    return steps.groupBy("x", "z", "layer", F.col("step.dir").alias("dir")).agg(F.min("to_layer").alias("to_layer"))


def median_areas(cells: DataFrame) -> DataFrame:
    """(x, z, area): the fifth of the nine areas around each walkable cell in order; a missing or unwalkable neighbour counts as the cell."""
    around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dz in (-1, 0, 1)))).alias("step")
    asked = cells.select("x", "z", F.col("area").alias("own"), around).withColumns({"nx": F.col("x") + F.col("step.dx"), "nz": F.col("z") + F.col("step.dz")})
    other = cells.select(F.col("x").alias("nx"), F.col("z").alias("nz"), F.col("area").alias("other"))
    found = asked.join(other, ["nx", "nz"], "left").withColumn("seen", F.when(F.coalesce("other", F.lit(0)) > 0, F.col("other")).otherwise(F.col("own")))
    nine = found.groupBy("x", "z").agg(F.first("own").alias("own"), F.array_sort(F.collect_list("seen")).alias("seen"))  # nine of each cell
    return nine.select("x", "z", F.when(F.col("own") == 0, 0).otherwise(F.element_at("seen", 5)).alias("area"))
