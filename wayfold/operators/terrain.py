"""Coverage of terrain chunks: road, liquid and faction rectangles in the mesh's frame (x from game y, z from game x).

Chunks are rows with the game coordinates x, y of their corner; cells are 8 x 8 units that run toward smaller x (rows) and y (columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .meshes import UNIT

# Paddings of rectangles, and the areas of liquid kinds.
ROAD_PADDING, WATER_PADDING = 0.01, 0.05
LIQUID_AREAS = {"water": 16, "ocean": 19, "magma": 22, "slime": 25}


def _rect(row: Column, col: Column, padding: float, height: Column | int = 1, width: Column | int = 1) -> list[Column]:
    """minx, maxx, minz and maxz of cells from (row, col)."""
    return [
        (F.col("y") - (col + width) * UNIT - padding).alias("minx"),
        (F.col("y") - col * UNIT + padding).alias("maxx"),
        (F.col("x") - (row + height) * UNIT - padding).alias("minz"),
        (F.col("x") - row * UNIT + padding).alias("maxz"),
    ]


def road_rects(chunks: DataFrame, roads: DataFrame) -> DataFrame:
    """(chunk, cell, minx, maxx, minz, maxz) of cells whose main texture is a road; `chunks` has (chunk, x, y, pred_tex: 16 bytes of two bits a cell, low
    bits first, layers: texture ids), `roads` (texture_id)."""
    cells = chunks.select("chunk", "x", "y", "pred_tex", "layers", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell"))
    byte = F.element_at("pred_tex", (F.floor(F.col("cell") / 4) + 1).cast("int"))
    layer = F.floor(byte / F.pow(F.lit(4), F.col("cell") % 4)).cast("int") % 4
    cells = cells.withColumn("layer", layer).filter(F.col("layer") < F.size("layers"))
    cells = cells.withColumn("texture_id", F.element_at("layers", F.col("layer") + 1)).join(roads, "texture_id", "left_semi")
    return cells.select("chunk", "cell", *_rect(F.floor(F.col("cell") / 8), F.col("cell") % 8, ROAD_PADDING))


def liquid_rects(liquids: DataFrame, kinds: DataFrame) -> DataFrame:
    """(chunk, instance, cell, minx, maxx, minz, maxz, h0, h1, h2, h3, type) of the rendered cells of liquid instances.

    `liquids` has (chunk, instance, x, y, liquid, off_x, off_y, width, height, max_h, mask: bytes of a bit a cell, low bits first, or null for all, heights: (width
    + 1) x (height + 1), or null for max_h); `kinds` (liquid, kind). A liquid of no known kind is water.
    """
    named = liquids.join(F.broadcast(kinds), "liquid", "left")  # the game's table of liquids
    areas = F.create_map(*(F.lit(v) for pair in LIQUID_AREAS.items() for v in pair))
    named = named.withColumn("type", F.coalesce(F.try_element_at(areas, F.col("kind")), F.lit(LIQUID_AREAS["water"])))
    cells = named.filter("width * height > 0").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    byte = F.element_at("mask", (F.floor(F.col("cell") / 8) + 1).cast("int"))
    cells = cells.filter(F.col("mask").isNull() | (F.floor(byte / F.pow(F.lit(2), F.col("cell") % 8)) % 2 == 1))
    row, col = F.floor(F.col("cell") / F.col("width")), F.col("cell") % F.col("width")

    def corner(down: int, right: int) -> Column:
        at = ((row + down) * (F.col("width") + 1) + col + right + 1).cast("int")
        return F.coalesce(F.try_element_at("heights", at), F.col("max_h"))

    # h0 to h3 are the corners from (minx, minz); columns run toward smaller x, rows toward smaller z
    heights = [corner(1, 1).alias("h0"), corner(1, 0).alias("h1"), corner(0, 1).alias("h2"), corner(0, 0).alias("h3")]
    return cells.select("chunk", "instance", "cell", *_rect(F.col("off_y") + row, F.col("off_x") + col, WATER_PADDING), *heights, "type")


def faction_rects(chunks: DataFrame, areas: DataFrame) -> DataFrame:
    """(chunk, minx, maxx, minz, maxz, faction, city) of whole chunks (chunk, x, y, area_id) whose area has a faction or is a city; area 0 has neither."""
    known = areas.filter("faction <> 0 OR city").select(F.col("id").alias("area_id"), "faction", "city")
    return chunks.filter("area_id <> 0").join(known, "area_id").select("chunk", *_rect(F.lit(0), F.lit(0), ROAD_PADDING, 8, 8), "faction", "city")
