"""Area types of polygons: kinds, factions, flags and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kinds in the order of their ids, three ids each (neutral, alliance, horde), with flags and cost.
KINDS = [
    ("ground", 4, 1.0),
    ("road", 12, 0.75),
    ("city", 4, 1.0),
    ("wmo", 4, 1.0),
    ("doodad", 4, 1.0),
    ("water", 2, 1.6),
    ("ocean", 2, 1.6),
    ("lava", 1, 4.0),
    ("slime", 1, 4.0),
]
FACTION_FLAGS = (0, 16, 32)
ALL_FLAGS = 63
UNSCALED = ("lava", "slime")
STATES = ("normal", "alliance", "horde", "dead")
FACTION_COST = 3.0
#: States whose walkers find the other faction's ground dangerous, and that faction.
DANGER = {"alliance": 2, "horde": 1}


def area_rows() -> list[tuple[int, str, int, int, float]]:
    """(id, kind, faction, flags, cost) of ids 1 to 27, and of 0, which is no area."""
    rows = [(0, "none", 0, 0, 0.0)]
    for k, (kind, flags, cost) in enumerate(KINDS):
        rows += [(3 * k + f + 1, kind, f, flags + FACTION_FLAGS[f], cost) for f in range(3)]
    return rows


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(area_rows(), "area int, kind string, faction int, flags int, cost double")


def default_costs(spark: SparkSession, faction_cost: float = FACTION_COST) -> DataFrame:
    """(state, area, cost): the cost of each area to a walker in each state."""
    rows = []
    for state in STATES:
        for area, kind, faction, _, cost in area_rows()[1:]:
            if state == "dead":
                cost = 1.0
            elif DANGER.get(state) == faction and kind not in UNSCALED:
                cost *= faction_cost
            rows.append((state, area, cost))
    return spark.createDataFrame(rows, "state string, area int, cost double")


# Fixed values of the older tile formats: bits of their areas, those that walkers take and refuse, and costs, which are kept under the bit as area number.
MMAP_BITS = {"335a": {"ground": 1, "steep": 2, "water": 4, "magma_slime": 8}, "548": {"ground": 1, "magma": 2, "slime": 4, "water": 8}}
MMAP_REFUSED = ("steep",)
MMAP_WATER_COST, MMAP_LIQUID_COST = 1.3, 4.0


def mmap_rows(water: float = MMAP_WATER_COST, liquid: float = MMAP_LIQUID_COST) -> list[tuple[str, str, int, int, dict[int, float]]]:
    """(format, state, include, exclude, costs other than 1 by area number) of the filters that tiles of the older formats start with; the dead pay nothing extra."""
    rows = []
    for kind, bits in MMAP_BITS.items():
        refused = sum(b for n, b in bits.items() if n in MMAP_REFUSED)
        costs = {b: water if n == "water" else liquid for n, b in bits.items() if n not in (*MMAP_REFUSED, "ground")}
        rows += [(kind, state, sum(bits.values()) - refused, refused, {} if state == "dead" else costs) for state in STATES]
    return rows


def mmap_filters(spark: SparkSession, water: float = MMAP_WATER_COST, liquid: float = MMAP_LIQUID_COST) -> DataFrame:
    """mmap_rows() as a table (format, state, include, exclude, costs): one row for each format and state."""
    return spark.createDataFrame(mmap_rows(water, liquid), "format string, state string, include int, exclude int, costs map<int,double>")
