"""Clients' filters, configuration and the routing of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Request types by number, the least bytes of their payloads, and configuration keys with types and defaults.
REQUEST_TYPES = {0: "PATH", 1: "MOVE_ALONG_SURFACE", 2: "RANDOM_POINT", 3: "RANDOM_POINT_AROUND", 4: "CAST_RAY", 5: "RANDOM_PATH", 6: "EXPLORE_POLY", 7: "CONFIGURE_FILTER", 8: "GET_HEIGHT", 9: "GET_CONFIG"}
UNANSWERED = ("EXPLORE_POLY",)
DEFAULTS = {
    "bUseAnpFileFormat": "0",
    "fCatmullRomSplineAlpha": "0.5",
    "fFactionDangerCost": "3.0",
    "fRandomPathMaxDistance": "1.0",
    "iBezierCurvePoints": "8",
    "iCatmullRomSplinePoints": "4",
    "iMaxPointPath": "512",
    "iMaxPolyPath": "2048",
    "iMaxSearchNodes": "65535",
    "iMmapFormat": "0",
    "iPort": "47110",
    "sIp": "127.0.0.1",
    "sMmapsPath": "C:\\meshes\\",
}


def resolve_filters(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """(client_id, area, cost): each client's costs, its last for an area (client_id, seq, state, area, cost) over those of its last state."""
    last = requests.groupBy("client_id", "area").agg(F.max_by("cost", "seq").alias("own"))
    state = requests.groupBy("client_id").agg(F.max_by("state", "seq").alias("state"))
    base = state.join(F.broadcast(defaults), "state")  # a fixed table: states x areas
    return base.join(last, ["client_id", "area"], "left").select("client_id", "area", F.coalesce("own", "cost").alias("cost"))


def route(requests: DataFrame, kind: Column, size: Column, least: dict[str, int]) -> DataFrame:
    """`requests` with op (the type's name, null if unknown) and status: ok, unknown, unanswered, or short for a payload that is too small."""
    names = F.create_map(*(F.lit(x) for pair in REQUEST_TYPES.items() for x in pair))
    sizes = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    op = F.try_element_at(names, kind)
    status = F.when(op.isNull(), "unknown").when(op.isin(*UNANSWERED), "unanswered").when(size < F.coalesce(F.try_element_at(sizes, op), F.lit(0)), "short").otherwise("ok")
    return requests.withColumns({"op": op, "status": status})


def read_config(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) for each configuration key: the last line `key=value` that has a value of the key's type, else the default.

    Keys start with their type: b, f, i or s. Unknown keys and malformed values are passed over.
    """
    spark = lines.sparkSession
    cut = F.split(F.col(column), "=", 2)
    read = lines.select(F.monotonically_increasing_id().alias("line"), F.trim(cut[0]).alias("key"), F.trim(F.try_element_at(cut, F.lit(2))).alias("value")).filter("value IS NOT NULL")
    kind = F.substring("key", 1, 1)
    valid = F.when(kind == "f", F.expr("try_cast(value AS double)").isNotNull()).when(kind.isin("b", "i"), F.expr("try_cast(value AS int)").isNotNull()).otherwise(True)
    last = read.filter(valid).groupBy("key").agg(F.max_by("value", "line").alias("value"))
    known = spark.createDataFrame(list(DEFAULTS.items()), "key string, default string")
    return known.join(last, "key", "left").select("key", F.coalesce("value", "default").alias("value"))


def clamp_config(config: DataFrame) -> DataFrame:
    """Values out of range moved into it: at least two curve points, no negative faction cost."""
    number = F.expr("try_cast(value AS double)")
    low = F.col("key").isin("iBezierCurvePoints", "iCatmullRomSplinePoints") & (number < 2)
    negative = (F.col("key") == "fFactionDangerCost") & (number < 0)
    return config.select("key", F.when(low, "2").when(negative, "0").otherwise(F.col("value")).alias("value"))


def config_errors(config: DataFrame) -> DataFrame:
    """(key, value) of the settings that a server can't run with."""
    number = F.expr("try_cast(value AS double)")
    wide = F.col("key").isin("iPort", "iMaxSearchNodes") & ~number.between(1, 65535)
    positive = F.col("key").isin("iMaxPointPath", "iMaxPolyPath") & (number <= 0)
    return config.filter(wide | positive)


def config_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULTS.items()), "key string, value string")


def translate_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, hash) from lines `key<tab>hash`: trimmed, keys without regard to case, the last line of a key wins."""
    cut = F.split(F.col(column), "\t", 2)
    rows = lines.select(F.monotonically_increasing_id().alias("line"), F.lower(F.trim(cut[0])).alias("key"), F.trim(F.try_element_at(cut, F.lit(2))).alias("hash"))
    return rows.filter("hash IS NOT NULL").groupBy("key").agg(F.max_by("hash", "line").alias("hash"))


def first_found(wanted: DataFrame, names: list[Column], known: DataFrame) -> DataFrame:
    """`wanted` with hash, that of the first of `names` which the table (key, hash) has; null if none."""
    key = [c for c in wanted.columns]
    tried = wanted.select(*key, F.posexplode(F.array(*(F.lower(n) for n in names))).alias("n", "key"))
    found = tried.join(known, "key").groupBy(*key).agg(F.min_by("hash", "n").alias("hash"))
    return wanted.join(found, key, "left")


def snapped_heights(points: DataFrame, found: DataFrame, fallback: float = 200.0) -> DataFrame:
    """(request_id, z): the height found for each point (request_id, z), else its own, else the fallback."""
    return points.join(found.select("request_id", F.col("y").alias("found")), "request_id", "left").select("request_id", F.coalesce("found", "z", F.lit(fallback)).alias("z"))
