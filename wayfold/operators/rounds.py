"""Iteration over tables: cut lineage between rounds, and shortest ways by relaxation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` written below the folder that spark.checkpoint.dir names, or setCheckpointDir() was given (on one machine, a temporary one), and read again: worked out
    once, kept where a lost executor can't take it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wayfold-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/wayfold/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def relax(starts: DataFrame, arcs: DataFrame, max_rounds: int = 10_000, max_cost: float | None = None) -> DataFrame:
    """(source, node, cost, parent): the cheapest way from each source to each node it reaches; of equal ways that with the smallest parent.

    `starts` has (source, node, cost), `arcs` (node, to_node, weight >= 0). A round joins the nodes that became cheaper to the arcs out of
    them and keeps the minimum for each node, so it moves the frontier alone and sums before it shuffles. Sources are
    independent keys: many are worked at once. `max_cost` leaves out what is farther.
    """
    arcs = cut(arcs)  # each round reads them; what they come from is worked out once
    best = cut(starts.groupBy("source", "node").agg(F.min("cost").alias("cost")).withColumn("parent", F.lit(None).cast(dict(starts.dtypes)["node"])))
    frontier = best
    for _ in range(max_rounds):
        offered = frontier.join(arcs, "node").select("source", F.col("to_node").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("node").alias("parent"))
        if max_cost is not None:
            offered = offered.filter(F.col("cost") <= max_cost)
        offered = offered.groupBy("source", "node").agg(F.min(F.struct("cost", "parent")).alias("new"))
        merged = best.join(offered, ["source", "node"], "full_outer")
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new.cost") < F.col("cost")))
        merged = merged.select("source", "node", F.when(better, F.col("new.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("new.parent")).otherwise(F.col("parent")).alias("parent"), better.alias("better"))
        merged = cut(merged)
        best, frontier = merged.drop("better"), merged.filter("better").drop("better")
        if frontier.isEmpty():
            break
    return best


def trace(best: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, goal, step, node): the way back from each goal (source, goal) to its source, step 0 at the goal."""
    at = cut(goals.select("source", "goal").distinct().select("source", "goal", F.col("goal").alias("node"), F.lit(0).alias("step")))
    parts = [at]
    while not at.isEmpty():
        back = at.join(best.select("source", "node", "parent"), ["source", "node"]).filter("parent IS NOT NULL")
        at = cut(back.select("source", "goal", F.col("parent").alias("node"), (F.col("step") + 1).alias("step")))
        parts.append(at)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
