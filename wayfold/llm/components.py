"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that is reachable.

    Each round points every node to its smallest neighbour, shortens the pointers, and replaces edges by edges between
    roots; pairs within one root go. Rounds are written to the shared folder. No edges give no rows; loops and repeats do
    no harm. All state is in tables: nothing goes to the driver but whether edges are left.
    """
    edges = landed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        point = landed(_shorten(_shorten(point)), "pointers")
        roots = point if roots is None else _extend(roots, point)
        roots = landed(roots, "roots")
        left = edges.join(point.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(point.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        edges = landed(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _shorten(point: DataFrame) -> DataFrame:
    """Pointers to where the pointed-to node points."""
    on = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return point.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _extend(roots: DataFrame, point: DataFrame) -> DataFrame:
    """Earlier roots, moved to where the new pointers lead. Pointers have earlier roots only, so no node is new."""
    on = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return roots.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
