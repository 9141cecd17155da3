"""Trees of bounding boxes, one for each tile, as tables that are built and searched by level.

Boxes are whole numbers: coordinates over a tile's origin in steps of a cell, cut down for least and up for greatest, so that a tree's box never misses what the box had. A node is a row (tile, node,
escape, ref, and the bounds): nodes are numbered as a walk from the root meets them, left side first; escape is the number of nodes in the subtree, so that node + escape is where
a walk goes on that leaves the subtree out; ref is the polygon of a leaf. A tree over n boxes has 2 n - 1 nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut

#: Tasks that a tile's queries are dealt to.
SHARES = 4

BOUNDS = [f"{n}{v}" for n in ("min", "max") for v in "xyz"]


def quantised_boxes(boxes: DataFrame, step: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """`boxes` with their bounds in whole steps from the origin."""
    low = {f"min{v}": F.floor((F.col(f"min{v}") - o) / step).cast("int") for v, o in zip("xyz", origin, strict=True)}
    return boxes.withColumns({**low, **{f"max{v}": F.ceil((F.col(f"max{v}") - o) / step).cast("int") for v, o in zip("xyz", origin, strict=True)}})


def build_trees(boxes: DataFrame) -> DataFrame:
    """The nodes of the trees over `boxes` (tile, ref, and whole bounds). A node's boxes are ordered by their least coordinate on the axis on which they reach furthest together (x, then z, then y, where
    equal), then by ref, and cut in halves, the left one the smaller. Each round cuts all nodes of a level; a tile's boxes, of which a mesh has a bounded number, meet in one window."""
    at = cut(boxes.select("tile", F.lit(0).alias("node"), F.count("*").over(Window.partitionBy("tile")).cast("int").alias("n"), "ref", *BOUNDS))
    parts = []
    while True:
        parts.append(at.filter("n = 1").select("tile", "node", F.lit(1).alias("escape"), "ref", *BOUNDS))
        group = Window.partitionBy("tile", "node")
        open_nodes = at.filter("n > 1").withColumns({f"all_{b}": (F.min if b.startswith("min") else F.max)(b).over(group) for b in BOUNDS})
        reach = {v: F.col(f"all_max{v}") - F.col(f"all_min{v}") for v in "xyz"}
        key = F.when((reach["x"] >= reach["z"]) & (reach["x"] >= reach["y"]), F.col("minx")).when(reach["z"] >= reach["y"], F.col("minz")).otherwise(F.col("miny"))
        place = F.row_number().over(group.orderBy("key", "ref"))
        left = F.floor(F.col("n") / 2).cast("int")
        cuts = cut(open_nodes.withColumn("key", key).withColumn("place", place))
        if cuts.isEmpty():
            break
        parts.append(cuts.filter("place = 1").select("tile", "node", (2 * F.col("n") - 1).alias("escape"), F.lit(None).cast(dict(boxes.dtypes)["ref"]).alias("ref"), *(F.col(f"all_{b}").alias(b) for b in BOUNDS)))
        first = F.col("place") <= left
        at = cuts.select("tile", F.when(first, F.col("node") + 1).otherwise(F.col("node") + 2 * left).alias("node"), F.when(first, left).otherwise(F.col("n") - left).alias("n"), "ref", *BOUNDS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _walk(trees: dict[str, np.ndarray], root: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the query, place of the leaf) of the leaves that queries (columns of `asked`) meet, all queries a level further down at once, and only into nodes they meet. Trees
    lie one after another, in the order of their nodes; a query's begins at its `root`."""
    found = []
    query, node = np.arange(len(root)), root
    while len(query):
        box, mine = trees["bounds"][:, node], asked[:, query]
        met = np.flatnonzero((mine[:3] <= box[3:]).all(axis=0) & (mine[3:] >= box[:3]).all(axis=0))
        query, node = query[met], node[met]
        escape = trees["escape"][node]
        leaf = escape == 1
        found.append((query[leaf], node[leaf]))
        query, node, escape = query[~leaf], node[~leaf], escape[~leaf]
        # a node of n boxes has 2 n - 1 nodes below and at it; its left half has n // 2 boxes
        query, node = np.concatenate([query, query]), np.concatenate([node + 1, node + 2 * ((escape + 1) // 4)])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (query, node)


def search_trees(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """(request_id, ref): the leaves whose box meets that of each query (request_id, tile, and whole bounds), touching ones included. Queries and trees are shuffled once, by tile; a task reads each tile's nodes,
    of which a mesh has a bounded number, and then its queries, which it takes down the tree as they come. A tile's queries are dealt to SHARES tasks, each with the tree."""
    share = F.pmod(F.xxhash64("request_id"), F.lit(SHARES)).cast("int")
    numbers = [F.col(b).cast("int").alias(b) for b in BOUNDS]
    asked, ref = dict(queries.dtypes)["request_id"], dict(trees.dtypes)["ref"]
    nodes = trees.select("tile", F.explode(F.array(*map(F.lit, range(SHARES)))).alias("share"), "node", "escape", "ref", F.lit(None).cast(asked).alias("request_id"), *numbers)
    both = nodes.unionByName(queries.select("tile", share.alias("share"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("escape"), F.lit(None).cast(ref).alias("ref"), "request_id", *numbers))

    def run(batches):
        kept = None  # the nodes of the last tile so far
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if kept is not None:
                table = pa.concat_tables([kept, table])
            table = table.combine_chunks()
            is_node = table["escape"].is_valid().to_numpy()
            tile = table["tile"].to_numpy()
            share = table["share"].to_numpy()
            first = np.ones(len(tile), bool)
            first[1:] = (tile[1:] != tile[:-1]) | (share[1:] != share[:-1])
            begins = np.flatnonzero(first)[np.cumsum(first) - 1]
            place = np.flatnonzero(~is_node & is_node[begins])  # a query of a tile without a tree meets nothing
            bounds = np.stack([table[b].to_numpy() for b in BOUNDS])
            found = _walk({"bounds": bounds, "escape": table["escape"].fill_null(0).to_numpy()}, begins[place], bounds[:, place])
            yield pa.RecordBatch.from_arrays([table["request_id"].take(pa.array(place[found[0]])).combine_chunks(), table["ref"].take(pa.array(found[1])).combine_chunks()], names=["request_id", "ref"])
            rest = np.flatnonzero(is_node & (np.arange(len(tile)) >= begins[-1]))
            kept = table.take(pa.array(rest))

    # a tile's nodes come in their order, before its queries
    sorted_rows = both.repartition("tile", "share").sortWithinPartitions("tile", "share", F.col("node").asc_nulls_last())
    return sorted_rows.mapInArrow(run, f"request_id {asked}, ref {ref}")
