"""Rounds read what was worked out before them; they don't work out their tables anew."""

import pytest
from pyspark.sql import functions as F

from wayfold.operators import around as N
from wayfold.operators import rounds, walls


def counted(spark, df):
    """`df`, and how often its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def row_of_cells(spark, n):
    """Unit squares side by side along x."""
    cells = [(r, e, a, b) for r in range(n) for e, (a, b) in enumerate((((r, 0), (r, 1)), ((r, 1), (r + 1, 1)), ((r + 1, 1), (r + 1, 0)), ((r + 1, 0), (r, 0))))]
    edges = spark.createDataFrame([(r, e, float(a[0]), 0.0, float(a[1]), float(b[0]), 0.0, float(b[1])) for r, e, a, b in cells], "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double")
    links = [(r, r + d, e) for r in range(n) for d, e in ((-1, 0), (1, 2)) if 0 <= r + d < n]
    return walls.faces(edges, spark.createDataFrame(links, "from_ref long, to_ref long, edge int"), spark.createDataFrame([(r, 1.0) for r in range(n)], "ref long, cost double"))


@pytest.mark.parametrize("name", ["reachable_wall", "walk_rays", "local_neighbourhood"])
def test_faces_are_worked_out_once(spark, name):
    faces, seen = counted(spark, row_of_cells(spark, 5))
    points = spark.createDataFrame([(1, 0, 0.5, 0.4)], "request_id long, ref long, x double, z double")
    if name == "reachable_wall":
        rows = [tuple(r) for r in walls.reachable_wall(points, faces, 3.0).collect()]
        assert rows == [(1, 0.4, 0, 3)]
    elif name == "walk_rays":
        rays = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 4.5, 0.0, 0.5)], "request_id long, start_ref long, sx double, sy double, sz double, gx double, gy double, gz double")
        assert [(r.clear, r.polys, r.ref) for r in walls.walk_rays(rays, faces).collect()] == [(True, 5, 4)]
    else:
        rows = {(r.ref, r.ring) for r in N.local_neighbourhood(points, faces, 2.6).collect()}
        assert rows == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert seen.value == 5


def test_wall_of_an_entered_polygon_counts_from_its_entry(spark):
    found = walls.reachable_wall(spark.createDataFrame([(1, 2, 2.5, 0.5), (2, 0, 0.9, 0.5)], "request_id long, ref long, x double, z double"), row_of_cells(spark, 5), 0.7)
    assert sorted((r.request_id, r.distance, r.ref, r.edge) for r in found.collect()) == [(1, 0.5, 2, 1), (2, 0.5, 0, 1)]


def test_arcs_are_worked_out_once(spark):
    arcs, seen = counted(spark, spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "node long, to_node long, weight double"))
    best = rounds.relax(spark.createDataFrame([(0, 0, 0.0)], "source int, node long, cost double"), arcs)
    assert sorted((r.node, r.cost) for r in best.select("node", F.col("cost")).collect()) == [(i, float(i)) for i in range(5)]
    assert seen.value == 4


def test_pairs_of_one_border_are_dealt_to_tasks(spark):
    from wayfold.operators.meshes import border_links

    rows = [(2 * k + s, 0, s, 0, -4 if s == 0 else -2, 10.0, 0.0, k * 0.5, 10.0, 0.0, k * 0.5 + 1) for k in range(40) for s in (0, 1)]
    edges = spark.createDataFrame(rows, "ref long, edge int, tile_x int, tile_y int, nei int, ax double, ay double, az double, bx double, by double, bz double")
    found = border_links(edges, 1.2)
    assert len(found.withColumn("task", F.spark_partition_id()).select("task").distinct().collect()) > 4
    want = {(2 * a + s, 2 * b + 1 - s) for a in range(40) for b in range(40) for s in (0, 1) if abs(a - b) < 2}
    got = [(r.from_ref, r.to_ref) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
