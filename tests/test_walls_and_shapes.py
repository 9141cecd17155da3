"""Wall segments, rays through links, reachable walls, shapes and neighbourhoods against plain versions on small meshes and odd inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import around as N
from wayfold.operators import search as S
from wayfold.operators import walls as L

EDGE = "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double, nei long"
LINK = "from_ref long, to_ref long, edge int, bmin int, bmax int"


def square(ref, x, z, y=0.0, size=1.0):
    c = [(x, z), (x, z + size), (x + size, z + size), (x + size, z)]
    return [(ref, i, float(c[i][0]), float(y), float(c[i][1]), float(c[(i + 1) % 4][0]), float(y), float(c[(i + 1) % 4][1]), -1) for i in range(4)]


def row_of_squares(n, y=0.0, first=0):
    edges = [e for k in range(n) for e in square(first + k, k, 0, y)]
    links = [(first + k, first + k + 1, 2, 0, 255) for k in range(n - 1)] + [(first + k + 1, first + k, 0, 0, 255) for k in range(n - 1)]
    return edges, links


def tables(spark, edges, links, blocked=()):
    refs = sorted({e[0] for e in edges} - set(blocked))
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(links, LINK), spark.createDataFrame([(r, 1.0) for r in refs], "ref long, cost double")


def test_gaps_of_merged_ranges(spark):
    r = random.Random(3)
    edges = square(1, 0, 0) + square(2, 5, 5)
    links = [(1, 9, 0, a, a + r.randint(0, 80)) for a in (r.randint(0, 200) for _ in range(6))] + [(1, 9, 1, 0, 255), (1, 9, 2, 10, 20), (1, 8, 2, 20, 40), (1, 7, 2, 15, 30), (2, 9, 3, 5, 5)]
    links = [(*x[:4], min(x[4], 255)) for x in links]
    got = {(x.ref, x.edge, x.bmin, x.bmax) for x in L.wall_segments(spark.createDataFrame(edges, EDGE), spark.createDataFrame(links, LINK)).collect()}
    want = set()
    for ref, edge in {e[:2] for e in edges}:
        free = [not any(a == ref and c == edge and lo <= i < hi for a, _, c, lo, hi in links) for i in range(255)]
        at = 0
        while at < 255:
            end = at
            while end < 255 and free[end]:
                end += 1
            if end > at:
                want.add((ref, edge, at, end))
            at = end + 1
    assert got == want and (1, 2, 0, 10) in got and (1, 2, 40, 255) in got


def test_rays_end_at_closed_parts_and_pass_open_ones(spark):
    edges, links = row_of_squares(4)
    links = [x for x in links if x[:2] not in ((1, 2), (2, 1))] + [(1, 2, 2, 0, 127), (2, 1, 0, 128, 255)]
    upper, above = row_of_squares(4, 9.0, 100)
    rays = [(1, 0, 0.5, 0.0, 0.8, 3.5, 0.0, 0.8), (2, 0, 0.5, 0.0, 0.2, 3.5, 0.0, 0.2), (3, 100, 0.5, 9.0, 0.2, 3.5, 9.0, 0.2), (4, 0, 0.5, 0.0, 0.5, 0.5, 0.0, 0.5), (5, 0, 7.0, 0.0, 7.0, 8.0, 0.0, 8.0), (6, 77, 0.5, 0.0, 0.5, 1.5, 0.0, 0.5)]
    schema = "request_id long, start_ref long, sx double, sy double, sz double, gx double, gy double, gz double"
    e, k, c = tables(spark, edges + upper, links + above)
    got = {x.request_id: x for x in L.walk_rays(spark.createDataFrame(rays, schema), L.faces(e, k, c)).collect()}
    assert got[1].clear and got[1].polys == 4 and got[1].cost == pytest.approx(3.0) and got[1].ref == 3
    assert not got[2].clear and got[2].t == pytest.approx(1.5 / 3) and (got[2].nx, got[2].nz) == (-1.0, 0.0) and got[2].ref == 1
    assert got[3].clear and got[3].ref == 103  # the wall below is of another floor
    assert got[4].clear and got[4].cost == 0 and got[5].t == 0 and not got[5].clear and got[5].nx is None and 6 not in got
    closed = L.walk_rays(spark.createDataFrame(rays, schema), L.faces(e, k, c.filter("ref <> 1"))).filter("request_id = 1").first()
    assert closed.t == pytest.approx(0.5 / 3) and closed.ref == 0
    assert L.walk_rays(spark.createDataFrame([], schema), L.faces(e, k, c)).collect() == []


def test_the_nearest_wall_is_one_that_can_be_reached(spark):
    # a corridor of three cells; the middle of the last is nearer to the wall of a cell that lies beside it and isn't linked
    edges, links = row_of_squares(3)
    edges += square(50, 2.2, 0.3, 0.0, 0.1)
    points = [(1, 1, 1.5, 0.4), (2, 2, 2.25, 0.35)]
    e, k, c = tables(spark, edges, links)
    got = {x.request_id: x for x in L.reachable_wall(spark.createDataFrame(points, "request_id long, ref long, x double, z double"), L.faces(e, k, c), 5.0).collect()}
    assert got[1].distance == pytest.approx(0.4) and got[1].edge == 3 and got[2].distance == pytest.approx(0.35) and got[2].ref == 2
    assert L.reachable_wall(spark.createDataFrame(points, "request_id long, ref long, x double, z double"), L.faces(e, k, c), 0.2).collect() == []


def plain_walls(points, edges, links, radius):
    """The first wall of each point by entering the polygon of least entry over and over."""
    linked = {(a, e) for a, _, e, *_ in links}

    def far(edge, x, z):
        ax, az, bx, bz = edge[2], edge[4], edge[5], edge[7]
        t = min(max(((x - ax) * (bx - ax) + (z - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2), 0.0), 1.0)
        return math.hypot(ax + t * (bx - ax) - x, az + t * (bz - az) - z)

    out = {}
    for request, ref, x, z in points:
        entered, todo, met = {}, [(0.0, ref)], []
        while todo:
            at, here = min(todo)
            todo.remove((at, here))
            if here in entered:
                continue
            entered[here] = at
            for e in (e for e in edges if e[0] == here and far(e, x, z) <= radius):
                if (here, e[1]) in linked:
                    todo += [(max(at, far(e, x, z)), b) for a, b, k, *_ in links if (a, k) == (here, e[1])]
                else:
                    met.append((max(at, far(e, x, z)), far(e, x, z), here, e[1]))
        if met:
            out[request] = min(met)
    return out


def test_circles_of_many_tiles_and_crowded_ones_spread_in_their_tasks(spark, monkeypatch):
    r = random.Random(5)
    n, radius = 12, 2.3
    cells = [(i, j) for i in range(n) for j in range(n)]
    edges = [e for i, j in cells for e in square(i * n + j, i * 3 - 20, j * 3 - 17, size=3)]
    links = [(i * n + j, (i + di) * n + j + dj, k, 0, 255) for i, j in cells for k, (di, dj) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1))) if 0 <= i + di < n and 0 <= j + dj < n and r.random() < 0.8]
    links += [(5, 140, 1, 0, 255), (140, 5, 3, 0, 255)]  # a way to the other end
    points = [(k, i * n + j, i * 3 - 20 + r.uniform(0, 3), j * 3 - 17 + r.uniform(0, 3)) for k, (i, j) in enumerate(r.choice(cells) for _ in range(150))]
    points += [(150, None, 0.0, 0.0), (151, 5, None, 0.0), (152, 5, float("nan"), 0.0), (153, 5, 0.0, math.inf), (154, 999, 0.0, 0.0)]
    monkeypatch.setattr(L, "CROWD", 20, raising=False)
    written, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: written.append(df) or cut(df))
    e, k, c = tables(spark, edges, links)
    got = {x.request_id: (x.ref, x.edge, x.distance) for x in L.reachable_wall(spark.createDataFrame(points, "request_id long, ref long, x double, z double"), L.faces(e, k, c), radius).collect()}
    want = plain_walls(points[:150], edges, links, radius)
    assert {q: (x[2], x[3], pytest.approx(x[1])) for q, x in want.items()} == got and 100 < len(got) < 150
    assert len(written) == 3  # polygons, points and crowded tiles; no table for each round


def convex(r, n):
    angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    x, z, size = r.uniform(0, 30), r.uniform(0, 30), r.uniform(1, 6)
    points = [(x + size * math.cos(a), z + size * math.sin(a)) for a in angles]
    return points if r.random() < 0.5 else points[::-1]


def inside(p, shape):
    turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(shape, shape[1:] + shape[:1], strict=True)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def crosses(a, b, c, d):
    turn = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def plain_overlap(p, q):
    sides = lambda s: list(zip(s, s[1:] + s[:1], strict=True))
    return any(inside(x, q) for x in p) or any(inside(x, p) for x in q) or any(crosses(*a, *b) for a in sides(p) for b in sides(q))


def shapes_of(spark, shapes):
    return spark.createDataFrame([(i, [{"x": x, "z": z} for x, z in s]) for i, s in enumerate(shapes)], "id long, corners array<struct<x:double,z:double>>")


@pytest.mark.parametrize("bucket", [2.0, 100.0])
def test_overlaps_match_plain_geometry(spark, bucket):
    r = random.Random(8)
    left, right = [convex(r, r.randint(3, 6)) for _ in range(60)], [convex(r, r.randint(3, 6)) for _ in range(60)]
    got = [tuple(x) for x in N.overlapping(shapes_of(spark, left), shapes_of(spark, right), bucket).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if plain_overlap(p, q)} and len(got) > 50


def test_segments_in_shapes_match_plain_geometry(spark):
    r = random.Random(9)
    shapes = [convex(r, r.randint(3, 6)) for _ in range(300)]
    ends = [tuple((r.uniform(0, 30), r.uniform(0, 30)) for _ in range(2)) for _ in shapes]
    rows = [(i, [{"x": x, "z": z} for x, z in s], *a, *b) for i, (s, (a, b)) in enumerate(zip(shapes, ends, strict=True))]
    df = spark.createDataFrame(rows, "id long, corners array<struct<x:double,z:double>>, ax double, az double, bx double, bz double")
    got = {x.id: x.m for x in df.withColumn("sides", N.sides_of(F.col("corners"))).select("id", N.segment_meets_sides(*(F.col(c) for c in ("ax", "az", "bx", "bz", "sides"))).alias("m")).collect()}
    for i, (s, (a, b)) in enumerate(zip(shapes, ends, strict=True)):
        assert got[i] == (inside(a, s) or inside(b, s) or any(crosses(a, b, *side) for side in zip(s, s[1:] + s[:1], strict=True)))


def test_neighbourhoods_have_no_overlap(spark):
    # two cells beside the first, over each other: the smaller ref is taken; what the other leads to isn't reached through it
    edges = square(1, 0, 0) + square(2, 1, 0) + square(3, 1, 0, 5.0) + square(4, 2, 0, 5.0) + square(5, 2, 0)
    links = [(1, 3, 2, 0, 255), (3, 1, 0, 0, 255), (1, 2, 2, 0, 255), (2, 1, 0, 0, 255), (3, 4, 2, 0, 255), (2, 5, 2, 0, 255), (5, 2, 0, 0, 255)]
    e, k, c = tables(spark, edges, links)
    points = spark.createDataFrame([(1, 1, 0.5, 0.5), (2, 4, 2.5, 0.5)], "request_id long, ref long, x double, z double")
    got = sorted(tuple(x) for x in N.local_neighbourhood(points, L.faces(e, k, c), 5.0).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 5, 2), (2, 4, 0)]


def test_polygons_around_follow_the_cheapest_way(spark):
    edges, links = row_of_squares(5)
    e, k, c = tables(spark, edges, links, blocked=[4])
    c = c.withColumn("cost", F.when(F.col("ref") == 1, 3.0).otherwise(F.col("cost")))
    asked = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 10.0), (2, 0, 0.5, 0.0, 0.5, 0.6), (3, 4, 4.5, 0.0, 0.5, 9.0)], "request_id long, start_ref long, sx double, sy double, sz double, radius double")
    got = sorted(tuple(x) for x in N.polygons_around(asked, S.portals(k, e), c, N.segment_in_circle, ["sx", "sz", "radius"]).collect())
    assert got == [(1, 0, 0.0), (1, 1, 0.5), (1, 2, 3.5), (1, 3, 4.5), (2, 0, 0.0), (2, 1, 0.5)]


def test_routes_that_can_t_be_finished_end_near_their_goal(spark):
    edges, links = row_of_squares(5)
    links = [x for x in links if x[:2] not in ((2, 3), (3, 2))]
    e, k, c = tables(spark, edges, links)
    rows = [(1, 0, 0.5, 0.0, 0.5, 4, 4.5, 0.0, 0.5), (2, 0, 0.5, 0.0, 0.5, 2, 2.5, 0.0, 0.5), (3, 3, 3.5, 0.0, 0.5, 0, 0.5, 0.0, 0.2), (4, 1, 1.5, 0.0, 0.5, 1, 1.7, 0.0, 0.5)]
    asked = spark.createDataFrame(rows, "request_id long, start_ref long, sx double, sy double, sz double, goal_ref long, gx double, gy double, gz double")
    found = S.routes(asked, S.portals(k, e), c, partial=True)
    ends = {x.request_id: x for x in S.with_ends(asked, found, e).collect()}
    assert [(ends[i].partial, ends[i].end_ref, ends[i].gx) for i in (1, 2, 3, 4)] == [(True, 2, 3.0), (False, 2, 2.5), (True, 3, 3.0), (False, 1, 1.7)]
    paths = S.pull_tight(S.with_ends(asked, found, e), found).collect()
    assert max(p.x for p in paths if p.path_id == 1) == 3.0 and ends[3].gz == 0.2
    assert {x.request_id for x in S.routes(asked, S.portals(k, e), c).collect()} == {2, 4}


def test_nearest_of_many_polygons_in_one_bucket(spark):
    """More polygons in a bucket than a row packs."""
    from wayfold.operators import search

    n = 3 * search.PACKED
    corners = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))
    rows = [(i, e, i % 12 * 1.0 + a, 0.25 * (i // 12), float(b), i % 12 * 1.0 + c, 0.25 * (i // 12), float(d)) for i in range(n) for e, (a, b, c, d) in enumerate(corners)]
    edges = spark.createDataFrame(rows, "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double")
    points = [(k, k * 0.37 - 1.1, k % 9 * 0.3, k % 5 * 0.6 - 0.7) for k in range(40)] + [(99, 500.0, 0.0, 0.0), (100, None, 0.0, 0.0)]
    found = search.nearest(spark.createDataFrame(points, "request_id long, x double, y double, z double"), edges, 0.2)

    def plain(x, y, z):
        best = []
        for i in range(n):
            c, h = i % 12, 0.25 * (i // 12)
            if not (c <= x + 6 and c + 1 >= x - 6 and 0 <= z + 6 and 1 >= z - 6 and y - 6 <= h <= y + 6):
                continue
            over = c <= x < c + 1 and 0 <= z < 1
            px, pz = min(max(x, c), c + 1), min(max(z, 0), 1)
            d = max(abs(h - y) - 0.2, 0) ** 2 if over else (px - x) ** 2 + (h - y) ** 2 + (pz - z) ** 2
            best.append((round(d, 9), i))
        return min(best)[1] if best else None

    expected = {k: plain(x, y, z) for k, x, y, z in points if x is not None}
    assert {r.request_id: r.ref for r in found.collect()} == {k: v for k, v in expected.items() if v is not None}


def test_equal_journeys_and_equal_connections_are_worked_once(spark):
    from wayfold.operators import offmesh
    from wayfold.plans import requests

    asked = spark.createDataFrame([(i, i % 3 * 1.0, 0.5, 0.5, 2.0, 0.5, 0.5) for i in range(30)], "request_id long, sx double, sy double, sz double, gx double, gy double, gz double")
    different, members = requests.same_journeys(asked)
    assert different.count() == 3 and members.count() == 30
    paths = different.selectExpr("request_id AS path_id", "0 AS seq", "sx AS x", "sy AS y", "sz AS z")
    assert {r.path_id: r.x for r in requests.of_members(members, paths).collect()} == {i: i % 3 * 1.0 for i in range(30)}
    row = [0.7, True, 2.0, 5, 6, 0.0, 0.5, 0.0, 1.0, 0.5, 1.0]
    snapped = spark.createDataFrame([(i, *row) for i in range(4)] + [(9, *row[:2], 3.0, *row[3:])], "id long, radius double, both boolean, cost double, start_ref long, end_ref long, sx double, sy double, sz double, ex double, ey double, ez double")
    assert sorted(r.id for r in offmesh.without_copies(snapped).collect()) == [0, 9]


def test_tables_of_a_large_mesh_are_not_broadcast(spark):
    """Portals and links are joined without a table of all polygons going through the driver."""
    from wayfold.operators import search
    from wayfold.plans import world

    data = "/root/testdata/sf0.001"
    for found in (world.deck_links(spark, data), search.portals(world.deck_links(spark, data), world.deck_edges(spark, data))):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_overlaps_of_shapes_are_tested_side_by_side():
    import pyarrow as pa

    from wayfold.operators import around

    square, corner = [(0, 0), (0, 2), (2, 2), (2, 0)], [(1, 1), (4, 1), (4, 4)]
    shapes = [(square, corner), (square, [(2, 0), (2, 2), (4, 1)]), (corner, square), (square, [(5, 5), (5, 6), (6, 5)]), (square, [(1, 1), (None, 1), (4, 4)]), (None, square), ([], square)]
    of = lambda k: pa.array([s[k] and [{"x": x, "z": z} for x, z in s[k]] if s[k] != [] else [] for s in shapes], pa.list_(pa.struct({"x": pa.float64(), "z": pa.float64()})))
    assert around._overlap(of(0), of(1)).to_pylist() == [True, False, True, False, None, None, None]
