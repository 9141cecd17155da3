"""Operators against hand-worked values and plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import areas as A
from wayfold.functions import geometry as G
from wayfold.operators import columns, meshes, paths, regions, search, session, voxels
from wayfold.operators.rounds import relax, trace

PATH = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0), (8.0, 4.0, 4.0)]


def polyline(spark, points, path_id=1):
    return spark.createDataFrame([(path_id, i, *p) for i, p in enumerate(points)], "path_id long, seq int, x double, y double, z double")


def listed(df):
    return [(r.x, r.y, r.z) for r in df.orderBy("path_id", "seq").collect()]


def near(a, b, tolerance=1e-4):
    return len(a) == len(b) and all(abs(p - q) <= tolerance for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- functions


def test_frames_and_tiles(spark):
    point = G.vector(1, 2, 3)
    mesh = value(spark, G.to_mesh(point))
    assert (mesh.x, mesh.y, mesh.z) == (2.0, 3.0, 1.0)
    back = value(spark, G.to_game(G.to_mesh(point)))
    assert (back.x, back.y, back.z) == (1.0, 2.0, 3.0)
    assert [value(spark, G.world_to_tile(F.lit(v))) for v in (0.0, -1.0, 17000.0)] == [32, 32, 0]
    assert value(spark, G.tile_to_world(F.lit(31))) == pytest.approx(G.TILE_SIZE)


def test_scalar_geometry(spark):
    lit = F.lit
    assert value(spark, G.cross_2d(*map(lit, (0.0, 0.0, 0.0, 2.0, 2.0, 0.0)))) == 4.0
    assert value(spark, G.segment_distance_sq(*map(lit, (1.0, 1.0, 0.0, 0.0, 2.0, 0.0)))) == 1.0
    assert value(spark, G.segment_distance_sq(*map(lit, (3.0, 0.0, 1.0, 0.0, 1.0, 0.0)))) == 4.0
    assert value(spark, G.passes(lit(12), lit(4), lit(2))) and not value(spark, G.passes(lit(12), lit(4), lit(8)))
    corners = [tuple(map(lit, c)) for c in ((0.0, 1.0, 0.0), (0.0, 1.0, 2.0), (2.0, 3.0, 0.0))]
    assert value(spark, G.triangle_height(lit(1.0), lit(0.5), *corners)) == pytest.approx(2.0)
    assert value(spark, G.triangle_height(lit(2.0), lit(2.0), *corners)) is None
    turned = value(spark, G.rotate_zyx(*map(lit, (1.0, 0.0, 0.0, 0.0, 0.0, math.pi / 2))))
    assert (turned.x, turned.y) == (pytest.approx(0), pytest.approx(1))


def test_area_table():
    rows = A.area_rows()
    assert len(rows) == 28 and rows[4][1:4] == ("road", 0, 12) and rows[18] == (18, "water", 2, 34, 1.6) and rows[27][1:4] == ("slime", 2, 33)


def test_default_costs(spark):
    cost = {(r.state, r.area): r.cost for r in A.default_costs(spark).collect()}
    assert cost["normal", 4] == 0.75 and cost["alliance", 3] == 3.0 and cost["alliance", 2] == 1.0 and cost["horde", 17] == pytest.approx(4.8) and cost["horde", 23] == 4.0 and cost["dead", 22] == 1.0


# --- paths


def test_smoothing_goldens(spark):
    p = polyline(spark, PATH)
    assert near(listed(paths.chaikin(p)), [(0, 0, 0), (1, 0, 0), (3, 0, 0), (4, 1, 0), (4, 3, 0), (5, 4, 1), (7, 4, 3), (8, 4, 4)])
    assert near(listed(paths.bezier(p)), [(0, 0, 0), (1.4927, 0.2216, 0.0117), (2.6356, 0.7930, 0.0933), (3.5685, 1.5743, 0.3149), (4.4315, 2.4257, 0.7464), (5.3644, 3.2070, 1.4577), (6.5073, 3.7784, 2.5190), (8, 4, 4)])
    assert near(listed(paths.catmull_rom(p)), [(0, 0, 0), (4, 0, 0), (4.2092, 0.8044, -0.0720), (4.0579, 1.9784, -0.1921), (3.8777, 3.1632, -0.2161)])
    assert listed(paths.catmull_rom(p, keep_last=True))[-1] == PATH[-1]
    assert listed(paths.bezier(polyline(spark, [*PATH, (9.0, 9.0, 9.0)]), keep_last=True))[-1] == (9.0, 9.0, 9.0)


def test_smoothing_needs_points(spark):
    one = polyline(spark, PATH[:1])
    assert listed(paths.chaikin(one)) == PATH[:1]
    flagged = lambda p, f: listed(paths.smooth(p, spark.createDataFrame([(1, f)], "path_id long, flags int")))
    two, four = polyline(spark, PATH[:2]), polyline(spark, PATH)
    assert flagged(two, 7) == PATH[:2] and len(flagged(four, 7)) == 8 and len(flagged(four, 6)) == 5 and len(flagged(four, 4)) == 8 and flagged(four, 0) == PATH
    assert len(listed(paths.smooth(four, spark.createDataFrame([(1, 1)], "path_id long, flags int"), 3))) == 3


def test_smoothed_points_are_numbered_densely(spark):
    rows = [(p, i, float(i * i % 7), float(p), float(i)) for p in range(8) for i in range(p)]
    points = spark.createDataFrame(rows, "path_id long, seq int, x double, y double, z double")
    flags = spark.createDataFrame([(p, p) for p in range(8)], "path_id long, flags int")
    got = {}
    for r in paths.smooth(points, flags).collect():
        got.setdefault(r.path_id, []).append(r.seq)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    # 0 points none; 1 and 2 too few; 3, 5 and 7 by Chaikin, 4 by Bezier, 6 by Catmull-Rom
    assert {p: len(v) for p, v in got.items()} == {1: 1, 2: 2, 3: 6, 4: 8, 5: 10, 6: 13, 7: 14}


def test_path_stats_and_legs(spark):
    r = paths.stats(polyline(spark, [(0.0, 0.0, 0.0), (3.0, 4.0, 0.0), (3.0, 4.0, 12.0)])).first()
    assert (r.points, r.length, r.min_x, r.max_z) == (3, 17.0, 0.0, 12.0)
    cut = listed(paths.split_legs(polyline(spark, [(0.0, 0.0, 0.0), (50.0, 0.0, 0.0), (51.0, 0.0, 0.0)]), 25.0))
    assert cut == [(0, 0, 0), (25, 0, 0), (50, 0, 0), (51, 0, 0)]


# --- columns


def spans(spark, rows):
    return spark.createDataFrame(rows, "x int, z int, smin int, smax int, area int")


def test_span_merge(spark):
    got = columns.coalesce_spans(spans(spark, [(0, 0, 0, 5, 1), (0, 0, 4, 9, 4), (0, 0, 9, 30, 2), (0, 0, 40, 41, 7), (1, 0, 3, 4, 0)])).orderBy("x", "layer").collect()
    assert [(r.x, r.layer, r.smin, r.smax, r.area) for r in got] == [(0, 0, 0, 30, 2), (0, 1, 40, 41, 7), (1, 0, 3, 4, 0)]
    assert columns.coalesce_spans(spans(spark, [(0, 0, 0, 5, 1), (0, 0, 4, 9, 4)])).first().area == 4
    same = columns.coalesce_spans(spans(spark, [(0, 0, 0, 1, a % 9) for a in range(300)] + [(0, 0, 3, 4, a % 7) for a in range(300)]).repartition(7)).orderBy("layer").collect()
    assert [(r.layer, r.smin, r.smax, r.area) for r in same] == [(0, 0, 1, 8), (1, 3, 4, 6)]


def test_column_filters(spark):
    low = columns.filter_low_obstacles(spans(spark, [(0, 0, 0, 10, 4), (0, 0, 12, 15, 0), (0, 0, 16, 18, 0)])).orderBy("smin").collect()
    assert [r.area for r in low] == [4, 4, 0]
    ceiling = columns.filter_low_ceilings(spans(spark, [(0, 0, 0, 10, 4), (0, 0, 15, 20, 4), (0, 0, 60, 61, 4)])).orderBy("smin").collect()
    assert [r.area for r in ceiling] == [0, 4, 4]


def test_ledges(spark):
    flat = [(x, z, 0, 10, 1) for x in range(5) for z in range(5)]
    got = {(r.x, r.z): r.area for r in columns.filter_ledges(spans(spark, flat), 5, 5).collect()}
    assert all((got[x, z] == 1) == (0 < x < 4 and 0 < z < 4) for x, z in got)  # the field's rim drops off
    pit = [s for s in flat if s[:2] != (2, 2)] + [(2, 2, 0, 1, 1)]
    got = {(r.x, r.z): r.area for r in columns.filter_ledges(spans(spark, pit), 5, 5).collect()}
    assert got[1, 2] == 0 and got[1, 1] == 1 and got[2, 2] == 1


def test_links_erosion_and_medians(spark):
    flat = spans(spark, [(x, z, 0, 10, 1) for x in range(7) for z in range(7)])
    links = columns.neighbour_links(flat)
    assert links.count() == 2 * 2 * 6 * 7
    walkable = flat.withColumn("layer", F.lit(0).cast("int"))
    far = {(r.x, r.z): r.distance for r in voxels.edge_distance(walkable, links).collect()}
    assert far[0, 3] == 0 and far[1, 1] == 2 and far[3, 3] == 6
    assert {(r.x, r.z) for r in voxels.erode(walkable, links, 2).collect()} == {(x, z) for x in (2, 3, 4) for z in (2, 3, 4)}
    cells = spark.createDataFrame([(x, z, 4 if (x, z) == (1, 1) else 1) for x in range(3) for z in range(3)] + [(9, 9, 0)], "x int, z int, area int")
    assert {(r.x, r.z): r.area for r in columns.median_areas(cells).collect()} == {**{(x, z): 1 for x in range(3) for z in range(3)}, (9, 9): 0}


def test_rasterised_spans_cover_a_slope():
    got = {(x, z): (lo, hi) for x, z, lo, hi in voxels.spans_of([(0.0, 0.0, 0.0), (0.0, 0.0, 4.0), (4.0, 4.0, 0.0)], 1.0, 0.5)}
    assert set(got) >= {(x, z) for x in range(4) for z in range(4) if x + z < 4} and got[0, 0] == (0, 2) and got[3, 0] == (6, 8)


def _spans_one_by_one(corners, cell, height):
    """What spans_of() has, cut corner by corner."""
    import math

    def cut(poly, axis, low, high):
        for side, plane in ((1, low), (-1, high)):
            out = []
            for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
                dp, dq = side * (p[axis] - plane), side * (q[axis] - plane)
                out += [p] if dp >= 0 else []
                if (dp < 0) != (dq < 0):
                    out.append(tuple(a + (b - a) * (dp / (dp - dq)) for a, b in zip(p, q, strict=True)))
            poly = out if len(out) > 2 else []
        return poly

    for z in range(math.floor(min(c[2] for c in corners) / cell), math.floor(max(c[2] for c in corners) / cell) + 1):
        row = cut(corners, 2, z * cell, (z + 1) * cell)
        for x in range(math.floor(min(c[0] for c in row) / cell), math.floor(max(c[0] for c in row) / cell) + 1) if row else ():
            if piece := cut(row, 0, x * cell, (x + 1) * cell):
                low = min(max(math.floor(min(c[1] for c in piece) / height), 0), voxels.MAX_HEIGHT)
                yield x, z, low, min(max(math.ceil(max(c[1] for c in piece) / height), low + 1), voxels.MAX_HEIGHT)


def test_triangles_are_cut_side_by_side_and_dealt_to_tasks(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    random.seed(5)
    rows = [[random.choice((random.uniform(-3, 9), float(random.randrange(-3, 9)), random.randrange(12) / 2)) for _ in range(9)] for _ in range(60)] + [[0.0] * 9]
    want = sorted((i, *s, i % 3) for i, r in enumerate(rows) for s in _spans_one_by_one([tuple(r[k : k + 3]) for k in (0, 3, 6)], 0.5, 0.7))
    monkeypatch.setattr(voxels, "PIECES", 50)
    assert sorted((i, *s, i % 3) for i, r in enumerate(rows) for s in voxels.spans_of([tuple(r[k : k + 3]) for k in (0, 3, 6)], 0.5, 0.7)) == want
    names = [f"{c}{v}" for c in "abc" for v in "xyz"]
    tris = spark.createDataFrame([(i, *r, i % 3) for i, r in enumerate(rows)], "tile long, " + ", ".join(f"{n} double" for n in names) + ", area int").coalesce(1)
    found = voxels.rasterize(tris, 0.5, 0.7)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 4


def test_spans_merged_in_a_task_coalesce_to_the_same(spark, monkeypatch):
    import random

    from wayfold.operators import columns

    random.seed(6)
    names = [f"{c}{v}" for c in "abc" for v in "xyz"]
    rows = [(0, *(random.uniform(0, 9) * (1 if k % 3 != 1 else 4) for k in range(9)), random.choice((None, 0, 1, 5, 63))) for _ in range(150)]
    tris = spark.createDataFrame(rows, "tile long, " + ", ".join(f"{n} double" for n in names) + ", area int")
    want = columns.coalesce_spans(voxels.rasterize(tris, 1.0, 0.5).drop("tile")).collect()
    merged = voxels.rasterize(tris, 1.0, 0.5, merge=True).drop("tile")
    assert sorted(map(str, columns.coalesce_spans(merged).collect())) == sorted(map(str, want)) and len(want) > 90
    monkeypatch.setattr(voxels, "TASKS", 1)
    assert voxels.rasterize(tris, 1.0, 0.5, merge=True).count() < voxels.rasterize(tris, 1.0, 0.5).count() / 2


def test_rasterize_skips_nulls(spark):
    names = [f"{c}{v}" for c in "abc" for v in "xyz"]
    tris = spark.createDataFrame([(1, *[0.0] * 9, 1), (1, *[None] * 9, 1)], "tile long, " + ", ".join(f"{n} double" for n in names) + ", area int")
    assert voxels.rasterize(tris, 1.0, 1.0).count() <= 4


# --- regions


def test_marking_order(spark):
    rect = "rect_seq long, minx double, maxx double, minz double, maxz double, h0 double, h1 double, h2 double, h3 double, type int, faction int"
    box = lambda seq, lo, hi, **k: (seq, float(lo), float(hi), 0.0, 1.0, *[k.get("h", 1.0)] * 4, k.get("type", 16), k.get("faction", 1))
    cells = spark.createDataFrame([(i, float(i), 0.5, 5, area) for i, area in enumerate([1, 10, 63, 1, 22])] + [(10, 3.0, 0.5, 7, 13)], "span_id long, x double, z double, y int, area int")
    water = spark.createDataFrame([box(2, -1, 3.5), box(1, -0.5, 0.5, type=19)], rect)
    roads, cities, factions = spark.createDataFrame([box(1, 0, 9)], rect), spark.createDataFrame([box(1, 2, 9)], rect), spark.createDataFrame([box(5, 0, 9, faction=2), box(6, 0, 9)], rect)
    got = {r.span_id: r.area for r in regions.mark_all(cells, water, roads, cities, factions, 0.2).collect()}
    # water wins on 0 and 2, a structure stays on 1 and 10, 3 is at a bridge and becomes a road; then factions
    assert got == {0: 21, 1: 12, 2: 18, 3: 6, 4: 24, 10: 15}
    high = regions.mark_water(cells, spark.createDataFrame([box(1, -1, 9, h=0.4)], rect), 0.2)
    assert {r.span_id: r.area for r in high.collect()}[0] == 1


def test_water_counts_a_top_at_its_very_limit(spark):
    # 63 cells of 0.2 are 12.6, as high as the corner and the tolerance; 64 are not
    spans = spark.createDataFrame([(1, 0.5, 0.5, 63, 63), (2, 0.5, 0.5, 64, 63)], "span_id long, x double, z double, y int, area int")
    water = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 9.1, 10.1, 11.1, 12.1, 16)], "rect_seq long, minx double, maxx double, minz double, maxz double, h0 double, h1 double, h2 double, h3 double, type int")
    assert {r.span_id: r.area for r in regions.mark_water(spans, water, 0.2).collect()} == {1: 16, 2: 63}


def test_highest_water(spark):
    rect = "rect_seq long, minx double, maxx double, minz double, maxz double, h0 double, h1 double, h2 double, h3 double, type int"
    rects = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 16), (2, 0.0, 10.0, 0.0, 10.0, 4.0, 4.0, 4.0, 4.0, 22)], rect)
    points = spark.createDataFrame([(1, 2.0, 5.0), (2, 8.0, 5.0), (3, 11.0, 5.0)], "p long, x double, z double")
    assert {(r.p, r.height, r.type) for r in regions.water_at(points, rects, "p").collect()} == {(1, 4.0, 22), (2, 8.0, 16)}


# --- meshes


def test_clean_and_clip(spark):
    verts = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 1.0), (0, 3, 0.0, 0.0, 0.0), (0, 4, 9.0, 9.0, 9.0)], "tile long, vid long, x double, y double, z double")
    tris = spark.createDataFrame([(0, 0, 0, 1, 2, 5), (0, 1, 3, 1, 2, 7), (0, 2, 1, 2, 3, 8)], "tile long, tid long, a long, b long, c long, area int")
    v, t = meshes.clean(verts, tris)
    assert sorted(r.vid for r in v.collect()) == [0, 1, 2]
    assert sorted((r.tid, r.a, r.b, r.c, r.area) for r in t.collect()) == [(0, 0, 1, 2, 5), (2, 1, 2, 0, 8)]
    bounds = spark.createDataFrame([(0, 0.0, 0.5, 0.0, 1.0, 0.0, 1.0)], "tile long, minx double, maxx double, miny double, maxy double, minz double, maxz double")
    assert meshes.clip(verts, tris, bounds)[1].count() == 0


def test_ancestors_stop(spark):
    rows = [(1, 0, 8, 0), (2, 1, 0, 2), (3, 2, 0, 0), (4, 4, 0, 0), (5, 99, 0, 0)] + [(100 + i, 99 + i if i else 1, 0, 0) for i in range(12)]
    got = {r.id: (r.faction, r.city) for r in meshes.ancestors(spark.createDataFrame(rows, "id long, parent long, flags int, faction int")).collect()}
    assert got[3] == (2, True) and got[4] == got[5] == (0, False) and got[108][1] and not got[109][1]


def test_terrain(spark):
    chunks = spark.createDataFrame([(1, 0.0, 0.0, 5.0, [float(i) for i in range(145)])], "chunk long, x double, y double, z double, heights array<double>")
    vertices = meshes.terrain_vertices(chunks)
    by = {r.i: r for r in vertices.collect()}
    assert len(by) == 145 and (by[9].row, by[9].col) == (1, 0) and by[17].x == pytest.approx(-2 * meshes.HALF_UNIT) and by[144].z == 149.0
    holes = spark.createDataFrame([(1, 1)], "chunk long, holes int")
    assert meshes.terrain_triangles(vertices, holes).count() == 4 * (64 - 4)


def test_first_wins_and_config(spark):
    files = spark.createDataFrame([("A.x", 1), ("a.X", 2), ("b", 1)], "name string, depth int")
    assert {(r.name, r.depth) for r in meshes.first_wins(files, F.lower("name"), F.col("depth").desc()).collect()} == {("a.X", 2), ("b", 1)}
    lines = spark.createDataFrame([("iPort=99999999999",), ("iPort=70000",), ("iBezierCurvePoints = 1",), ("nonsense",), ("sIp=0.0.0.0",), ("zKey=1",)], "value string")
    got = {r.key: r.value for r in session.clamp_config(session.read_config(lines)).collect()}
    assert len(got) == 13 and got["iPort"] == "70000" and got["iBezierCurvePoints"] == "2" and got["sIp"] == "0.0.0.0"
    assert [r.key for r in session.config_errors(session.read_config(lines)).collect()] == ["iPort"]


# --- search


def grid(spark, n=4, cost=lambda c, r: 1.0, hole=()):
    """An n x n grid of unit squares: edges, links, costs."""
    edges, at = [], {(c, r): r * n + c for r in range(n) for c in range(n) if (c, r) not in hole}
    for (c, r), ref in at.items():
        ring = [(c, r), (c, r + 1), (c + 1, r + 1), (c + 1, r)]
        for e, (dc, dr) in enumerate([(-1, 0), (0, 1), (1, 0), (0, -1)]):
            (ax, az), (bx, bz) = ring[e], ring[(e + 1) % 4]
            edges.append((ref, e, float(ax), 0.0, float(az), float(bx), 0.0, float(bz), at.get((c + dc, r + dr), -1)))
    edges = spark.createDataFrame(edges, "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double, nei long").coalesce(2)
    costs = spark.createDataFrame([(ref, cost(c, r)) for (c, r), ref in at.items()], "ref long, cost double")
    return edges, search.portals(meshes.internal_links(edges), edges), costs


REQUEST = "request_id long, start_ref long, sx double, sy double, sz double, goal_ref long, gx double, gy double, gz double"


def test_relaxation_matches_dijkstra(spark):
    import heapq

    r = random.Random(3)
    arcs = [(r.randrange(12), r.randrange(12), float(r.randint(1, 9))) for _ in range(40)]
    best = {(x.source, x.node): x.cost for x in relax(spark.createDataFrame([(s, s, 0.0) for s in range(3)], "source long, node long, cost double"), spark.createDataFrame(arcs, "node long, to_node long, weight double")).collect()}
    for s in range(3):
        seen, heap = {}, [(0.0, s)]
        while heap:
            c, v = heapq.heappop(heap)
            if v not in seen:
                seen[v] = c
                for a, b, w in arcs:
                    if a == v:
                        heapq.heappush(heap, (c + w, b))
        assert {n: c for (k, n), c in best.items() if k == s} == seen


def test_trace_walks_back(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "node long, to_node long, weight double")
    best = relax(spark.createDataFrame([(0, 0, 0.0)], "source long, node long, cost double"), arcs)
    got = trace(best, spark.createDataFrame([(0, 4)], "source long, goal long")).orderBy("step").collect()
    assert [r.node for r in got] == [4, 3, 2, 1, 0]


def test_routes_go_round_holes_and_costs(spark):
    edges, doors, costs = grid(spark, 3, hole={(1, 1)})
    asked = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 8, 2.5, 0.0, 2.5), (2, 0, 0.1, 0.0, 0.1, 0, 0.9, 0.0, 0.1)], REQUEST)
    found = search.routes(asked, doors, costs)
    points = {}
    for r in search.pull_tight(asked, found).orderBy("path_id", "seq").collect():
        points.setdefault(r.path_id, []).append((r.x, r.z))
    assert points[2] == [(0.1, 0.1), (0.9, 0.1)]
    assert points[1][0] == (0.5, 0.5) and points[1][-1] == (2.5, 2.5) and set(points[1][1:-1]) in ({(1.0, 2.0)}, {(2.0, 1.0)})
    edges, doors, costs = grid(spark, 3, cost=lambda c, r: 50.0 if c == 1 and r < 2 else 1.0)
    asked = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 2, 2.5, 0.0, 0.5)], REQUEST)
    assert max(d.az for d in search.routes(asked, doors, costs).first().doors) >= 2.0


def test_unreachable_goals_are_left_out(spark):
    edges, doors, costs = grid(spark, 3, hole={(1, 0), (1, 1), (1, 2)})
    asked = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 2, 2.5, 0.0, 0.5)], REQUEST)
    assert search.routes(asked, doors, costs).count() == 0


def test_pulled_routes_are_short_and_pass_their_doors():
    r = random.Random(4)
    for _ in range(60):
        doors, x, z = [], 1.0, 0.0
        for _ in range(r.randint(0, 6)):
            low = z + r.uniform(-1, 1)
            doors.append(((x, 0.0, low), (x, 0.0, low + r.uniform(0.2, 1.5))))
            x, z = x + 1, low
        start, goal = (0.0, 0.0, 0.3), (x, 0.0, z)
        got = search.pull(start, goal, doors)
        assert got[0] == start and got[-1] == goal
        through = [start, *(tuple((a + b) / 2 for a, b in zip(*d, strict=True)) for d in doors), goal]
        length = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
        assert length(got) <= length(through) + 1e-9
        for (ax, _, az), (_, _, bz) in doors:
            at = next(((p, q) for p, q in zip(got, got[1:], strict=False) if p[0] <= ax <= q[0] and q[0] > p[0]), None)
            z_at = at[0][2] + (at[1][2] - at[0][2]) * (ax - at[0][0]) / (at[1][0] - at[0][0])
            assert az - 1e-6 <= z_at <= bz + 1e-6


def test_nearest_snaps_and_misses(spark):
    edges, _, _ = grid(spark, 2)
    points = spark.createDataFrame([(1, 0.25, 0.5, 1.5), (2, 5.0, 0.0, 0.5), (3, 50.0, 0.0, 0.0)], "request_id long, x double, y double, z double")
    got = {r.request_id: (r.ref, r.x, r.y, r.z, r.over) for r in search.nearest(points, edges, 1.2).collect()}
    assert got == {1: (2, 0.25, 0.0, 1.5, True), 2: (1, 2.0, 0.0, 0.5, False)}


def test_rays_and_moves(spark):
    edges, doors, _ = grid(spark, 3)
    walls = edges.filter("nei < 0")
    rays = spark.createDataFrame([(1, 0.5, 0.5, 2.5, 2.4), (2, 0.5, 0.5, 4.5, 0.5)], "request_id long, sx double, sz double, gx double, gz double")
    got = {r.request_id: (r.t, r.nx, r.nz) for r in search.cast_rays(rays, walls, 1.0).collect()}
    assert got[1] == (None, None, None) and got[2][0] == pytest.approx(0.625) and abs(got[2][1]) == 1.0
    moved = {r.request_id: (r.x, r.z) for r in search.move_along(rays.withColumn("start_ref", F.lit(0).cast("long")), edges, doors).collect()}
    assert moved[1] == (2.5, 2.4) and moved[2] == (3.0, 0.5)


def test_random_points_follow_area(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, -1), (1, 1, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, -1), (1, 2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1), (2, 0, 5.0, 0.0, 0.0, 5.0, 0.0, 3.0, -1), (2, 1, 5.0, 0.0, 3.0, 6.0, 0.0, 0.0, -1), (2, 2, 6.0, 0.0, 0.0, 5.0, 0.0, 0.0, -1)], "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double, nei long")
    choices = spark.range(4000).select(F.col("id").alias("request_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("ref"))
    got = search.random_points(choices, edges).collect()
    share = sum(r.ref == 2 for r in got) / len(got)
    assert abs(share - 0.75) < 0.03
    assert all((r.x >= 0 and r.z >= 0 and r.x + r.z <= 1 + 1e-9) if r.ref == 1 else (5 <= r.x <= 6 and r.z <= 3 * (6 - r.x) + 1e-9) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.random_points(choices.repartition(5), edges).collect()))


def test_border_links(spark):
    edge = lambda ref, tx, nei, x, lo, hi, y: (ref, 0, tx, 0, nei, x, y, lo, x, y, hi)
    edges = spark.createDataFrame([edge(1, 0, -4, 10.0, 0.0, 4.0, 0.0), edge(2, 1, -2, 10.005, 1.0, 9.0, 2.0), edge(3, 1, -2, 10.005, 4.0, 9.0, 0.0), edge(4, 1, -2, 10.0, 0.0, 9.0, 9.0)], "ref long, edge int, tile_x int, tile_y int, nei int, ax double, ay double, az double, bx double, by double, bz double")
    got = {(r.from_ref, r.to_ref): (r.bmin, r.bmax) for r in meshes.border_links(edges, 1.2).collect()}
    assert got == {(1, 2): (64, 255), (2, 1): (0, 96)}


def test_request_routing(spark):
    rows = spark.createDataFrame([(0, 31), (0, 32), (6, 99), (77, 1), (9, 0)], "kind int, size int")
    got = [r.status for r in session.route(rows, F.col("kind"), F.col("size"), {"PATH": 32}).collect()]
    assert got == ["short", "ok", "unanswered", "unknown", "ok"]

# --- terrain and tables


def test_road_cells_read_two_bits_low_first(spark):
    from wayfold.operators import terrain

    chunks = spark.createDataFrame([(1, 100.0, 200.0, [0b00011011] + [0] * 15, [7, 8])], "chunk long, x double, y double, pred_tex array<int>, layers array<int>")
    roads = spark.createDataFrame([(8,)], "texture_id int")
    (r,) = terrain.road_rects(chunks, roads).collect()
    # layers 3, 2, 1, 0: the first two cells name layers that the chunk lacks, the third a road
    assert r.cell == 2 and r.maxx == pytest.approx(200 - 2 * meshes.UNIT + 0.01) and r.minz == pytest.approx(100 - meshes.UNIT - 0.01)


def test_liquid_cells_take_mask_and_heights(spark):
    from wayfold.operators import terrain

    schema = "chunk long, instance int, x double, y double, liquid int, off_x int, off_y int, width int, height int, max_h double, mask array<int>, heights array<double>"
    rows = [(1, 0, 0.0, 0.0, 5, 0, 0, 2, 1, 9.0, [0b10], [float(i) for i in range(6)]), (2, 0, 0.0, 0.0, 99, 1, 1, 1, 1, 9.0, None, None), (3, 0, 0.0, 0.0, 5, 0, 0, 0, 4, 9.0, None, None)]
    got = {r.chunk: r for r in terrain.liquid_rects(spark.createDataFrame(rows, schema), spark.createDataFrame([(5, "slime")], "liquid int, kind string")).collect()}
    assert set(got) == {1, 2} and (got[1].cell, got[1].type, got[1].h3, got[1].h2, got[1].h1, got[1].h0) == (1, 25, 1.0, 2.0, 4.0, 5.0)
    assert got[2].type == 16 and got[2].h0 == 9.0


def test_translation_and_first_hit(spark):
    lines = spark.createDataFrame([("A/b.blp\t111 ",), ("broken",), ("a/B.blp\t222",), ("c\t333",)], "value string").coalesce(1)
    table = session.translate_table(lines)
    assert {(r.key, r.hash) for r in table.collect()} == {("a/b.blp", "222"), ("c", "333")}
    asked = spark.createDataFrame([("x", "C"), ("a/b.blp", "c"), ("n", "m")], "one string, two string")
    got = {r.one: r.hash for r in session.first_found(asked, [F.col("one"), F.col("two")], table).collect()}
    assert got == {"x": "333", "a/b.blp": "222", "n": None}


def test_walks_slide_along_walls(spark):
    edges, doors, _ = grid(spark, 3)
    path = polyline(spark, [(0.5, 0.0, 0.5), (2.5, 0.0, 0.5), (2.5, 0.0, 9.0)])
    got = [(r.seq, r.x, r.z) for r in search.walk(path, edges, doors, 1.2).orderBy("seq").collect()]
    assert got == [(0, 0.5, 0.5), (1, 2.5, 0.5), (2, 2.5, 3.0)]


def test_models_are_scaled_turned_and_moved(spark):
    verts = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0)], "model int, vid int, x double, y double, z double")
    placed = meshes.place(verts, spark.createDataFrame([(7, 1, 0.0, 0.0, math.pi / 2, 2.0, 10.0, 20.0, 30.0), (8, 2, *[0.0] * 7)], "placement int, model int, rx double, ry double, rz double, scale double, px double, py double, pz double")).collect()
    assert [(r.placement, r.x, r.y, r.z) for r in placed] == [(7, pytest.approx(10), pytest.approx(22), 30.0)]


def test_ancestors_hold_no_table_of_all_rounds_in_one_task(spark):
    from wayfold.operators.meshes import ancestors

    areas = spark.createDataFrame([(1, 0, 8, 0), (2, 1, 1, 5), (3, 2, 1, 0), (4, 9, 1, 0), (-1, 3, 1, 0)], "id long, parent long, flags int, faction int")
    found = ancestors(areas)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(-1, 5, True), (1, 0, True), (2, 5, True), (3, 5, True), (4, 0, False)]
