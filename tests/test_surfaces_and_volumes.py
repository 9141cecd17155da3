"""Fields, volumes, detail surfaces, samples, off-mesh connections, box trees and archive order against plain versions and on odd inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.names import natural_key
from wayfold.operators import boxtree as B
from wayfold.operators import detail as D
from wayfold.operators import offmesh as O
from wayfold.operators import sampling as P
from wayfold.operators import search as S
from wayfold.operators import volumes as V
from wayfold.operators import voxels as X

from .test_walls_and_shapes import row_of_squares, square, tables

SHAPE = "array<struct<x:double,z:double>>"


def as_shape(points):
    return [{"x": float(x), "z": float(z)} for x, z in points]


def test_distance_and_blur_of_an_open_field(spark):
    n = 11
    cells = {(x, z): 1 if x < 6 else 2 for x in range(n) for z in range(n) if (x, z) != (3, 3)}
    steps = ((-1, 0), (0, 1), (1, 0), (0, -1))
    links = [(x, z, 0, d, 0) for (x, z) in cells for d, (dx, dz) in enumerate(steps) if (x + dx, z + dz) in cells]
    far = {c: 0 if sum(cells.get((c[0] + dx, c[1] + dz)) == cells[c] for dx, dz in steps) < 4 else 10**6 for c in cells}
    for _ in range(3 * n):
        for x, z in cells:
            for d, (dx, dz) in enumerate(steps):
                side = (x + dx, z + dz)
                if side in cells:
                    far[x, z] = min(far[x, z], far[side] + 2)
                    diagonal = (side[0] + steps[(d + 3) % 4][0], side[1] + steps[(d + 3) % 4][1])
                    if diagonal in cells:
                        far[x, z] = min(far[x, z], far[diagonal] + 3)
    spans = spark.createDataFrame([(x, z, 0, a) for (x, z), a in cells.items()], "x int, z int, layer int, area int")
    link = spark.createDataFrame(links, "x int, z int, layer int, dir int, to_layer int")
    found = X.distance_field(spans, link)
    assert {(r.x, r.z): r.distance for r in found.collect()} == far and max(far.values()) > 2
    smooth = {}
    for (x, z), own in far.items():
        total = own
        for d, (dx, dz) in enumerate(steps):
            side, corner = (x + dx, z + dz), (x + dx + steps[(d + 1) % 4][0], z + dz + steps[(d + 1) % 4][1])
            total += far[side] if side in cells else own
            total += far[corner] if side in cells and corner in cells else own
        smooth[x, z] = own if own <= 2 else (total + 5) // 9
    assert {(r.x, r.z): r.distance for r in X.blurred(found, link).collect()} == smooth
    # an endless strip has no border: nothing is returned, and rounds end
    assert X.distance_field(spans.limit(0), link.limit(0)).collect() == []


def test_the_last_volume_marks(spark):
    spans = [(i, float(i % 20), float(i // 20), 5, 0 if i % 9 == 0 else 1) for i in range(400)]
    rows = [
        (1, 3, "box", 2.0, 0.0, 3.0, 9.9, 9.0, 8.0, None, None, None, None),
        (2, 4, "prism", None, 5.0, None, None, 5.9, None, as_shape([(4, 4), (14, 6), (8, 15)]), None, None, None),
        (3, 5, "cylinder", None, 0.0, None, None, 20.0, None, None, 10.5, 10.5, 3.0),
        (4, 6, "box", 0.0, 7.0, 0.0, 19.0, 9.0, 19.0, None, None, None, None),  # above all spans
        (5, 7, "cylinder", None, 0.0, None, None, 9.0, None, None, -5.0, -5.0, 2.0),  # beside all
    ]
    schema = f"seq long, area int, kind string, minx double, miny double, minz double, maxx double, maxy double, maxz double, corners {SHAPE}, px double, pz double, radius double"

    def inside(x, z, v):
        if v[2] == "box":
            return v[6] is not None and int(v[3]) <= x <= int(v[6]) and int(v[5]) <= z <= int(v[8])
        if v[2] == "cylinder":
            return (x + 0.5 - v[10]) ** 2 + (z + 0.5 - v[11]) ** 2 < v[12] ** 2
        p = [(c["x"], c["z"]) for c in v[9]]
        return sum((a[1] > z + 0.5) != (b[1] > z + 0.5) and x + 0.5 < (b[0] - a[0]) * (z + 0.5 - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) % 2 == 1

    want = {}
    for i, x, z, y, area in spans:
        for v in rows:
            if area and int(v[4]) <= y <= int(v[7]) and inside(x, z, v):
                want[i] = v[1]
        want.setdefault(i, area)
    for bucket in (3, 64):
        got = V.mark_volumes(spark.createDataFrame(spans, "span_id long, x double, z double, y int, area int"), spark.createDataFrame(rows, schema), bucket=bucket)
        assert {r.span_id: r.area for r in got.collect()} == want
    assert {3, 4, 5} <= set(want.values()) and 6 not in want.values()
    none = V.mark_volumes(spark.createDataFrame(spans, "span_id long, x double, z double, y int, area int"), spark.createDataFrame([], schema))
    assert none.count() == 400


def test_grown_outlines_lie_outside(spark):
    rows = [(1, as_shape([(0, 0), (4, 0), (4, 4), (0, 4)])), (5, as_shape([(0, 0), (0, 4), (4, 4), (4, 0)])), (2, as_shape([(2, 0), (1, 8), (0, 0)])), (3, as_shape([(0, 0), (0, 0), (2, 2)])), (4, [])]
    got = {r.id: [(p.x, p.z) for p in r.o] for r in spark.createDataFrame(rows, f"id long, c {SHAPE}").select("id", V.offset_outline(F.col("c"), 1.0).alias("o")).collect()}
    # right angles stick out too far: each is cut in two
    assert sorted(got[1]) == [(-1, -0.5), (-1, 4.5), (-0.5, -1), (-0.5, 5), (4.5, -1), (4.5, 5), (5, -0.5), (5, 4.5)]
    assert sorted(got[5]) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    assert len(got[2]) > 3 and min(z for _, z in got[2]) == pytest.approx(-1.0) and got[4] == []


def test_heights_come_from_detail_triangles(spark):
    edges = square(1, 0, 0, 0.0, 4.0) + square(2, 10, 0, 1.0, 4.0)
    details = [(1, [{"x": 2.0, "y": 8.0, "z": 2.0}], [{"a": i, "b": (i + 1) % 4, "c": 4, "flags": 1} for i in range(4)])]
    e = tables(spark, edges, [])[0]
    d = spark.createDataFrame(details, "ref long, points array<struct<x:double,y:double,z:double>>, tris array<struct<a:int,b:int,c:int,flags:int>>")
    pairs = [(1, 2.0, 0.0, 2.0, 1), (2, 1.0, 0.0, 2.0, 1), (3, -3.0, 0.0, 1.0, 1), (4, 12.0, 0.0, 3.0, 2), (5, 20.0, 0.0, 2.0, 2), (6, 0.5, 0.0, 0.1, 1)]
    got = {r.request_id: r for r in D.surface_points(spark.createDataFrame(pairs, "request_id long, px double, py double, pz double, ref long"), D.surfaces(e, d)).collect()}
    assert (got[1].over, got[1].y) == (True, 8.0) and got[2].y == pytest.approx(4.0)
    assert (got[3].over, got[3].x, got[3].y, got[3].z) == (False, 0.0, 0.0, 1.0)  # the inner sides would be higher, but only the boundary counts
    assert (got[4].over, got[4].y) == (True, 1.0) and (got[5].x, got[5].z) == (14.0, 2.0) and got[6].y == pytest.approx(0.4)


def plain_surface_point(px, pz, outline, tris):
    """over, x, y, z by loops; None for no point."""
    over = False
    for (ax, _, az), (bx, _, bz) in zip(outline, outline[-1:] + outline[:-1], strict=True):
        over ^= (az > pz) != (bz > pz) and px < (bx - ax) * (pz - az) / (bz - az) + ax
    near, height = None, None
    for *t, flags in tris:
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = t
        v0x, v0z, v1x, v1z, v2x, v2z = cx - ax, cz - az, bx - ax, bz - az, px - ax, pz - az
        det = v0x * v1z - v0z * v1x
        u, v = (math.copysign(1.0, det) * w for w in (v1z * v2x - v1x * v2z, v0x * v2z - v0z * v2x))
        if height is None and abs(det) > 1e-6 and u >= 0 and v >= 0 and u + v <= abs(det):
            height = ay + ((cy - ay) * u + (by - ay) * v) / abs(det)
        for i, j, bit in ((2, 0, 16), (0, 1, 1), (1, 2, 4)):
            if over or flags & bit:
                p, q = t[i], t[j]
                dx, dz = q[0] - p[0], q[2] - p[2]
                k = min(max(((px - p[0]) * dx + (pz - p[2]) * dz) / (dx * dx + dz * dz), 0.0), 1.0) if dx or dz else 0.0
                on = [a + k * (b - a) for a, b in zip(p, q, strict=True)]
                d = (on[0] - px) * (on[0] - px) + (on[2] - pz) * (on[2] - pz)
                near = (d, on) if near is None or d < near[0] else near
    on = near[1] if near else [None] * 3
    return (True, px, on[1] if height is None else height, pz) if over else (False, *on)


def test_points_on_surfaces_are_dealt_by_polygon(spark):
    r = random.Random(3)
    place = lambda: (float(r.randint(-4, 4)), r.uniform(0, 3), float(r.randint(-4, 4)))  # noqa: E731  # many equal distances, corners and sides without length
    edges, details, want = [], [], {}
    for ref in range(40):
        outline, points = [place() for _ in range(r.randint(3, 6))], [place() for _ in range(r.randint(0, 3))]
        every = outline + points
        edges += [(ref, e, *a, *b, -1) for e, (a, b) in enumerate(zip(outline, outline[1:] + outline[:1], strict=True))]
        tris = [[*(r.randrange(len(every)) for _ in "abc"), r.choice([0, 1, 5, 16, 21])] for _ in range(r.randint(0, 6))]
        details.append((ref, [dict(zip("xyz", p, strict=True)) for p in points], [dict(zip(("a", "b", "c", "flags"), t, strict=True)) for t in tris]))
        want[ref] = outline, [(*(every[i] for i in t[:3]), t[3]) for t in tris]
    edges.append((99, 0, *(0.0, 1.0, 0.0), *(1.0, 1.0, 0.0), -1))  # neither triangles nor a point
    e = spark.createDataFrame(edges, "ref long, edge int, ax double, ay double, az double, bx double, by double, bz double, nei long")
    d = spark.createDataFrame(details, "ref long, points array<struct<x:double,y:double,z:double>>, tris array<struct<a:int,b:int,c:int,flags:int>>")
    pairs = [(i, float(r.randint(-5, 5)) + r.choice([0.0, 0.25]), 0.0, r.uniform(-5, 5) if i % 2 else float(r.randint(-5, 5)), i % 40) for i in range(2500)] + [(-1, 0.5, 0.0, 0.5, 99), (-2, None, 0.0, 1.0, 99), (-3, 0.0, 0.0, 0.0, 77)]
    found = D.surface_points(spark.createDataFrame(pairs, "request_id long, px double, py double, pz double, ref long"), D.surfaces(e, d))
    got = {x.request_id: (x.over, x.x, x.y, x.z) for x in found.collect()}
    assert got.pop(-1) == got.pop(-2) == (False, None, None, None)
    assert got == {i: plain_surface_point(px, pz, *want[ref]) for i, px, _, pz, ref in pairs if i >= 0}
    # the work of a pair is far more than its bytes: pairs don't stay in the few tasks that read them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "MapInArrow" in plan


@pytest.mark.parametrize("radius", [1.0, 30.0])
def test_samples_keep_apart_and_leave_no_room(spark, radius):
    outlines = spark.createDataFrame([(1, as_shape([(-6, -6), (-6, 2), (3, 2), (3, -6)])), (2, as_shape([(0, 0), (2, 5), (7, 1)])), (3, as_shape([(0, 0), (0, 0), (0, 0)]))], f"id long, corners {SHAPE}")
    rows = P.poisson_disk(outlines, radius, seed=5).collect()
    assert sorted(rows) == sorted(P.poisson_disk(outlines.repartition(3), radius, seed=5).collect())
    seats = P.candidates(outlines, radius, seed=5).collect()
    for key in (1, 2):
        points = [(r.x, r.z) for r in rows if r.id == key]
        assert points and all(math.dist(a, b) >= radius for i, a in enumerate(points) for b in points[:i])
        assert all(min(math.dist((c.x, c.z), p) for p in points) < radius for c in seats if c.id == key)
    assert {r.id for r in rows} == {1, 2}


def test_routes_over_connections(spark):
    edges, links = row_of_squares(2)
    far, beyond = row_of_squares(2, 0.0, 10)
    far = [(r, i, ax + 20, ay, az, bx + 20, by, bz, n) for r, i, ax, ay, az, bx, by, bz, n in far]
    e, k, c = tables(spark, edges + far, links + beyond)
    rows = [(1, 1.9, 0.0, 0.5, 20.2, 0.0, 0.5, 0.3, False, 0.1), (2, 1.9, 5.0, 0.5, 20.2, 0.0, 0.5, 0.3, True, 0.01), (3, 2.2, 0.0, 0.5, 20.2, 0.0, 0.5, 0.1, True, 0.01)]
    jumps = spark.createDataFrame(rows, "id long, ax double, ay double, az double, bx double, by double, bz double, radius double, both boolean, cost double")
    snapped = O.snap_connections(jumps, e, 1.0)
    assert [(x.id, x.start_ref, x.end_ref) for x in snapped.collect()] == [(1, 1, 10)]  # 2 is too high, 3 too far
    doors, costs = O.off_mesh_doors(snapped)
    asked = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 11, 21.5, 0.0, 0.5), (2, 11, 21.5, 0.0, 0.5, 0, 0.5, 0.0, 0.5)], "request_id long, start_ref long, sx double, sy double, sz double, goal_ref long, gx double, gy double, gz double")
    every = S.portals(k, e).unionByName(doors)
    got = {x.request_id: x for x in S.routes(asked, every, c.unionByName(costs)).collect()}
    assert set(got) == {1} and got[1].cost == pytest.approx(1.4 + 18.3 * 0.1 + 1.3) and [d.to_ref for d in got[1].doors] == [1, -2, 10, 11]
    both, _ = O.off_mesh_doors(snapped.withColumn("both", F.lit(True)))
    assert {x.request_id for x in S.routes(asked, S.portals(k, e).unionByName(both), c.unionByName(costs)).collect()} == {1, 2}
    crossings = spark.createDataFrame([(1, 1, -2), (2, 10, -2), (3, 5, -2), (4, 1, -9)], "request_id long, prev_ref long, ref long")
    assert {x.request_id: (x.from_x, x.to_x) for x in O.connection_ends(crossings, snapped).collect()} == {1: (1.9, 20.2), 2: (20.2, 1.9)}
    assert O.snap_connections(jumps.limit(0), e, 1.0).collect() == []


def test_trees_find_what_a_scan_finds(spark):
    r = random.Random(6)
    boxes = []
    for ref in range(150):
        low = [r.randint(0, 60) for _ in range(3)]
        boxes.append((ref % 3, ref, *low, *(v + r.randint(0, 9) for v in low)))
    boxes += [(7, 900, 1, 1, 1, 2, 2, 2), (8, 901, 5, 5, 5, 5, 5, 5), (8, 902, 5, 5, 5, 5, 5, 5)]
    schema = "tile int, ref long, " + ", ".join(f"{b} int" for b in B.BOUNDS)
    trees = B.build_trees(spark.createDataFrame(boxes, schema))
    nodes = trees.collect()
    for tile in (0, 1, 2, 7, 8):
        mine = sorted((n for n in nodes if n.tile == tile), key=lambda n: n.node)
        size = sum(b[0] == tile for b in boxes)
        assert [n.node for n in mine] == list(range(2 * size - 1)) and mine[0].escape == 2 * size - 1
        for n in mine:
            below = mine[n.node : n.node + n.escape]
            assert all(min(b[f"min{v}"] for b in below) == n[f"min{v}"] and max(b[f"max{v}"] for b in below) == n[f"max{v}"] for v in "xyz")
    asked = []
    for q in range(60):
        low = [r.randint(-5, 60) for _ in range(3)]
        asked.append((q, r.choice([0, 1, 2, 7, 8, 9]), *low, *(v + r.randint(0, 25) for v in low)))
    got = {tuple(x) for x in B.search_trees(spark.createDataFrame(asked, "request_id long, tile int, " + ", ".join(f"{b} int" for b in B.BOUNDS)), trees).collect()}
    assert got == {(q[0], b[1]) for q in asked for b in boxes if q[1] == b[0] and all(q[2 + i] <= b[5 + i] and q[5 + i] >= b[2 + i] for i in range(3))} and got
    assert B.build_trees(spark.createDataFrame([], schema)).collect() == []


def test_trees_are_searched_in_one_pass_over_batches(spark, monkeypatch):
    rnd = random.Random(4)
    box = lambda size: [*(at := [rnd.randrange(60) for _ in range(3)]), *(a + rnd.randrange(size) for a in at)]
    boxes = [(t, t * 100 + i, *box(9)) for t in range(5) for i in range(1 + 9 * t)]
    asked = [(i, rnd.randrange(7), *box(20)) for i in range(200)] + [(200, None, *box(20)), (201, 1, *[None] * 6)]
    columns = ", ".join(f"{b} int" for b in B.BOUNDS)
    trees = B.build_trees(spark.createDataFrame(boxes, "tile int, ref long, " + columns))
    want = sorted((q[0], b[1]) for q in asked[:200] for b in boxes if b[0] == q[1] and all(q[2 + k] <= b[5 + k] and q[5 + k] >= b[2 + k] for k in range(3)))
    monkeypatch.setattr(B, "cut", None)  # no round is written
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = B.search_trees(spark.createDataFrame(asked, "request_id long, tile int, " + columns), trees).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_archives_in_the_order_they_are_loaded(spark):
    names = ["Data/common.MPQ", "Data/common-2.MPQ", "Data/patch.MPQ", "Data/patch-2.MPQ", "Data/patch-10.MPQ", "Data\\enUS\\patch-enUS-3.MPQ", "Data/enUS/locale.MPQ", "Data/patch-0.MPQ", "", "x", "9" * 50 + ".MPQ"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "p string").orderBy(natural_key(F.col("p"))).collect()]
    assert got[:2] == ["Data/enUS/locale.MPQ", "Data\\enUS\\patch-enUS-3.MPQ"]
    assert got[2:8] == ["Data/common.MPQ", "Data/patch-0.MPQ", "Data/patch.MPQ", "Data/common-2.MPQ", "Data/patch-2.MPQ", "Data/patch-10.MPQ"]


def test_paths_are_validated_as_their_flags_say(spark):
    from wayfold.operators import paths as P

    edges, links = row_of_squares(4)
    e, k, c = tables(spark, edges, links)
    line = [(0.5, 0.2), (1.5, 1.8), (2.5, -1.0), (3.5, 0.5)]
    rows = [(flags, i, x, 0.0, z) for flags in (0, P.SNAP, P.CHAIKIN, P.CHAIKIN | P.SNAP, P.CHAIKIN | P.WALK, P.CHAIKIN | P.SNAP | P.WALK) for i, (x, z) in enumerate(line)]
    paths = spark.createDataFrame(rows, "path_id long, seq int, x double, y double, z double")
    flags = paths.selectExpr("path_id", "cast(path_id AS int) AS flags").distinct()
    out = {}
    for r in S.answer_paths(paths, flags, e, S.portals(k, e), 1.0).orderBy("path_id", "seq").collect():
        out.setdefault(r.path_id, []).append((r.x, r.z))
    assert out[0] == out[P.SNAP] == line  # what isn't smoothed isn't validated
    smoothed = out[P.CHAIKIN]
    assert len(smoothed) > 4 and any(not 0 <= z <= 1 for _, z in smoothed)
    inside = [(x, min(max(z, 0.0), 1.0)) for x, z in smoothed]
    assert [v for p in out[P.CHAIKIN | P.SNAP] for v in p] == pytest.approx([v for p in inside for v in p]) and out[P.CHAIKIN | P.SNAP | P.WALK] == out[P.CHAIKIN | P.SNAP]
    assert [p[0] for p in out[P.CHAIKIN | P.WALK]] == pytest.approx([p[0] for p in inside]) and all(0 <= z <= 1 for _, z in out[P.CHAIKIN | P.WALK][1:])
    every = S.answer_paths(paths, flags, e, S.portals(k, e), 1.0, validate_all=True).filter(f"path_id = {P.SNAP}").collect()
    assert sorted((r.x, r.z) for r in every) == [(x, min(max(z, 0.0), 1.0)) for x, z in line]


def test_walks_send_no_table_by_path_through_the_driver(spark, monkeypatch):
    plans, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges, links = row_of_squares(4)
    e, k, _ = tables(spark, edges, links)
    paths = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5), (1, 1, 2.5, 0.0, 3.0), (2, 0, 1.5, 0.0, 0.5), (2, 1, -2.0, 0.0, 0.25)], "path_id long, seq int, x double, y double, z double")
    got = sorted((r.path_id, r.seq, r.x, r.z) for r in S.walk(paths, e, S.portals(k, e), 1.0).collect())
    assert got == [(1, 0, 0.5, 0.5), (1, 1, 2.5, 1.0), (2, 0, 1.5, 0.5), (2, 1, 0.0, 0.25)]
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    sent = [line for line in joins if "BroadcastHashJoin" in line]
    # the tables of the walkers are small files here, as they are where very many rows are alike
    assert len(joins) > 4 and not [line for line in sent if "[request_id#" in line or "[bx#" in line and "BuildLeft" in line]


def test_paths_of_the_same_points_and_flags_are_answered_once(spark, tmp_path, monkeypatch):
    from wayfold.plans import requests as R

    n = 1500
    spark.range(n).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    asked = []
    monkeypatch.setattr(R.S, "answer_paths", lambda paths, flags, *_: asked.extend((paths, flags)) or paths)
    got = {(r.path_id, r.seq): (r.x, r.z) for r in R.path_answers(spark, str(tmp_path)).collect()}
    want = {(c, i): (c * (3 + i) % 7 - 0.7, c * (5 - i) % 6 - 0.3) for c in range(n) for i in range(4)}
    assert got == {p: tuple(math.floor(v * 1e6 + 0.371) for v in at) for p, at in want.items()}
    assert [t.select("path_id").distinct().count() for t in asked] == [672, 672] and asked[1].filter("path_id.flags NOT BETWEEN 0 AND 31").isEmpty()


def test_refs_of_tiles_that_were_replaced_or_are_short(spark):
    from wayfold.functions import geometry as G
    from wayfold.operators import meshes as M

    rows = [(1, 1, 5, 0), (2, 2, 5, 0), (3, 1, 5, 9), (4, 1, 5, 10), (5, 1, 6, 0), (6, 0, 0, 0)]
    refs = spark.createDataFrame(rows, "n int, salt int, tile int, poly long").withColumn("ref", G.encode_ref(F.col("salt"), F.col("tile"), F.col("poly")))
    tiles = spark.createDataFrame([(5, 1, 10), (0, 0, 5)], "tile int, salt int, polys long")
    assert sorted(r.n for r in M.valid_refs(refs.select("n", "ref"), tiles).collect()) == [1, 3]


def test_points_are_uniform_over_the_mesh(spark):
    edges = square(1, 0, 0, 0.0, 1.0) + square(2, 10, 0, 0.0, 3.0) + [(3, i, 5.0, 0.0, 5.0, 5.0, 0.0, 5.0, -1) for i in range(4)]
    e = tables(spark, edges, [])[0]
    asked = spark.range(4000).selectExpr("id AS request_id")
    rows = S.random_points_anywhere(asked, e, seed=3).collect()
    assert sorted(rows) == sorted(S.random_points_anywhere(asked.repartition(7), e.repartition(3), seed=3).collect()) and len(rows) == 4000
    big = [r for r in rows if r.ref == 2]
    assert abs(len(big) / 4000 - 0.9) < 0.02 and {r.ref for r in rows} == {1, 2}
    assert all(10 <= r.x <= 13 and 0 <= r.z <= 3 for r in big)
    assert abs(sum(r.x < 11.5 for r in big) / len(big) - 0.5) < 0.04 and abs(sum(r.z < 1 for r in big) / len(big) - 1 / 3) < 0.04
    assert S.random_points_anywhere(asked, e.filter("ref = 3")).collect() == [] and S.random_points_anywhere(asked.limit(0), e).collect() == []


def test_closest_points_on_triangles_and_boundaries(spark):
    from wayfold.functions import geometry as G
    from wayfold.operators import meshes as M

    r = random.Random(12)
    rows = [tuple(r.uniform(-5, 5) for _ in range(12)) for _ in range(60)] + [(1.0, 2.0, 3.0) + (0.0, 0.0, 0.0) * 3, (1.0, 2.0, 3.0) + (0.0, 0.0, 0.0) * 2 + (4.0, 0.0, 0.0)]
    names = [f"{p}{v}" for p in "pabc" for v in "xyz"]
    at = G.closest_on_triangle(*(tuple(F.col(f"{p}{v}") for v in "xyz") for p in "pabc"))
    got = [tuple(x.q) for x in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names)).select("i", at.alias("q")).orderBy("i").collect()]
    for row, q in zip(rows, got, strict=True):
        p, a, b, c = (row[i : i + 3] for i in range(0, 12, 3))
        best = min(math.dist(p, [a[k] + s / 40 * (b[k] - a[k]) + t / 40 * (c[k] - a[k]) for k in range(3)]) for s in range(41) for t in range(41 - s))
        assert math.dist(p, q) <= best + 1e-9 and best - math.dist(p, q) < 0.3
    e = tables(spark, square(1, 0, 0, 2.0, 4.0), [])[0]
    pairs = spark.createDataFrame([(1, 1.0, 9.0, 1.0, 1), (2, 6.0, 9.0, 1.0, 1)], "request_id long, px double, py double, pz double, ref long")
    assert {x.request_id: (x.inside, x.x, x.y, x.z) for x in S.boundary_points(pairs, e).collect()} == {1: (True, 1.0, 9.0, 1.0), 2: (False, 4.0, 2.0, 1.0)}
    polys = spark.createDataFrame([(1, 1, 4, "a"), (2, 1, 4, "b")], "ref long, area int, flags int, name string")
    changes = spark.createDataFrame([(1, 1, 5, None), (1, 2, None, 8), (1, 0, 9, 9), (7, 1, 1, 1)], "ref long, seq long, area int, flags int")
    assert sorted(tuple(x) for x in M.set_polygons(polys, changes).collect()) == [(1, 5, 8, "a"), (2, 1, 4, "b")]


def test_outline_is_grown_by_an_expression_of_bounded_size(spark):
    # what a lambda names twice is worked out twice; the expression over a column grew to thousands of such
    from wayfold.operators.volumes import offset_outline

    square = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)],)], "corners array<struct<x:double,z:double>>")
    grown = square.select(offset_outline(F.col("corners"), 1.0).alias("c"))
    assert grown._jdf.queryExecution().optimizedPlan().toString().count("lambda") < 400
    assert len(grown.first().c) == 8


def test_samples_of_small_and_large_outlines_agree_and_candidates_are_not_written(spark, tmp_path):
    import os

    from wayfold.operators.sampling import poisson_disk

    rows = [(k, [(k * 3.0, 0.0), (k * 3.0 + 1 + k % 5 * 4, 0.7), (k * 3.0 + 7, 9.0 + k), (k * 3.0 - 1, 5.0)]) for k in range(40)] + [(99, [(0.0, 0.0), (0.0, 0.0)]), (98, None)]
    outlines = spark.createDataFrame(rows, "id long, corners array<struct<x:double,z:double>>").repartition(3)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/wayfold"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    local = sorted(map(tuple, poisson_disk(outlines, 2.0).collect()))
    assert len(set(os.listdir(folder)) - before) == 1
    assert len(local) > 300 and local == sorted(map(tuple, poisson_disk(outlines, 2.0, most=0).collect()))
    assert local == sorted(map(tuple, poisson_disk(outlines, 2.0, most=150).collect()))
