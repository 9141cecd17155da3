"""Readers of chunked files: round trips, and what is damaged as rows with errors."""

import struct

from wayfold.sources import chunks as K


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


HEIGHTS = [i * 0.5 for i in range(145)]
LEVELS = [float(i) for i in range(81)]


def test_terrain_round_trip_and_damage(spark):
    good = K.terrain_bytes(3, 4, 99, 0x10, 0x8001, (1.5, 2.5, 3.5), HEIGHTS, [(7, 1, 2, 3), (8, 0, 0, 0xFFFFFFFF)], (1.0, 2.0, LEVELS, [15] * 63 + [0]), bytes(range(16)))
    bare = K.terrain_bytes(0, 0, 1, 0, 0, (0.0, 0.0, 0.0), None)
    far = bytearray(bare)
    struct.pack_into("<I", far, K.TERRAIN["heights"], 5000)
    other = bytearray(good)
    struct.pack_into("<I", other, K.TERRAIN["heights"], struct.unpack_from("<I", good, K.TERRAIN["layers"])[0])
    head = K.chunk("MVER", struct.pack("<I", 18))
    rows = K.read_terrain(files(spark, good=head + good + bare, cut=head + good[:-200], far=head + bytes(far) + good, other=bytes(other), short=K.chunk("MCNK", b"123"), none=b"", junk=b"\x00" * 5)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append(r)
    first, second = by["good"]
    assert (first.cx, first.cy, first.area_id, first.flags, first.holes, first.x, first.y, first.z) == (3, 4, 99, 0x10, 0x8001, 1.5, 2.5, 3.5)
    assert first.heights == HEIGHTS and [tuple(x) for x in first.layers] == [(7, 1, 2, 3), (8, 0, 0, 0xFFFFFFFF)] and bytes(first.predominant) == bytes(range(16))
    assert first.liquid.heights == LEVELS and first.liquid.high == 2.0 and first.error is None
    assert second.heights is None and second.layers == [] and second.liquid is None
    assert [r.error is None for r in by["far"]] == [False, True] and "declared" in by["cut"][0].error
    assert "MCVT" in by["other"][0].error and by["short"][0].error == "short header" and "none" not in by and by["junk"][0].error == "cut in a head"
    quads = K.old_liquid_quads(K.read_terrain(files(spark, good=good, bare=bare))).collect()
    assert [(q.row, q.col, q.kind, q.nw, q.ne, q.sw, q.se) for q in quads] == [(7, 7, "magma", 70.0, 71.0, 79.0, 80.0)]


def test_chunks_and_their_inner_ones(spark):
    raw = K.chunk("MVER", b"1234") + K.terrain_bytes(0, 0, 1, 0, 0, (0.0, 0.0, 0.0), HEIGHTS, [(1, 2, 3, 4)]) + K.chunk("MTEX", b"a\0b\0")[:-2]
    rows = K.chunk_table(files(spark, a=raw)).orderBy("number").collect()
    assert [(r.tag, r.size, r.parent) for r in rows] == [("MVER", 4, None), ("MCNK", 120 + 8 + 580 + 8 + 16, None), ("MCVT", 580, 1), ("MCLY", 16, 1), ("MTEX", 2, None)]
    assert rows[-1].error and not any(r.error for r in rows[:-1])


def test_placements_with_names(spark):
    model = lambda name, unique: struct.pack(K.MODEL_PLACE, name, unique, 1, 2, 3, 4, 5, 6, 1024, 7)
    building = struct.pack(K.BUILDING_PLACE, 0, 55, *range(12), 9, 8, 7, 6)
    raw = K.place_bytes(["tree.m2", "rock.m2"], [model(1, 10), model(5, 11)], ("MMDX", "MMID", "MDDF")) + K.place_bytes(["inn.wmo"], [building, b"rest"], ("MWMO", "MWID", "MODF"))
    rows = K.read_placements(files(spark, t=raw, empty=b"")).collect()
    assert [(r.kind, r.number, r.file, r.unique_id, r.scale, r.flags, r.error is None) for r in rows] == [
        ("model", 0, "rock.m2", 10, 1024, 7, True), ("model", 1, None, 11, 1024, 7, False), ("building", 0, "inn.wmo", 55, 6, 9, True), ("building", None, None, None, None, None, False),
    ]
    assert (rows[0].x, rows[0].rz, rows[2].x, rows[2].rz) == (1.0, 6.0, 0.0, 5.0)


def test_building_groups_and_model_hulls(spark):
    points, corners = struct.pack("<9f", *range(9)), struct.pack("<3H", 0, 1, 2)
    group = K.chunk("MOGP", bytes(K.GROUP_HEADER) + K.chunk("MOPY", b"\x04\x09") + K.chunk("MOVI", corners) + K.chunk("MOVT", points))
    wrong = K.chunk("MOGP", bytes(K.GROUP_HEADER) + K.chunk("MOVI", struct.pack("<3H", 0, 1, 9)) + K.chunk("MOVT", points))
    found = {r.path: r for r in K.read_building_groups(files(spark, good=K.chunk("MVER", b"1234") + group, wrong=wrong, none=b"abc", cut=group[:-3])).collect()}
    assert [tuple(t) for t in found["good"].triangles] == [(0, 1, 2, 4, 9)] and found["good"].vertices[2].z == 8.0
    assert found["wrong"].error and found["none"].error == "no group" and found["cut"].error
    hull = lambda radius, n: b"MD20" + bytes(K.HULL_AT - 4) + struct.pack("<f6I", radius, 3, 300, n, 240, 1, 310)
    model = hull(1.0, 3).ljust(240, b"\0") + points.ljust(60, b"\0") + corners
    models = {r.path: r for r in K.read_model_hulls(files(spark, good=model, flat=hull(0.0, 3), cut=hull(1.0, 3), few=hull(1.0, 2).ljust(240, b"\0") + points.ljust(60, b"\0") + corners, other=b"MD21" + bytes(500))).collect()}
    assert [tuple(t) for t in models["good"].triangles] == [(0, 1, 2, 0, 0)] and models["good"].vertices[1].x == 3.0
    assert models["flat"].vertices == [] and models["flat"].error is None and models["cut"].error and models["few"].error and models["other"].error == "no model"
