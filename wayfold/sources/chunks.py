"""Readers of chunked binary files: terrain tiles, placements, building groups and model hulls.

A file is a row of chunks: a tag of four letters, stored backwards, a size, and as many bytes; a terrain chunk has further chunks in it, at places that its header names. Readers take a table of files
(path, content), as Spark's binaryFile source gives, and make typed rows, a file at a time on the executors. What is damaged is a row with an error, and what stands before it is kept: a chunk that is longer than
what is left, a part that lies outside its chunk or is too short for what it holds, a file that isn't one of its kind.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .navmesh import _parsed

# Sizes of the records, and places in the header of a terrain chunk and of a model, from their first byte.
HEAD, LAYER, MODEL_PLACE, BUILDING_PLACE = "<4sI", "<4I", "<2I6f2H", "<2I12f4H"
HEAD_BYTES, LAYER_BYTES = struct.calcsize(HEAD), struct.calcsize(LAYER)
HEIGHTS, CHUNK_HEADER = 145, 128
TERRAIN = {"flags": 0x08, "cx": 0x0C, "cy": 0x10, "n_layers": 0x14, "heights": 0x1C, "layers": 0x24, "area_id": 0x3C, "liquid": 0x68, "liquid_size": 0x6C}
HOLES_AT, POSITION_AT, PREDOMINANT_AT = 0x44, 0x70, 0x48
GROUP_HEADER = 68
HULL_AT = 0xD4
LIQUID_BYTES, LIQUID_SIDE = 8 + 81 * 8 + 64, 9

CHUNKS = "path string, number int, tag string, at long, size long, parent int, error string"
TERRAIN_ROW = (
    "path string, cx int, cy int, flags long, area_id long, holes int, x double, y double, z double, predominant binary, heights array<double>, "
    "layers array<struct<texture_id:long,flags:long,offset:long,effect_id:long>>, liquid struct<low:double,high:double,heights:array<double>,tiles:array<int>>, error string"
)
PLACE_ROW = "path string, kind string, number int, file string, unique_id long, x double, y double, z double, rx double, ry double, rz double, scale int, flags int, error string"
MESH_ROW = "path string, vertices array<struct<x:double,y:double,z:double>>, triangles array<struct<a:int,b:int,c:int,flags:int,material:int>>, error string"


def walk(raw: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, str | None]]:
    """(tag, place of its bytes, size, error) of each chunk between two places. A chunk beyond the end is the last, with an error; so is a rest that is no head."""
    end = len(raw) if end is None else end
    while start < end:
        if end - start < HEAD_BYTES:
            yield "", start, end - start, "cut in a head"
            return
        tag, size = struct.unpack_from(HEAD, raw, start)
        name, at = tag[::-1].decode("latin-1"), start + HEAD_BYTES
        if size > end - at:
            yield name, at, end - at, f"{size} bytes declared, {end - at} left"
            return
        yield name, at, size, None
        start = at + size


def chunk_table(files: DataFrame) -> DataFrame:
    """A row for each chunk of each file, terrain chunks' inner ones included, which name their parent's number."""

    def parse(path: str, raw: bytes) -> Iterator[dict]:
        number = 0
        for tag, at, size, error in walk(raw):
            mine = number
            yield {"path": path, "number": mine, "tag": tag, "at": at, "size": size, "parent": None, "error": error}
            number += 1
            if tag == "MCNK" and error is None and size >= CHUNK_HEADER - HEAD_BYTES:
                for inner, place, length, wrong in walk(raw, at + CHUNK_HEADER - HEAD_BYTES, at + size):
                    yield {"path": path, "number": number, "tag": inner, "at": place, "size": length, "parent": mine, "error": wrong}
                    number += 1

    return _parsed(files, parse, CHUNKS)


def _part(raw: bytes, start: int, end: int, offset: int, tag: str, least: int) -> int | None:
    """Where the bytes of the part at `offset` begin; None for no offset; an error if it isn't a chunk of that tag with `least` bytes inside its parent."""
    if not offset:
        return None
    at = start + offset + HEAD_BYTES
    if at > end or raw[at - HEAD_BYTES : at - 4][::-1] != tag.encode() or at + least > end:
        raise ValueError(f"{tag} at {offset} lies outside or isn't one")
    return at


def _terrain(path: str, raw: bytes, start: int, end: int) -> dict:
    if end - start < CHUNK_HEADER:
        raise ValueError("short header")
    field = {name: struct.unpack_from("<I", raw, start + at)[0] for name, at in TERRAIN.items()}
    row = {"path": path, **{k: field[k] for k in ("cx", "cy", "flags", "area_id")}, "holes": struct.unpack_from("<H", raw, start + HOLES_AT)[0]}
    row |= dict(zip("xyz", struct.unpack_from("<3f", raw, start + POSITION_AT), strict=True))
    row["predominant"] = raw[start + PREDOMINANT_AT : start + PREDOMINANT_AT + 16]
    at = _part(raw, start, end, field["heights"], "MCVT", 4 * HEIGHTS)
    row["heights"] = None if at is None else list(struct.unpack_from(f"<{HEIGHTS}f", raw, at))
    at = _part(raw, start, end, field["layers"], "MCLY", LAYER_BYTES * field["n_layers"])
    layers = [] if at is None else [struct.unpack_from(LAYER, raw, at + LAYER_BYTES * i) for i in range(field["n_layers"])]
    row["layers"] = [dict(zip(("texture_id", "flags", "offset", "effect_id"), x, strict=True)) for x in layers]
    # the size counts the part's own head
    if field["liquid_size"] > HEAD_BYTES and (at := _part(raw, start, end, field["liquid"], "MCLQ", LIQUID_BYTES)) is not None:
        low, high = struct.unpack_from("<2f", raw, at)
        row["liquid"] = {"low": low, "high": high, "heights": [struct.unpack_from("<f", raw, at + 12 + 8 * i)[0] for i in range(LIQUID_SIDE**2)], "tiles": list(raw[at + LIQUID_BYTES - 64 : at + LIQUID_BYTES])}
    return row


def read_terrain(files: DataFrame) -> DataFrame:
    """A row for each terrain chunk of each tile file: its header's fields, 145 heights over its position, texture layers, and the liquid of old files; a chunk that can't be read has its error alone."""

    def parse(path: str, raw: bytes) -> Iterator[dict]:
        for tag, at, size, error in walk(raw):
            if error:
                yield {"path": path, "error": error}
            elif tag == "MCNK":
                try:
                    yield _terrain(path, raw, at - HEAD_BYTES, at + size)
                except (ValueError, struct.error) as wrong:
                    yield {"path": path, "error": str(wrong)}

    return _parsed(files, parse, TERRAIN_ROW)


def _name(names: bytes, offsets: bytes, number: int) -> str:
    (at,) = struct.unpack_from("<I", offsets, 4 * number)
    if at >= len(names):
        raise ValueError(f"name {number} lies outside")
    return names[at:].split(b"\0", 1)[0].decode("utf-8", "replace")


def read_placements(files: DataFrame) -> DataFrame:
    """A row for each model (kind model) and building (kind building) that a tile file places, with its file's name."""
    kinds = (("model", "MMDX", "MMID", "MDDF", MODEL_PLACE), ("building", "MWMO", "MWID", "MODF", BUILDING_PLACE))

    def parse(path: str, raw: bytes) -> Iterator[dict]:
        found: dict[str, bytes] = {}
        for tag, at, size, error in walk(raw):
            if error:
                yield {"path": path, "error": error}
            else:
                found.setdefault(tag, raw[at : at + size])
        for kind, names, offsets, places, record in kinds:
            body, step = found.get(places, b""), struct.calcsize(record)
            for number in range(len(body) // step):
                name, unique, x, y, z, rx, ry, rz, *rest = struct.unpack_from(record, body, step * number)
                row = {"path": path, "kind": kind, "number": number, "unique_id": unique, "x": x, "y": y, "z": z, "rx": rx, "ry": ry, "rz": rz}
                row |= {"scale": rest[0], "flags": rest[1]} if kind == "model" else {"scale": rest[9], "flags": rest[6]}
                try:
                    yield row | {"file": _name(found.get(names, b""), found.get(offsets, b""), name)}
                except (ValueError, struct.error) as wrong:
                    yield row | {"error": str(wrong)}
            if len(body) % step:
                yield {"path": path, "kind": kind, "error": f"{len(body) % step} bytes after the last place"}

    return _parsed(files, parse, PLACE_ROW)


def _points(raw: bytes, at: int, count: int) -> list[dict]:
    values = struct.unpack_from(f"<{3 * count}f", raw, at)
    return [dict(zip("xyz", values[i : i + 3], strict=True)) for i in range(0, len(values), 3)]


def _mesh_reader(files: DataFrame, read: Callable[[bytes], tuple[list[dict], list[tuple]]]) -> DataFrame:
    def parse(path: str, raw: bytes) -> Iterator[dict]:
        try:
            vertices, triangles = read(raw)
            if any(i >= len(vertices) for t in triangles for i in t[:3]):
                raise ValueError("a triangle names a vertex that isn't there")
            yield {"path": path, "vertices": vertices, "triangles": [dict(zip(("a", "b", "c", "flags", "material"), t, strict=True)) for t in triangles]}
        except (ValueError, struct.error) as wrong:
            yield {"path": path, "error": str(wrong)}

    return _parsed(files, parse, MESH_ROW)


def read_building_groups(files: DataFrame) -> DataFrame:
    """A row for each building group file: vertices, and triangles with their flags and material."""

    def read(raw: bytes) -> tuple[list[dict], list[tuple]]:
        group = next(((at, size) for tag, at, size, error in walk(raw) if tag == "MOGP" and not error), None)
        if group is None:
            raise ValueError("no group")
        parts = {}
        for tag, at, size, error in walk(raw, group[0] + GROUP_HEADER, sum(group)):
            if error:
                raise ValueError(f"{tag}: {error}")
            parts.setdefault(tag, raw[at : at + size])
        points, corners, kinds = (parts.get(t, b"") for t in ("MOVT", "MOVI", "MOPY"))
        numbers = struct.unpack(f"<{len(corners) // 2}H", corners)
        triangles = [(*numbers[3 * i : 3 * i + 3], *(kinds[2 * i : 2 * i + 2] if len(kinds) >= 2 * i + 2 else (0, 0))) for i in range(len(numbers) // 3)]
        return _points(points, 0, len(points) // 12), triangles

    return _mesh_reader(files, read)


def read_model_hulls(files: DataFrame) -> DataFrame:
    """A row for each model file: the vertices and triangles of its hull; a model without a hull, or of no size, has neither."""

    def read(raw: bytes) -> tuple[list[dict], list[tuple]]:
        if raw[:4] != b"MD20":
            raise ValueError("no model")
        radius, n_corners, corners_at, n_points, points_at, _, normals_at = struct.unpack_from("<f6I", raw, HULL_AT)
        if radius <= 0 or not (corners_at and points_at and normals_at):
            return [], []
        numbers = struct.unpack_from(f"<{n_corners}H", raw, corners_at)
        return _points(raw, points_at, n_points), [(*numbers[i : i + 3], 0, 0) for i in range(0, n_corners - 2, 3)]

    return _mesh_reader(files, read)


def of_kind(spark, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files below `path` whose names have the pattern."""
    from .navmesh import _files

    return _files(spark, path, pattern).select("path", "content")


# --- writers, for tests and synthetic tiles


def chunk(tag: str, body: bytes) -> bytes:
    return struct.pack(HEAD, tag.encode()[::-1], len(body)) + body


def terrain_bytes(cx: int, cy: int, area_id: int, flags: int, holes: int, place: tuple[float, float, float], heights: list[float] | None, layers: list[tuple] = (), liquid: tuple | None = None, predominant: bytes = bytes(16)) -> bytes:
    """A terrain chunk; liquid is (low, high, 81 heights, 64 tiles)."""
    body, offsets = b"", {}
    parts = [("heights", "MCVT", struct.pack(f"<{HEIGHTS}f", *heights) if heights else None), ("layers", "MCLY", b"".join(struct.pack(LAYER, *x) for x in layers) if layers else None)]
    if liquid:
        low, high, levels, tiles = liquid
        parts.append(("liquid", "MCLQ", struct.pack("<2f", low, high) + b"".join(struct.pack("<4xf", h) for h in levels) + bytes(tiles)))
    for name, tag, data in parts:
        if data is not None:
            offsets[name] = CHUNK_HEADER + len(body)
            body += chunk(tag, data)
    head = bytearray(CHUNK_HEADER)
    for name, value in {"flags": flags, "cx": cx, "cy": cy, "n_layers": len(layers), "area_id": area_id, "liquid_size": HEAD_BYTES + LIQUID_BYTES if liquid else 0, **offsets}.items():
        struct.pack_into("<I", head, TERRAIN[name], value)
    struct.pack_into("<H", head, HOLES_AT, holes)
    struct.pack_into("<3f", head, POSITION_AT, *place)
    head[PREDOMINANT_AT : PREDOMINANT_AT + 16] = predominant
    struct.pack_into(HEAD, head, 0, b"KNCM", CHUNK_HEADER + len(body) - HEAD_BYTES)
    return bytes(head) + body


def place_bytes(names: list[str], records: list[bytes], tags: tuple[str, str, str]) -> bytes:
    """The three chunks of placements: names, their offsets, and the records."""
    heap, offsets = b"", []
    for name in names:
        offsets.append(len(heap))
        heap += name.encode() + b"\0"
    return chunk(tags[0], heap) + chunk(tags[1], struct.pack(f"<{len(offsets)}I", *offsets)) + chunk(tags[2], b"".join(records))


def old_liquid_quads(terrain: DataFrame, unit: float = 533.33333 / 128) -> DataFrame:
    """(path, cx, cy, row, col, kind, x, y, nw, ne, sw, se): the quads of the liquid of old files (read_terrain), x and y of their north-west corner, heights of the four. The chunk's flags say whether
    there is one and of which kind, the later of ocean, magma and slime missing, water; cells that aren't drawn have none."""
    # Flags of liquid, and the mark of a cell that isn't drawn.
    kind = F.when(F.col("flags").bitwiseAND(0x08) != 0, "ocean").when(F.col("flags").bitwiseAND(0x10) != 0, "magma").when(F.col("flags").bitwiseAND(0x20) != 0, "slime").otherwise("water")
    wet = terrain.filter(F.col("liquid").isNotNull() & (F.col("flags").bitwiseAND(0x3C) != 0)).withColumn("kind", kind)
    cells = wet.select("path", "cx", "cy", "kind", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("liquid.heights").alias("h"), F.posexplode("liquid.tiles").alias("i", "tile"))
    cells = cells.filter(F.col("tile").bitwiseAND(0x0F) != 0x0F).withColumns({"row": F.floor(F.col("i") / 8).cast("int"), "col": F.col("i") % 8})
    at = F.col("row") * LIQUID_SIDE + F.col("col")
    corner = {"nw": 0, "ne": 1, "sw": LIQUID_SIDE, "se": LIQUID_SIDE + 1}
    return cells.select("path", "cx", "cy", "row", "col", "kind", (F.col("x0") - F.col("row") * unit).alias("x"), (F.col("y0") - F.col("col") * unit).alias("y"), *(F.get("h", at + d).alias(n) for n, d in corner.items()))
