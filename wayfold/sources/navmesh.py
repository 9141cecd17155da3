"""Binary sources: mesh tiles (bare, in .mmtile files, in .anp archives), fixed-width tables and map grids.

Files are read by Spark's binaryFile source, so from any file system, and parsed in Arrow batches; a file that isn't what its reader takes
is left out, as is a tile that is shorter than its header says. The canonical store is Parquet.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats.
TILE_MAGIC, TILE_VERSION = int.from_bytes(b"DNAV", "big"), 7
MMAP_MAGIC, MMAP_VERSION = 0x4D4D4150, 15
TILE_HEADER = struct.Struct("<15i10f")
MMAP_HEADER = struct.Struct("<4I4b")
PARAMS = struct.Struct("<5f2i")
POLY = struct.Struct("<I6H6HHBB")
SIZES = {"verts": 12, "polys": POLY.size, "links": 16, "detail_meshes": 12, "detail_verts": 12, "detail_tris": 4, "bv_nodes": 16, "off_mesh": 36}
#: File names of two server generations: map number, tile x and y.
MMAP_NAMES = {"335a": r"(?:^|/)(\d{3})(\d{2})(\d{2})\.mmtile$", "548": r"(?:^|/)(\d{4})_(\d{2})_(\d{2})\.mmtile$"}
BORDER = 0x8000

TILE = (
    "map_id int, tile_x int, tile_y int, layer int, walk_height double, walk_radius double, walk_climb double, bmin array<double>, bmax array<double>, "
    "polys array<struct<idx:int,flags:int,area:int,type:int,nei:array<int>,x:array<double>,y:array<double>,z:array<double>>>"
)


def parse_tile(data: bytes) -> dict | None:
    """A tile's header and polygons, corners with their coordinates; None for bytes that are no whole tile."""
    if len(data) < TILE_HEADER.size:
        return None
    h = TILE_HEADER.unpack_from(data)
    if h[0] != TILE_MAGIC or h[1] != TILE_VERSION:
        return None
    counts = dict(zip(("polys", "verts", "links", "detail_meshes", "detail_verts", "detail_tris", "bv_nodes", "off_mesh"), h[6:14], strict=True))
    at, starts = TILE_HEADER.size, {}
    for part, size in SIZES.items():
        starts[part] = at
        at += -(-size * counts[part] // 4) * 4
    if min(counts.values()) < 0 or at > len(data):
        return None
    verts = struct.unpack_from(f"<{3 * counts['verts']}f", data, starts["verts"])
    polys = []
    for i in range(counts["polys"]):
        _, *fields = POLY.unpack_from(data, starts["polys"] + i * POLY.size)
        corners, nei, (flags, n, kind) = fields[:6], fields[6:12], fields[12:]
        at_corner = [verts[3 * c : 3 * c + 3] for c in corners[:n]]
        polys.append({"idx": i, "flags": flags, "area": kind & 63, "type": kind >> 6, "nei": list(nei[:n]), **{v: [p[k] for p in at_corner] for k, v in enumerate("xyz")}})
    return {"tile_x": h[2], "tile_y": h[3], "layer": h[4], "walk_height": h[15], "walk_radius": h[16], "walk_climb": h[17], "bmin": list(h[18:21]), "bmax": list(h[21:24]), "polys": polys}


def tile_bytes(x: int, y: int, polys: list[dict], climb: float = 1.2, layer: int = 0) -> bytes:
    """A tile of the given polygons (flags, area, nei and corners x, y, z each), without links, details or boxes."""
    verts: dict[tuple, int] = {}
    rows = []
    for p in polys:
        corners = [verts.setdefault(c, len(verts)) for c in zip(p["x"], p["y"], p["z"], strict=True)]
        n = len(corners)
        rows.append(POLY.pack(0xFFFFFFFF, *(corners + [0] * (6 - n)), *(list(p["nei"]) + [0] * (6 - n)), p["flags"], n, p["area"] & 63))
    low, high = ([f(v[k] for v in verts) for k in range(3)] if verts else [0.0] * 3 for f in (min, max))
    head = TILE_HEADER.pack(TILE_MAGIC, TILE_VERSION, x, y, layer, 0, len(rows), len(verts), 0, 0, 0, 0, 0, 0, len(rows), 2.0, 0.6, climb, *low, *high, 0.0)
    return head + b"".join(struct.pack("<3f", *v) for v in verts) + b"".join(rows)


def mmtile_bytes(tile: bytes) -> bytes:
    return MMAP_HEADER.pack(MMAP_MAGIC, TILE_VERSION, MMAP_VERSION, len(tile), 1, 0, 0, 0) + tile


def parse_mmtile(data: bytes) -> dict | None:
    if len(data) < MMAP_HEADER.size:
        return None
    magic, _, version, size, *_ = MMAP_HEADER.unpack_from(data)
    body = data[MMAP_HEADER.size : MMAP_HEADER.size + size]
    return parse_tile(body) if magic == MMAP_MAGIC and version >= MMAP_VERSION and len(body) == size else None


def anp_bytes(map_id: int, params: tuple, tiles: dict[tuple[int, int], bytes]) -> bytes:
    """An archive of a map's tiles, at most 64 x 64."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [("mapId", struct.pack("<i", map_id)), ("params", PARAMS.pack(*params)), *((f"{x:02d}_{y:02d}", b) for (x, y), b in sorted(tiles.items()))]:
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def parse_anp(data: bytes) -> Iterator[dict]:
    """The tiles of an archive with its map number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if not {"mapId", "params"} <= names:
            return
        (map_id,) = struct.unpack("<i", z.read("mapId"))
        for name in sorted(names - {"mapId", "params"}):
            if (tile := parse_tile(z.read(name))) is not None:
                yield {"map_id": map_id, **tile}


def _parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of dictionaries from (path, content), a batch for each file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(parse(path, content))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_anp(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of all .anp archives below `path`."""

    def parse(_: str, content: bytes) -> Iterator[dict]:
        return parse_anp(content) if zipfile.is_zipfile(io.BytesIO(content)) else iter(())

    return _parsed(_files(spark, path, "*.anp"), parse, TILE)


def pack_anp(tiles: DataFrame, params: tuple) -> DataFrame:
    """(name, content): an archive for each map of `tiles` (map_id, tile_x, tile_y, data). A map has at most 4096 tiles."""

    def pack(pdf):
        import pandas as pd

        found = {(int(r.tile_x), int(r.tile_y)): bytes(r.data) for r in pdf.itertuples()}
        map_id = int(pdf.map_id.iloc[0])
        return pd.DataFrame({"name": [f"{map_id:03d}.anp"], "content": [anp_bytes(map_id, params, found)]})

    return tiles.groupBy("map_id").applyInPandas(pack, "name string, content binary")


def detect_mmap(names: DataFrame) -> DataFrame:
    """(format) of a folder by its file names (path): the first generation that has the probe tile 27, 27 of map 0; no row if neither."""
    found = [names.filter(F.col("path").rlike(p)).filter((F.regexp_extract("path", p, 1).cast("int") == 0) & (F.regexp_extract("path", p, 2) == "27") & (F.regexp_extract("path", p, 3) == "27")).select(F.lit(k).alias("format"), F.lit(i).alias("n")) for i, (k, p) in enumerate(MMAP_NAMES.items())]
    return found[0].union(found[1]).groupBy().agg(F.min_by("format", "n").alias("format")).filter("format IS NOT NULL")


def read_mmap(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The tiles of all .mmtile files below `path` that have names of the given generation."""
    import re

    pattern = re.compile(MMAP_NAMES[kind])

    def parse(name: str, content: bytes) -> Iterator[dict]:
        m, tile = pattern.search(name), parse_mmtile(content)
        if m and tile is not None:
            yield {"map_id": int(m[1]), **tile}

    return _parsed(_files(spark, path, "*.mmtile"), parse, TILE)


def polygon_edges(tiles: DataFrame) -> DataFrame:
    """Tiles as the edge tables of operators.meshes: a ref holds map, tile and polygon; area and flags come along."""
    polys = tiles.select("map_id", "tile_x", "tile_y", F.explode("polys").alias("p")).filter("p.type = 0")
    base = F.shiftleft(F.shiftleft(F.col("map_id").cast("long"), 12) + F.col("tile_x") * 64 + F.col("tile_y"), 24)
    edges = polys.select("map_id", "tile_x", "tile_y", (base + F.col("p.idx")).alias("ref"), base.alias("base"), "p", F.posexplode("p.nei").alias("edge", "n"))
    after = (F.col("edge") + 1) % F.size("p.nei")
    nei = F.when(F.col("n") == 0, -1).when(F.col("n").bitwiseAND(BORDER) != 0, -2 - F.col("n").bitwiseAND(0xFF) / 2).otherwise(F.col("base") + F.col("n") - 1).cast("long")
    # border sides of tiles count 0 x+, 2 z+, 4 x-, 6 z-; edge tables count from x-
    nei = F.when(nei <= -2, -2 - F.element_at(F.array(*map(F.lit, (2, 1, 0, 3))), (-1 - nei).cast("int"))).otherwise(nei)
    corner = lambda i, v: F.element_at(F.col(f"p.{v}"), (i + 1).cast("int"))
    return edges.select("map_id", "tile_x", "tile_y", "ref", F.col("p.area").alias("area"), F.col("p.flags").alias("flags"), "edge", *(corner(i, v).alias(f"{n}{v}") for n, i in (("a", F.col("edge")), ("b", after)) for v in "xyz"), nei.alias("nei"))


# --- tables and grids


def read_dbc(spark: SparkSession, path: str, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """The records of .dbc files: `fields` names each column with its field number and kind (int, float or string)."""
    codes = {"int": "<i", "float": "<f", "string": "<I"}
    types = {"int": "int", "float": "double", "string": "string"}
    schema = ", ".join(f"{n} {types[k]}" for n, (_, k) in fields.items())

    def parse(_: str, content: bytes) -> Iterator[dict]:
        if len(content) < 20 or content[:4] != b"WDBC":
            return
        records, _, size, _ = struct.unpack_from("<4I", content, 4)
        heap = 20 + records * size
        for i in range(records):
            row = {}
            for name, (number, kind) in fields.items():
                (value,) = struct.unpack_from(codes[kind], content, 20 + i * size + 4 * number)
                row[name] = content[heap + value : content.index(b"\0", heap + value)].decode("utf-8", "replace") if kind == "string" else value
            yield row

    return _parsed(_files(spark, path, "*.dbc"), parse, schema)


def dbc_bytes(rows: list[tuple], kinds: str) -> bytes:
    """A .dbc file; kinds has a letter for each field: i, f or s."""
    heap, body = b"\0", b""
    for row in rows:
        for value, kind in zip(row, kinds, strict=True):
            if kind == "s":
                body += struct.pack("<I", len(heap))
                heap += value.encode() + b"\0"
            else:
                body += struct.pack(f"<{kind}", value)
    return b"WDBC" + struct.pack("<4I", len(rows), len(kinds), 4 * len(kinds), len(heap)) + body + heap


# Fields of the tables that the pipeline reads.
MAP_FIELDS = {"id": (0, "int"), "name": (1, "string")}
LIQUID_FIELDS = {"id": (0, "int"), "kind": (3, "int")}
AREA_FIELDS = {"id": (0, "int"), "parent": (2, "int"), "flags": (4, "int"), "faction_mask": (28, "int")}


def area_factions(table: DataFrame) -> DataFrame:
    """(id, parent, flags, faction) of an area table: mask 2 is alliance, 4 horde."""
    return table.select("id", "parent", "flags", F.when(F.col("faction_mask") == 2, 1).when(F.col("faction_mask") == 4, 2).otherwise(0).alias("faction"))


def read_wdt(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y) of the tiles that each .wdt file says there are; the grid is stored row by row, y first."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        start = 12 + 40 + 8
        if len(content) < start + 64 * 64 * 8:
            return
        cells = struct.unpack_from(f"<{64 * 64 * 2}I", content, start)
        for i in range(64 * 64):
            if cells[2 * i] & 1:
                yield {"name": name.rsplit("/", 1)[-1].removesuffix(".wdt"), "x": i % 64, "y": i // 64}

    return _parsed(_files(spark, path, "*.wdt"), parse, "name string, x int, y int")


def to_obj(verts: DataFrame, tris: DataFrame) -> DataFrame:
    """(tile, line_no, line): geometry as text, vertices first and faces counted from 1; order by tile and line_no to write."""
    from pyspark.sql import Window

    numbered = verts.withColumn("n", F.row_number().over(Window.partitionBy("tile").orderBy("vid")))
    lines = numbered.select("tile", F.col("n").cast("long").alias("line_no"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    faces = tris
    for c in "abc":
        faces = faces.join(numbered.select("tile", F.col("vid").alias(c), F.col("n").alias(f"{c}n")), ["tile", c])
    return lines.unionByName(faces.select("tile", (F.col("tid") + (1 << 40)).alias("line_no"), F.concat_ws(" ", F.lit("f"), "an", "bn", "cn").alias("line")))
