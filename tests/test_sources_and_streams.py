"""Binary sources, streams, and the driver's entry points."""

import struct

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from wayfold.operators import meshes
from wayfold.sources import navmesh
from wayfold.streaming import requests


def square(x, z, nei=(0, 0, 0, 0), area=1):
    return {"flags": 4, "area": area, "nei": list(nei), "x": [x, x, x + 1, x + 1], "y": [0.5] * 4, "z": [z, z + 1, z + 1, z]}


def two_tiles():
    # two squares in tile 0, 0 and one beyond the border in tile 1, 0
    left = navmesh.tile_bytes(0, 0, [square(0.0, 0.0, (0, 0, 2, 0)), square(1.0, 0.0, (1, 0, 0x8000, 0))])
    right = navmesh.tile_bytes(1, 0, [square(2.0, 0.0, (0x8004, 0, 0, 0), 16)])
    return {(0, 0): left, (1, 0): right}


def test_anp_round_trip(spark, tmp_path):
    rows = [(7, x, y, d) for (x, y), d in two_tiles().items()] + [(7, 5, 5, b"not a tile")]
    packed = navmesh.pack_anp(spark.createDataFrame(rows, "map_id int, tile_x int, tile_y int, data binary"), (0.0, 0.0, 0.0, 2.0, 2.0, 4096, 1)).collect()
    assert [r.name for r in packed] == ["007.anp"]
    (tmp_path / "007.anp").write_bytes(packed[0].content)
    (tmp_path / "008.anp").write_bytes(b"broken")
    tiles = navmesh.read_anp(spark, str(tmp_path))
    assert sorted((r.map_id, r.tile_x, r.tile_y, len(r.polys)) for r in tiles.collect()) == [(7, 0, 0, 2), (7, 1, 0, 1)]
    edges = navmesh.polygon_edges(tiles)
    inner = meshes.internal_links(edges).collect()
    assert len(inner) == 2
    links = meshes.border_links(edges, 1.2).collect()
    assert len(links) == 2 and {(r.bmin, r.bmax) for r in links} == {(0, 255)}
    assert {r.area for r in edges.collect()} == {1, 16}


def test_short_tiles_are_left_out():
    tile = two_tiles()[0, 0]
    assert navmesh.parse_tile(tile[:-1]) is None and navmesh.parse_tile(b"") is None
    assert navmesh.parse_tile(b"\0" * 200) is None
    polys = navmesh.parse_tile(tile)["polys"]
    assert polys[1]["x"] == [1.0, 1.0, 2.0, 2.0] and polys[0]["area"] == 1


def test_mmap_files(spark, tmp_path):
    tile = two_tiles()[0, 0]
    (tmp_path / "0002727.mmtile").write_bytes(navmesh.mmtile_bytes(tile))
    (tmp_path / "0002728.mmtile").write_bytes(navmesh.mmtile_bytes(tile)[:-3])
    (tmp_path / "0002729.mmtile").write_bytes(struct.pack("<4I4b", navmesh.MMAP_MAGIC, 7, 14, len(tile), 1, 0, 0, 0) + tile)
    names = spark.createDataFrame([(p.name,) for p in tmp_path.iterdir()], "path string")
    assert navmesh.detect_mmap(names).first().format == "335a"
    assert navmesh.detect_mmap(names.limit(0)).count() == 0
    got = navmesh.read_mmap(spark, str(tmp_path), "335a").collect()
    assert [(r.map_id, len(r.polys)) for r in got] == [(0, 2)]


def test_tables_and_grids(spark, tmp_path):
    (tmp_path / "Map.dbc").write_bytes(navmesh.dbc_bytes([(0, "Azeroth"), (1, "Kalimdor")], "is"))
    (tmp_path / "bad.dbc").write_bytes(b"XXXX")
    assert sorted((r.id, r.name) for r in navmesh.read_dbc(spark, str(tmp_path), navmesh.MAP_FIELDS).collect()) == [(0, "Azeroth"), (1, "Kalimdor")]
    cells = [0] * (64 * 64 * 2)
    cells[2 * (3 * 64 + 5)] = 1
    (tmp_path / "World.wdt").write_bytes(b"\0" * 60 + struct.pack(f"<{len(cells)}I", *cells))
    assert [(r.name, r.x, r.y) for r in navmesh.read_wdt(spark, str(tmp_path)).collect()] == [("World", 5, 3)]
    table = spark.createDataFrame([(1, 0, 8, 2), (2, 1, 0, 4), (3, 1, 0, 6)], "id int, parent int, flags int, faction_mask int")
    assert [r.faction for r in navmesh.area_factions(table).orderBy("id").collect()] == [1, 2, 0]


def test_obj_lines(spark):
    verts = spark.createDataFrame([(0, 5, 0.0, 0.0, 0.0), (0, 9, 1.0, 0.0, 0.0), (0, 7, 0.0, 0.0, 1.0)], "tile long, vid long, x double, y double, z double")
    tris = spark.createDataFrame([(0, 0, 5, 7, 9, 1)], "tile long, tid long, a long, b long, c long, area int")
    assert [r.line for r in navmesh.to_obj(verts, tris).orderBy("line_no").collect()] == ["v 0.0 0.0 0.0", "v 0.0 0.0 1.0", "v 1.0 0.0 0.0", "f 1 2 3"]


def test_filter_stream(spark, tmp_path):
    schema = "client_id long, seq long, area int, cost double"
    spark.createDataFrame([(1, 1, 4, 2.0), (1, 3, 4, 5.0), (2, 1, 7, 9.0)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = requests.client_costs(stream).writeStream.outputMode("complete").format("memory").queryName("costs").start()
    query.processAllAvailable()
    spark.createDataFrame([(1, 2, 4, 3.0), (2, 2, 7, 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert {(r.client_id, r.area, r.cost) for r in spark.table("costs").collect()} == {(1, 4, 5.0), (2, 7, 1.0)}


def test_answers_by_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = requests.answer(stream, lambda b: b.withColumn("twice", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("twice")).first()[0] == 20


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["mark_areas", "nearest_poly", "ext_links", "catmull_rom", "ledge_filter", "cast_ray"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got = entry.queries()[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))
