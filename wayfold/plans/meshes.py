"""Queries on geometry, mesh links and look-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import meshes as M
from ..operators import session as S
from . import world as W

Q = W.q_sql
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def geometry(spark, d):
    """Line items as vertices on a coarse lattice, and orders of three items and more as triangles of their first three."""
    items = W.table(spark, d, "lineitem")
    tile = (F.col("l_orderkey") % 16).alias("tile")
    vid = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vid")
    verts = items.select(tile, vid, (F.col("l_partkey") % 12).cast("double").alias("x"), (F.col("l_suppkey") % 5).cast("double").alias("y"), (F.col("l_linenumber") * 1.0).alias("z")).distinct()
    verts = verts.groupBy("tile", "vid").agg(*(F.min(v).alias(v) for v in "xyz"))
    has = items.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") <= 3, 1)).alias("n")).filter("n = 3")
    key = F.col("l_orderkey")
    tris = has.select((key % 16).alias("tile"), key.alias("tid"), *((key * 8 + i).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))), (1 + key % 27).cast("int").alias("area"))
    return verts, tris


GEOMETRY_SQL = """v AS (SELECT l_orderkey % 16 AS tile, l_orderkey * 8 + l_linenumber AS vid, min(CAST(l_partkey % 12 AS DOUBLE)) AS x, min(CAST(l_suppkey % 5 AS DOUBLE)) AS y, min(l_linenumber * 1.0::DOUBLE) AS z FROM lineitem GROUP BY ALL),
tr AS (SELECT l_orderkey % 16 AS tile, l_orderkey AS tid, l_orderkey * 8 + 1 AS a, l_orderkey * 8 + 2 AS b, l_orderkey * 8 + 3 AS c, CAST(1 + l_orderkey % 27 AS INT) AS area FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) GROUP BY l_orderkey HAVING count(*) = 3)"""
CLEAN_SQL = f"""{GEOMETRY_SQL}, used AS (SELECT tile, a AS vid FROM tr UNION SELECT tile, b FROM tr UNION SELECT tile, c FROM tr),
k AS (SELECT v.*, min(v.vid) OVER (PARTITION BY v.tile, x, y, z) AS keep FROM v JOIN used USING (tile, vid))"""


@query("vertex_dedup", f"WITH {CLEAN_SQL} SELECT DISTINCT tile, keep AS vid, x, y, z FROM k")
def vertex_dedup(spark, d):
    return M.clean(*geometry(spark, d))[0]


@query("tri_dedup", f"WITH {CLEAN_SQL} SELECT t.tile, min(tid) AS tid, ka.keep AS a, kb.keep AS b, kc.keep AS c, arg_min(area, tid) AS area FROM tr t JOIN k ka ON ka.tile = t.tile AND ka.vid = a JOIN k kb ON kb.tile = t.tile AND kb.vid = b JOIN k kc ON kc.tile = t.tile AND kc.vid = c GROUP BY t.tile, ka.keep, kb.keep, kc.keep")
def tri_dedup(spark, d):
    return M.clean(*geometry(spark, d))[1]


@query("clip_bounds", f"WITH {GEOMETRY_SQL}, kv AS (SELECT * FROM v WHERE x BETWEEN tile * 0.25 AND 10 AND y BETWEEN 0 AND 4 AND z BETWEEN 1 AND 7) SELECT tr.* FROM tr WHERE (SELECT count(*) FROM kv WHERE kv.tile = tr.tile AND kv.vid IN (a, b, c)) = 3")
def clip_bounds(spark, d):
    verts, tris = geometry(spark, d)
    bounds = spark.range(16).select(F.col("id").alias("tile"), (F.col("id") * 0.25).alias("minx"), F.lit(10.0).alias("maxx"), F.lit(0.0).alias("miny"), F.lit(4.0).alias("maxy"), F.lit(1.0).alias("minz"), F.lit(7.0).alias("maxz"))
    return M.clip(verts, tris, bounds)[1]


@query("geometry_append", f"WITH {GEOMETRY_SQL} SELECT tile, count(*) AS n, CAST(sum(vid) AS BIGINT) AS vids FROM (SELECT tile, vid FROM v UNION ALL SELECT tile + 16, vid FROM v) GROUP BY tile")
def geometry_append(spark, d):
    verts, _ = geometry(spark, d)
    return M.append([verts, verts.withColumn("tile", F.col("tile") + 16)]).groupBy("tile").agg(F.count("*").alias("n"), F.sum("vid").alias("vids"))


@query("geometry_bounds", f"WITH {GEOMETRY_SQL} SELECT tile, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, CAST(floor((max(x) - min(x)) / 0.3 + 0.5) AS BIGINT) AS width FROM v GROUP BY tile")
def geometry_bounds(spark, d):
    verts, _ = geometry(spark, d)
    out = verts.groupBy("tile").agg(*(f(v).alias(f"{n}_{v}") for v in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    return out.withColumn("width", F.floor((F.col("max_x") - F.col("min_x")) / 0.3 + 0.5))


@query(
    "quad_triangulate",
    """WITH c AS (SELECT p_partkey AS chunk, CAST(p_size * 1317 % 65536 AS INT) AS holes FROM part), i AS (SELECT chunk, holes, 2 * p + 1 AS row, k AS col, p * 17 + 9 + k AS i FROM c, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS k)),
    s AS (SELECT * FROM i WHERE (holes & (1 << CAST(col // 2 + 4 * (row // 4) AS INT))) = 0)
    SELECT chunk, count(*) * 4 AS tris, CAST(sum(4 * i) AS BIGINT) AS centres, CAST(sum((i - 9) + (i + 9) + (i - 8) + (i + 8)) AS BIGINT) AS corners FROM s GROUP BY chunk""",
)
def quad_triangulate(spark, d):
    chunks = W.table(spark, d, "part").select(F.col("p_partkey").alias("chunk"), (F.col("p_size") * 1317 % 65536).cast("int").alias("holes"))
    flat = chunks.select("chunk", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.transform(F.sequence(F.lit(0), F.lit(144)), lambda i: i.cast("double")).alias("heights"))
    tris = M.terrain_triangles(M.terrain_vertices(flat), chunks)
    return tris.groupBy("chunk").agg(F.count("*").alias("tris"), F.sum("b").cast("long").alias("centres"), F.sum("a").cast("long").alias("corners"))


@query("terrain_heights", f"SELECT p_partkey AS chunk, i, {Q('CAST(p_retailprice AS DOUBLE) + i * 0.25')} AS z FROM part, (SELECT unnest(range(145)) AS i)")
def terrain_heights(spark, d):
    chunks = W.table(spark, d, "part").select(F.col("p_partkey").alias("chunk"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_retailprice").alias("z"), F.transform(F.sequence(F.lit(0), F.lit(144)), lambda i: i * 0.25).alias("heights"))
    return M.terrain_vertices(chunks).select("chunk", F.col("i").cast("long").alias("i"), G.quantised(F.col("z")).alias("z"))


TREE_SQL = "a AS (SELECT p_partkey AS id, p_partkey // 3 AS parent, CASE WHEN p_size % 10 = 0 THEN 8 WHEN p_size % 10 = 5 THEN 32 ELSE 1 END AS flags, CASE WHEN p_partkey % 5 = 0 THEN CAST(1 + p_partkey % 2 AS INT) ELSE 0 END AS faction FROM part)"


@query(
    "ancestor_areas",
    f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id, id AS now, 0 AS depth FROM a UNION ALL SELECT up.id, a.parent, depth + 1 FROM up JOIN a ON a.id = up.now WHERE a.parent <> 0 AND a.parent <> a.id AND depth < 9),
    f AS (SELECT up.id, up.depth, a.faction, a.flags FROM up JOIN a ON a.id = up.now)
    SELECT a.id, coalesce((SELECT arg_min(f.faction, f.depth) FROM f WHERE f.id = a.id AND f.faction <> 0), 0) AS faction, EXISTS (SELECT 1 FROM f WHERE f.id = a.id AND (f.flags & 40) <> 0) AS city FROM a""",
)
def ancestor_areas(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    areas = W.table(spark, d, "part").select(key.alias("id"), F.floor(key / 3).alias("parent"), F.when(size % 10 == 0, 8).when(size % 10 == 5, 32).otherwise(1).alias("flags"), F.when(key % 5 == 0, (1 + key % 2).cast("int")).otherwise(0).alias("faction"))
    return M.ancestors(areas)


@query("liquid_lookup", "WITH l(id, kind) AS (VALUES (3, 'ocean'), (7, 'magma'), (11, 'slime'), (13, 'water')) SELECT p_partkey, coalesce(kind, 'water') AS kind FROM part LEFT JOIN l ON l.id = p_size % 17")
def liquid_lookup(spark, d):
    kinds = spark.createDataFrame([(3, "ocean"), (7, "magma"), (11, "slime"), (13, "water")], "id int, kind string")
    return W.table(spark, d, "part").withColumn("id", F.col("p_size") % 17).join(F.broadcast(kinds), "id", "left").select("p_partkey", F.coalesce("kind", F.lit("water")).alias("kind"))


@query("area_semijoin", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def area_semijoin(spark, d):
    wanted = W.table(spark, d, "nation").filter(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("c_nationkey"))
    return W.table(spark, d, "customer").filter("c_nationkey <> 0").join(F.broadcast(wanted), "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("overlay_first_wins", "SELECT o_custkey AS file, arg_min(o_orderkey, (-length(o_orderstatus || o_orderpriority), o_orderkey)) AS source FROM orders GROUP BY o_custkey")
def overlay_first_wins(spark, d):
    files = W.table(spark, d, "orders").withColumn("depth", F.length(F.concat("o_orderstatus", "o_orderpriority")))
    return M.first_wins(files, F.col("o_custkey"), F.col("depth").desc(), F.col("o_orderkey")).select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("source"))


NEI_SQL = f"{W.GRID_SQL}, d(edge, dc, dr) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1))"


@query("internal_links", f"WITH {NEI_SQL} SELECT a.ref AS from_ref, b.ref AS to_ref, edge FROM g a, d JOIN g b ON b.c = a.c + dc AND b.r = a.r + dr")
def internal_links(spark, d):
    return M.internal_links(W.grid_edges(spark, d))


@query("mesh_adjacency", f"WITH {NEI_SQL} SELECT a.ref AS from_ref, b.ref AS to_ref, edge FROM g a, d JOIN g b ON b.c = a.c + dc AND b.r = a.r + dr")
def mesh_adjacency(spark, d):
    edges = W.grid_edges(spark, d)
    number = lambda p: (F.col(f"{p}x") * 6 + F.col(f"{p}z")).cast("int")
    return M.shared_edges(edges.withColumns({"va": number("a"), "vb": number("b")}))


@query("wall_edges", f"WITH {NEI_SQL} SELECT a.ref, edge FROM g a, d WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.c = a.c + dc AND b.r = a.r + dr)")
def wall_edges(spark, d):
    edges = W.grid_edges(spark, d)
    return M.wall_edges(edges, M.internal_links(edges)).select("ref", "edge")


def border_edges(spark, d):
    """Suppliers as two edges each on either side of a tile's border."""
    k = F.col("s_suppkey")
    base = W.table(spark, d, "supplier").select(k, (k % 4).alias("tx"), (F.floor(k / 4) % 3).alias("ty"), (k * 37 % 100 / 10.0).alias("lo"), (k * 37 % 100 / 10.0 + 1 + k % 3).alias("hi"), (F.col("s_acctbal") / 2000).alias("h"))

    def side(ref, tile_x, nei, line, shift, rise):
        h = F.col("h") + rise
        return base.select(ref.alias("ref"), F.lit(0).alias("edge"), tile_x.alias("tile_x"), F.col("ty").alias("tile_y"), F.lit(nei).alias("nei"), line.alias("ax"), h.alias("ay"), (F.col("lo") + shift).alias("az"), line.alias("bx"), h.alias("by"), (F.col("hi") + shift).alias("bz"))

    return side(k * 2, F.col("tx"), -4, F.col("tx") * 10.0 + 10, 0.0, 0.0).unionByName(side(k * 2 + 1, F.col("tx") + 1, -2, F.col("tx") * 10.0 + 10.004, 0.5, 0.3))


BORDER_SQL = """bp AS (SELECT s_suppkey AS k, CAST(s_suppkey % 4 AS BIGINT) AS tx, CAST(s_suppkey // 4 % 3 AS BIGINT) AS ty, (s_suppkey * 37 % 100) / 10.0::DOUBLE AS lo, (s_suppkey * 37 % 100) / 10.0::DOUBLE + 1 + s_suppkey % 3 AS hi, s_acctbal / 2000 AS h FROM supplier),
e AS (SELECT k * 2 AS ref, tx, ty, 2 AS side, tx * 10.0 + 10 AS line, lo, hi, h FROM bp UNION ALL SELECT k * 2 + 1, tx + 1, ty, 0, tx * 10.0 + 10.004, lo + 0.5, hi + 0.5, h + 0.3 FROM bp)"""


BORDER_LINKS_SQL = """j AS (SELECT a.ref AS from_ref, b.ref AS to_ref, a.lo AS alo, a.hi AS ahi, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM e a JOIN e b ON b.ty = a.ty AND b.tx = a.tx + CASE a.side WHEN 2 THEN 1 ELSE -1 END AND b.side = (a.side + 2) % 4
      WHERE abs(a.line - b.line) <= 0.01 AND greatest(a.lo, b.lo) + 0.01 <= least(a.hi, b.hi) - 0.01 AND abs(a.h - b.h) <= 2.4),
bl AS (SELECT from_ref, to_ref, CAST(0 AS INT) AS edge, CAST(floor((lo - alo) / (ahi - alo) * 255 + 0.5) AS INT) AS bmin, CAST(floor((hi - alo) / (ahi - alo) * 255 + 0.5) AS INT) AS bmax FROM j)"""


@query("ext_links", f"WITH {BORDER_SQL}, {BORDER_LINKS_SQL} SELECT * FROM bl")
def ext_links(spark, d):
    return M.border_links(border_edges(spark, d), 1.2)


@query("border_snap", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey % 81 < 2 THEN 0 WHEN l_partkey % 81 > 78 THEN 80 ELSE l_partkey % 81 END AS BIGINT) AS x FROM lineitem")
def border_snap(spark, d):
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.snap_to_border(F.col("l_partkey") % 81, 80).cast("long").alias("x"))


@query("area_group_counts", "SELECT l_suppkey % 64 AS tile, CASE WHEN l_partkey % 64 = 63 THEN 1 ELSE l_partkey % 64 END AS area, count(*) AS n FROM lineitem WHERE l_partkey % 64 <> 0 GROUP BY ALL")
def area_group_counts(spark, d):
    return M.by_area(W.table(spark, d, "lineitem").select((F.col("l_suppkey") % 64).alias("tile"), (F.col("l_partkey") % 64).alias("area")))


ROADS = "road|cobblestone|flagstone|brick|paved"


@query("road_name_match", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{ROADS}|the')")
def road_name_match(spark, d):
    return W.table(spark, d, "documents").filter(F.lower("text").rlike(f"{ROADS}|the")).select("doc_id")


@query("config_table", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.DEFAULTS.items()) + ") AS t(key, value)")
def config_table(spark, d):
    return S.config_table(spark)


@query(
    "request_route",
    "SELECT event_id, op, CASE WHEN op IS NULL THEN 'unknown' WHEN op = 'EXPLORE_POLY' THEN 'unanswered' WHEN user_id % 40 < CASE op WHEN 'PATH' THEN 32 WHEN 'CAST_RAY' THEN 28 ELSE 0 END THEN 'short' ELSE 'ok' END AS status FROM (SELECT event_id, user_id, ["
    + ", ".join(f"'{v}'" for v in S.REQUEST_TYPES.values())
    + "][CAST(event_id % 12 + 1 AS INT)] AS op FROM events)",
)
def request_route(spark, d):
    events = W.table(spark, d, "events")
    routed = S.route(events, (F.col("event_id") % 12).cast("int"), F.col("user_id") % 40, {"PATH": 32, "CAST_RAY": 28})
    return routed.select("event_id", "op", "status")


@query("ref_codec", "SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT << 52) | ((l_suppkey % 2097152) << 31) | l_partkey AS ref, l_linenumber::BIGINT AS salt, l_suppkey % 2097152 AS tile, l_partkey AS poly FROM lineitem")
def ref_codec(spark, d):
    ref = G.encode_ref(F.col("l_linenumber"), F.col("l_suppkey") % 2097152, F.col("l_partkey"))
    rows = W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref")).withColumn("d", G.decode_ref(F.col("ref")))
    return rows.select("l_orderkey", "l_linenumber", "ref", "d.salt", "d.tile", "d.poly")


@query("valid_refs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def valid_refs(spark, d):
    parts = W.table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return W.table(spark, d, "lineitem").join(parts, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(
    "ref_validity",
    """WITH r AS (SELECT l_orderkey, l_linenumber, 1 + l_orderkey % 3 AS salt, l_suppkey % 2097152 AS tile, l_partkey AS poly FROM lineitem), t AS (SELECT s_suppkey AS tile, 1 + s_nationkey % 3 AS salt, CAST(abs(s_acctbal) AS BIGINT) AS polys FROM supplier WHERE s_nationkey <> 7)
    SELECT l_orderkey, l_linenumber, (salt::BIGINT << 52) | (tile << 31) | poly AS ref FROM r JOIN t USING (tile, salt) WHERE poly < polys""",
)
def ref_validity(spark, d):
    """Line items as refs into suppliers' tiles, of which some are gone, others were replaced since, and all have a number of polygons."""
    ref = G.encode_ref(1 + F.col("l_orderkey") % 3, F.col("l_suppkey") % 2097152, F.col("l_partkey"))
    refs = W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"))
    tiles = W.table(spark, d, "supplier").filter("s_nationkey <> 7").select(F.col("s_suppkey").alias("tile"), (1 + F.col("s_nationkey") % 3).alias("salt"), F.round(F.abs("s_acctbal")).cast("long").alias("polys"))
    return M.valid_refs(refs, tiles)


TEXTURES = ("Road", "Grass", "CobbleStone", "Dirt", "oldbrick", "Paved", "Rock", "FlagStone", "broad")


@query("texture_roads", f"SELECT p_partkey, name FROM (SELECT p_partkey, 'tileset/' || {list(TEXTURES)}[p_partkey % 9 + 1] || p_size || '.blp' AS name FROM part) WHERE regexp_matches(lower(name), '{ROADS}')")
def texture_roads(spark, d):
    """Textures that are roads by their names."""
    name = F.concat(F.lit("tileset/"), F.element_at(F.array(*map(F.lit, TEXTURES)), (F.col("p_partkey") % 9 + 1).cast("int")), F.col("p_size").cast("string"), F.lit(".blp"))
    return W.table(spark, d, "part").select("p_partkey", name.alias("name")).filter(F.lower("name").rlike(ROADS))


@query("seg_intersect", f"""WITH {W.CORNERS_SQL}, s AS (SELECT o_orderkey, bx - ax AS ux, bz - az AS uz, 50 - cx AS vx, 40 - cz AS vz, ax - cx AS wx, az - cz AS wz FROM t), e AS (SELECT *, ux * vz - uz * vx AS det FROM s)
    SELECT o_orderkey, {Q("(vx * wz - vz * wx) / det")} AS s, {Q("(ux * wz - uz * wx) / det")} AS t FROM e WHERE abs(det) >= 1e-6""")
def seg_intersect(spark, d):
    s, t = G.segment_meeting((F.col("ax"), F.col("az")), (F.col("bx"), F.col("bz")), (F.col("cx"), F.col("cz")), (F.lit(50.0), F.lit(40.0)))
    return W.corners(spark, d).select("o_orderkey", G.quantised(s).alias("s"), G.quantised(t).alias("t")).filter("s IS NOT NULL")


@query("poly_centroid", f"WITH {W.GRID_SQL} SELECT ref, c + 0.5 AS x, h AS y, r + 0.5 AS z FROM g")
def poly_centroid(spark, d):
    return M.centroids(W.grid_edges(spark, d))


@query(
    "place_models",
    f"""WITH p AS (SELECT s_suppkey AS placement, s_suppkey * 20 % (SELECT max(p_partkey) // 10 + 1 FROM part) AS model, s_suppkey % 13 / 4.0::DOUBLE AS rx, s_suppkey % 11 / 5.0::DOUBLE AS ry, s_suppkey % 17 / 6.0::DOUBLE AS rz, 1 + s_suppkey % 3 / 2.0::DOUBLE AS k, s_acctbal AS px FROM supplier),
    m AS (SELECT p_partkey // 10 AS model, p_partkey AS vid, p_size * 1.0::DOUBLE AS x, p_retailprice / 100 AS y, p_size % 5 * 1.0::DOUBLE AS z FROM part),
    a AS (SELECT placement, vid, rx, ry, px, x * k * cos(rz) - y * k * sin(rz) AS x1, x * k * sin(rz) + y * k * cos(rz) AS y1, z * k AS z1 FROM p JOIN m USING (model)),
    b AS (SELECT *, x1 * cos(ry) + z1 * sin(ry) AS x2, z1 * cos(ry) - x1 * sin(ry) AS z2 FROM a)
    SELECT placement, vid, {Q("x2 + px")} AS x, {Q("y1 * cos(rx) - z2 * sin(rx)")} AS y, {Q("y1 * sin(rx) + z2 * cos(rx)")} AS z FROM b""",
)
def place_models(spark, d):
    k = F.col("s_suppkey")
    models = W.table(spark, d, "part").agg((F.floor(F.max("p_partkey") / 10) + 1).alias("models"))  # one row
    placements = W.table(spark, d, "supplier").join(F.broadcast(models)).select(k.alias("placement"), (k * 20 % F.col("models")).alias("model"), (k % 13 / 4.0).alias("rx"), (k % 11 / 5.0).alias("ry"), (k % 17 / 6.0).alias("rz"), (1 + k % 3 / 2.0).alias("scale"), F.col("s_acctbal").alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))
    size = F.col("p_size")
    verts = W.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("model"), F.col("p_partkey").alias("vid"), (size * 1.0).alias("x"), (F.col("p_retailprice") / 100).alias("y"), (size % 5 * 1.0).alias("z"))
    return M.place(verts, placements).select("placement", "vid", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


@query("replace_tiles", "SELECT s_nationkey AS map_id, s_suppkey AS tile_x, 0 AS tile_y, 0 AS layer, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS data FROM supplier")
def replace_tiles(spark, d):
    tiles = W.table(spark, d, "supplier").select(F.col("s_nationkey").alias("map_id"), F.col("s_suppkey").alias("tile_x"), F.lit(0).alias("tile_y"), F.lit(0).alias("layer"), F.lit("old").alias("data"))
    return M.replace_tiles(tiles, tiles.filter("tile_x % 3 = 0").withColumn("data", F.lit("new")))


@query("rasterize")
def rasterize(spark, d):
    """Order triangles as voxels of half a unit, merged by cell."""
    from ..operators import columns as C
    from ..operators import voxels as V

    tris = W.corners(spark, d).select(F.lit(0).cast("long").alias("tile"), *(F.col(f"{c}{v}") / (1 if v == "y" else 10) for c in "abc" for v in "xyz"), F.lit(1).alias("area"))
    tris = tris.toDF("tile", *(f"{c}{v}" for c in "abc" for v in "xyz"), "area")
    return C.coalesce_spans(V.rasterize(tris, 0.5, 0.5, merge=True).drop("tile"))


@query("erode_spans")
def erode_spans(spark, d):
    """Walkable spans of the merged field that are at least one cell from an edge."""
    from pyspark.sql import Window

    from ..operators import columns as C
    from ..operators import voxels as V
    from ..operators.rounds import cut

    spans = cut(W.spans(spark, d).select("x", "z", "smin", "smax", "area"))
    walkable = spans.filter("area > 0").withColumn("layer", F.row_number().over(Window.partitionBy("x", "z").orderBy("smin", "smax")) - 1)
    return V.erode(walkable.select("x", "z", "layer"), C.neighbour_links(spans), 1)


@query("anp_roundtrip")
def anp_roundtrip(spark, d):
    """The nation grid as a tile in an archive, packed and parsed."""
    import zipfile
    import io

    import pandas as pd

    from ..sources import navmesh as N

    polys = W.grid_edges(spark, d).groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("edge", "ax", "ay", "az"))).alias("e"))  # four edges each

    def pack(pdf):
        rows = [{"flags": 4, "area": 1, "nei": [0] * len(e), "x": [p["ax"] for p in e], "y": [p["ay"] for p in e], "z": [p["az"] for p in e]} for e in pdf.sort_values("ref").e]
        return pd.DataFrame({"map_id": [0], "tile_x": [0], "tile_y": [0], "data": [N.tile_bytes(0, 0, rows)]})

    tiles = polys.withColumn("map_id", F.lit(0)).groupBy("map_id").applyInPandas(pack, "map_id int, tile_x int, tile_y int, data binary")
    archives = N.pack_anp(tiles, (0.0, 0.0, 0.0, 5.0, 5.0, 4096, 1)).select(F.col("name").alias("path"), "content")

    def parse(_, content):
        return N.parse_anp(content) if zipfile.is_zipfile(io.BytesIO(content)) else iter(())

    return N.polygon_edges(N._parsed(archives, parse, N.TILE)).select("ref", "edge", "ax", "ay", "az", "area")


@query(
    "road_rects",
    f"""WITH c AS (SELECT p_partkey AS chunk, p_retailprice AS x, p_size * 2.0::DOUBLE AS y, p_size, i AS cell, (p_partkey * (i // 4 + 3) * 37 % 256) // CAST(4 ** (i % 4) AS BIGINT) % 4 AS layer FROM part, (SELECT unnest(range(64)) AS i)),
    t AS (SELECT *, [p_size, p_size + 1, p_size % 7][layer + 1] AS texture FROM c WHERE layer < 3)
    SELECT chunk, CAST(cell AS INT) AS cell, {Q(f"y - (cell % 8 + 1) * {M.UNIT} - 0.01")} AS minx, {Q(f"x - (cell // 8) * {M.UNIT} + 0.01")} AS maxz FROM t WHERE texture % 5 = 0""",
)
def road_rects(spark, d):
    from ..operators.terrain import road_rects

    key, size = F.col("p_partkey"), F.col("p_size")
    chunks = W.table(spark, d, "part").select(key.alias("chunk"), F.col("p_retailprice").alias("x"), (size * 2.0).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: key * (i + 3) * 37 % 256).alias("pred_tex"), F.array(size, size + 1, size % 7).alias("layers"))
    roads = spark.range(0, 101, 5).select(F.col("id").cast("int").alias("texture_id"))
    found = road_rects(chunks, roads)
    return found.select("chunk", "cell", G.quantised(F.col("minx")).alias("minx"), G.quantised(F.col("maxz")).alias("maxz"))


@query(
    "liquid_rects",
    f"""WITH k(liquid, type) AS (VALUES (1, 19), (2, 22), (3, 25)), l AS (SELECT s_suppkey AS chunk, s_acctbal AS x, s_suppkey * 1.0::DOUBLE AS y, s_suppkey % 5 AS liquid, s_suppkey % 3 AS ox, s_suppkey % 2 AS oy, 1 + s_suppkey % 5 AS w, 1 + s_suppkey % 4 AS h, s_suppkey % 4 = 0 AS flat, s_suppkey % 6 = 0 AS full_mask FROM supplier),
    c AS (SELECT *, i AS cell FROM l, (SELECT unnest(range(20)) AS i) WHERE i < w * h AND (full_mask OR (chunk * 91 % 251 + i // 8) // CAST(2 ** (i % 8) AS BIGINT) % 2 = 1))
    SELECT chunk, CAST(cell AS INT) AS cell, coalesce(type, 16) AS type, {Q(f"y - (ox + cell % w + 1) * {M.UNIT} - 0.05")} AS minx, {Q(f"x - (oy + cell // w) * {M.UNIT} + 0.05")} AS maxz,
      {Q("CASE WHEN flat THEN 7.5 ELSE (cell // w) * (w + 1) + cell % w + 0.25 END")} AS h3, {Q("CASE WHEN flat THEN 7.5 ELSE (cell // w + 1) * (w + 1) + cell % w + 1.25 END")} AS h0 FROM c LEFT JOIN k USING (liquid)""",
)
def liquid_rects(spark, d):
    from ..operators.terrain import liquid_rects

    k = F.col("s_suppkey")
    kinds = spark.createDataFrame([(1, "ocean"), (2, "magma"), (3, "slime")], "liquid long, kind string")
    rows = W.table(spark, d, "supplier").select(
        k.alias("chunk"), F.lit(0).alias("instance"), F.col("s_acctbal").alias("x"), (k * 1.0).alias("y"), (k % 5).alias("liquid"), (k % 3).alias("off_x"), (k % 2).alias("off_y"), (1 + k % 5).alias("width"), (1 + k % 4).alias("height"), F.lit(7.5).alias("max_h"),
        F.when(k % 6 != 0, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: k * 91 % 251 + i)).alias("mask"), F.when(k % 4 != 0, F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i + 0.25)).alias("heights"),
    )
    found = liquid_rects(rows, kinds)
    return found.select("chunk", F.col("cell").cast("int").alias("cell"), "type", *(G.quantised(F.col(v)).alias(v) for v in ("minx", "maxz", "h3", "h0")))


@query("faction_rects", f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id, id AS now, 0 AS depth FROM a UNION ALL SELECT up.id, a.parent, depth + 1 FROM up JOIN a ON a.id = up.now WHERE a.parent <> 0 AND a.parent <> a.id AND depth < 9),
    f AS (SELECT up.id, up.depth, a.faction, a.flags FROM up JOIN a ON a.id = up.now), k AS (SELECT id, coalesce(arg_min(faction, depth) FILTER (faction <> 0), 0) AS faction, bool_or((flags & 40) <> 0) AS city FROM f GROUP BY id)
    SELECT o_orderkey AS chunk, {Q(f"o_totalprice - 8 * {M.UNIT} - 0.01")} AS minx, faction, city FROM orders JOIN k ON k.id = o_custkey % 3000 WHERE o_custkey % 3000 <> 0 AND (faction <> 0 OR city)""")
def faction_rects(spark, d):
    from ..operators.terrain import faction_rects

    chunks = W.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.lit(0.0).alias("x"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 3000).alias("area_id"))
    found = faction_rects(chunks, ancestor_areas(spark, d))
    return found.select("chunk", G.quantised(F.col("minx")).alias("minx"), "faction", "city")
