"""Distance fields, volumes, detail surfaces, samples and archive order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.names import natural_key
from ..operators import boxtree as B
from ..operators import columns as C
from ..operators import detail as D
from ..operators import meshes as M
from ..operators import sampling as S
from ..operators import volumes as V
from ..operators import voxels as X
from ..operators.rounds import cut
from . import world as W
from .decks import _PENTAGON, _customers
from .fields import DIRS_SQL

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


# --- distance field


def terrace(spark, d):
    """Parts as a terraced field 50 cells wide, with holes, two areas, and a gallery over part of it: (x, z, smin, smax, area)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x, z = (k % 50).cast("int"), F.floor(k / 50).cast("int")
    top = (20 + F.floor(x / 3) + F.floor(z / 4)).cast("int")
    cells = W.table(spark, d, "part").select(x.alias("x"), z.alias("z"), top.alias("top"), k.alias("k"), size.alias("size"))
    low = cells.select("x", "z", F.lit(0).alias("smin"), F.col("top").alias("smax"), F.when((F.col("k") * 7 + F.col("size")) % 61 == 0, 0).otherwise(1 + F.floor(F.col("x") / 17) % 2 * 3).cast("int").alias("area"))
    high = cells.filter("x % 25 BETWEEN 8 AND 20").select("x", "z", (F.col("top") + 30).alias("smin"), (F.col("top") + 35).alias("smax"), F.when(F.col("size") % 19 == 0, 0).otherwise(10).alias("area"))
    return low.unionByName(high)


TERRACE_SQL = f"""tc AS (SELECT CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS z, CAST(20 + (p_partkey % 50) // 3 + (p_partkey // 50) // 4 AS INT) AS top, p_partkey AS k, p_size AS size FROM part),
spans AS (SELECT x, z, 0 AS smin, top AS smax, CASE WHEN (k * 7 + size) % 61 = 0 THEN 0 ELSE 1 + x // 17 % 2 * 3 END AS area FROM tc UNION ALL SELECT x, z, top + 30, top + 35, CASE WHEN size % 19 = 0 THEN 0 ELSE 10 END FROM tc WHERE x % 25 BETWEEN 8 AND 20),
os AS (SELECT x, z, area, smin, smax, smax AS floor, coalesce(lead(smin) OVER (PARTITION BY x, z ORDER BY smin, smax), 65535) AS ceiling FROM spans),
sp AS (SELECT *, row_number() OVER (PARTITION BY x, z ORDER BY smin, smax) - 1 AS layer FROM os WHERE area > 0), {DIRS_SQL},
lk AS (SELECT a.x, a.z, a.layer, dir, a.x + dx AS tx, a.z + dz AS tz, min(b.layer) AS tl FROM sp a, dirs JOIN sp b ON b.x = a.x + dx AND b.z = a.z + dz
  WHERE least(a.ceiling, b.ceiling) - greatest(a.floor, b.floor) >= 10 AND abs(b.floor - a.floor) <= 6 AND a.layer <= 62 AND b.layer <= 62 GROUP BY ALL),
inner_ AS (SELECT lk.x, lk.z, lk.layer FROM lk JOIN sp a ON (a.x, a.z, a.layer) = (lk.x, lk.z, lk.layer) JOIN sp b ON (b.x, b.z, b.layer) = (tx, tz, tl) WHERE a.area = b.area GROUP BY ALL HAVING count(*) = 4),
arc AS (SELECT x, z, layer, tx, tz, tl, 2 AS w FROM lk UNION ALL SELECT a.x, a.z, a.layer, b.tx, b.tz, b.tl, 3 FROM lk a JOIN lk b ON (b.x, b.z, b.layer) = (a.tx, a.tz, a.tl) AND b.dir = (a.dir + 3) % 4),
df(x, z, layer, distance) USING KEY (x, z, layer) AS (SELECT x, z, layer, 0 FROM sp WHERE (x, z, layer) NOT IN (SELECT (x, z, layer) FROM inner_)
  UNION SELECT n.x, n.z, n.layer, min(n.c) FROM (SELECT arc.x, arc.z, arc.layer, f.distance + w AS c FROM df f JOIN arc ON (f.x, f.z, f.layer) = (tx, tz, tl)) n LEFT JOIN recurring.df o ON (o.x, o.z, o.layer) = (n.x, n.z, n.layer) WHERE o.distance IS NULL OR n.c < o.distance GROUP BY n.x, n.z, n.layer)"""


def _walkable(spark, d):
    from pyspark.sql import Window

    spans = terrace(spark, d)
    layer = F.row_number().over(Window.partitionBy("x", "z").orderBy("smin", "smax")) - 1
    return spans.filter("area > 0").withColumn("layer", layer).select("x", "z", "layer", "area"), cut(C.neighbour_links(spans))


@query("distance_field", f"WITH RECURSIVE {TERRACE_SQL} SELECT x, z, layer, CAST(distance AS INT) AS distance FROM df")
def distance_field(spark, d):
    """Distance of each span of the terrace to the next border of its area."""
    found = X.distance_field(*_walkable(spark, d))
    return found.withColumn("layer", F.col("layer").cast("long"))


@query(
    "blurred_field",
    f"""WITH RECURSIVE {TERRACE_SQL}, b AS (SELECT f.x, f.z, f.layer, f.distance AS own, coalesce(n.distance, f.distance) + coalesce(m.distance, f.distance) AS two FROM df f, dirs LEFT JOIN lk a ON (a.x, a.z, a.layer, a.dir) = (f.x, f.z, f.layer, dirs.dir) LEFT JOIN df n ON (n.x, n.z, n.layer) = (a.tx, a.tz, a.tl)
      LEFT JOIN lk e ON (e.x, e.z, e.layer) = (a.tx, a.tz, a.tl) AND e.dir = (dirs.dir + 1) % 4 LEFT JOIN df m ON (m.x, m.z, m.layer) = (e.tx, e.tz, e.tl))
    SELECT x, z, layer, CAST(CASE WHEN own <= 2 THEN own ELSE (sum(two) + own + 5) // 9 END AS INT) AS distance FROM b GROUP BY x, z, layer, own""",
)
def blurred_field(spark, d):
    """The same field after its blur."""
    spans, links = _walkable(spark, d)
    return X.blurred(X.distance_field(spans, links), links).withColumn("layer", F.col("layer").cast("long"))


# --- volumes


def volumes(spark, d):
    """Parts as boxes, pentagonal prisms and cylinders over the line items' spans."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x, z, r = k * 7 % 64 + 0.3, k * 11 % 64 + 0.6, size % 6 + 0.5
    kind = F.element_at(F.array(*map(F.lit, (V.BOX, V.PRISM, V.CYLINDER))), (k % 3 + 1).cast("int"))
    corners = F.array(*(F.struct((x + r * px).alias("x"), (z + r * pz).alias("z")) for px, pz in _PENTAGON))
    low = (k % 150).cast("double")
    return W.table(spark, d, "part").select(
        k.alias("seq"), (1 + k % 27).cast("int").alias("area"), kind.alias("kind"), (x - r).alias("minx"), low.alias("miny"), (z - r).alias("minz"), (x + r).alias("maxx"), (low + 40.5).alias("maxy"), (z + r).alias("maxz"),
        corners.alias("corners"), x.alias("px"), z.alias("pz"), r.alias("radius"),
    )


_LX, _HX = min(p[0] for p in _PENTAGON), max(p[0] for p in _PENTAGON)
_LZ, _HZ = min(p[1] for p in _PENTAGON), max(p[1] for p in _PENTAGON)
_ODD = " + ".join(
    f"CASE WHEN ((cz + r * {z0} > z + 0.5) <> (cz + r * {z1} > z + 0.5)) AND x + 0.5 < ((cx + r * {x1}) - (cx + r * {x0})) * (z + 0.5 - (cz + r * {z0})) / ((cz + r * {z1}) - (cz + r * {z0})) + (cx + r * {x0}) THEN 1 ELSE 0 END"
    for (x0, z0), (x1, z1) in zip(_PENTAGON, _PENTAGON[-1:] + _PENTAGON[:-1], strict=True)
)


@query(
    "mark_volumes",
    f"""WITH {W.MARKED_SQL}, v AS (SELECT p_partkey AS seq, CAST(1 + p_partkey % 27 AS INT) AS area, p_partkey % 3 AS kind, p_partkey * 7 % 64 + 0.3::DOUBLE AS cx, p_partkey * 11 % 64 + 0.6::DOUBLE AS cz, p_size % 6 + 0.5::DOUBLE AS r, p_partkey % 150 AS low FROM part),
    b AS (SELECT *, trunc(cx + r * CASE WHEN kind = 1 THEN {_LX} ELSE -1 END) AS lx, trunc(cx + r * CASE WHEN kind = 1 THEN {_HX} ELSE 1 END) AS hx, trunc(cz + r * CASE WHEN kind = 1 THEN {_LZ} ELSE -1 END) AS lz, trunc(cz + r * CASE WHEN kind = 1 THEN {_HZ} ELSE 1 END) AS hz FROM v),
    m AS (SELECT span_id, arg_max(b.area, seq) AS to_area FROM sp JOIN b ON x BETWEEN lx AND hx AND z BETWEEN lz AND hz AND y BETWEEN low AND low + 40 WHERE sp.area <> 0 AND CASE kind WHEN 0 THEN true WHEN 1 THEN ({_ODD}) % 2 = 1 ELSE (x + 0.5 - cx) ** 2 + (z + 0.5 - cz) ** 2 < r * r END GROUP BY span_id)
    SELECT span_id, CAST(coalesce(to_area, area) AS INT) AS area FROM sp LEFT JOIN m USING (span_id)""",
)
def mark_volumes(spark, d):
    return V.mark_volumes(W.marked_spans(spark, d), volumes(spark, d)).select("span_id", "area")


@query(
    "offset_outline",
    f"""WITH p AS (SELECT c_custkey AS k, (c_custkey % 4 + 1) * 5.0::DOUBLE AS size, (c_custkey // 2 % {W.DECK_COLUMNS}) * 10.0::DOUBLE + 5.13 AS x0, (c_custkey // 2 // {W.DECK_COLUMNS}) * 10.0::DOUBLE + 4.87 AS z0 FROM customer),
    c AS (SELECT k, i, x0 + size * px AS x, z0 + size * pz AS z FROM p, (VALUES {", ".join(f"({i}, {x}, {z})" for i, (x, z) in enumerate(_PENTAGON))}) AS v(i, px, pz)),
    n AS (SELECT b.k, b.i, b.x, b.z, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2) AS ux, (b.z - a.z) / sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2) AS uz, (e.x - b.x) / sqrt((e.x - b.x) ** 2 + (e.z - b.z) ** 2) AS wx, (e.z - b.z) / sqrt((e.x - b.x) ** 2 + (e.z - b.z) ** 2) AS wz
      FROM c b JOIN c a ON a.k = b.k AND a.i = (b.i + 4) % 5 JOIN c e ON e.k = b.k AND e.i = (b.i + 1) % 5),
    g AS (SELECT *, ((uz + wz) ** 2 + (ux + wx) ** 2) / 4 AS m2, (1 - (ux * wx + uz * wz)) / 2 AS d, ((uz + wz) ** 2 + (ux + wx) ** 2) / 4 * 1.44 < 1 AND wx * uz - ux * wz < 0 AS cut FROM n),
    o AS (SELECT k, i * 2 AS s, x + (uz + wz) / 2 / m2 * 1.5 AS x, z - (ux + wx) / 2 / m2 * 1.5 AS z FROM g WHERE NOT cut UNION ALL SELECT k, i * 2, x + (uz + ux * d) * 1.5, z + (uz * d - ux) * 1.5 FROM g WHERE cut UNION ALL SELECT k, i * 2 + 1, x + (wz - wx * d) * 1.5, z - (wx + wz * d) * 1.5 FROM g WHERE cut)
    SELECT k AS request_id, CAST(row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS INT) AS seq, {Q("x")} AS x, {Q("z")} AS z FROM o""",
)
def offset_outline(spark, d):
    """The customers' pentagons, grown by 1.5."""
    # few bytes a row and much work, so rows are dealt by number
    customers = _customers(spark, d).select("request_id", "corners").repartition(64, "request_id")
    grown = customers.select("request_id", F.posexplode(V.offset_outline(F.col("corners"), 1.5)).alias("seq", "p"))
    return grown.select("request_id", "seq", G.quantised(F.col("p.x")).alias("x"), G.quantised(F.col("p.z")).alias("z"))


# --- detail surfaces


def details(spark, d):
    """Two points inside each cell of the decks that has line items, at heights by their least and greatest quantity, and six triangles."""
    quantity = W.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ref")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    cells = W.decks(spark, d).join(quantity, "ref")
    x, y, z = F.col("c") * 10.0 + 5.0, F.col("floor") * 8.0, F.col("r") * 10.0 + 5.0
    points = F.array(F.struct((x - 1.5).alias("x"), (y + F.col("lo") / 20).alias("y"), z.alias("z")), F.struct((x + 1.5).alias("x"), (y + F.col("hi") / 20).alias("y"), z.alias("z")))
    tris = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, ("a", "b", "c", "flags"), strict=True))) for t in _TRIANGLES))
    return cells.select("ref", points.alias("points"), tris.alias("tris"))


_TRIANGLES = ((0, 1, 4, 1), (1, 2, 5, 1), (1, 5, 4, 0), (2, 3, 5, 1), (3, 0, 4, 1), (3, 4, 5, 0))
_FAN = ((0, 1, 2, 5), (0, 2, 3, 20))
_TRIS_SQL = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {f}, {str(len(s) == 6).lower()})" for s in (_TRIANGLES, _FAN) for i, (a, b, c, f) in enumerate(s)) + ") AS t(i, ia, ib, ic, flags, fine)"
_SIDE_SQL = " UNION ALL ".join(f'SELECT request_id, ref, over, px, pz, i * 3 + {n} AS n, flags >> {2 * k} & 1 = 1 AS outer_, {p}x AS ax, "{p}y" AS ay, {p}z AS az, {q}x AS bx, "{q}y" AS b_y, {q}z AS bz FROM tp' for n, (p, q, k) in enumerate((("c", "a", 2), ("a", "b", 0), ("b", "c", 1))))
_T_SQL = "CASE WHEN (bx - ax) * (bx - ax) + (bz - az) * (bz - az) > 0 THEN least(greatest(((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 0.0), 1.0) ELSE 0.0 END"


@query(
    "detail_points",
    f"""WITH {W.DECKS_SQL}, {W.DECK_RAYS_SQL}, li AS (SELECT l_partkey AS ref, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
    pt AS (SELECT ref, edge AS i, ax AS x, ay AS y, az AS z FROM de UNION ALL SELECT ref, 4, c * 10.0::DOUBLE + 5.0 - 1.5, f * 8.0::DOUBLE + lo / 20, r * 10.0::DOUBLE + 5.0 FROM dk JOIN li USING (ref) UNION ALL SELECT ref, 5, c * 10.0::DOUBLE + 5.0 + 1.5, f * 8.0::DOUBLE + hi / 20, r * 10.0::DOUBLE + 5.0 FROM dk JOIN li USING (ref)),
    tri AS (SELECT a.ref, t.i, flags, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM {_TRIS_SQL} JOIN pt a ON a.i = ia JOIN pt b ON b.ref = a.ref AND b.i = ib JOIN pt c ON c.ref = a.ref AND c.i = ic WHERE fine = (a.ref IN (SELECT ref FROM li))),
    q AS (SELECT request_id, start_ref AS ref, sx + (request_id % 13 - 6) * 1.07 AS px, sz + (request_id % 11 - 5) * 1.13 AS pz FROM ray JOIN dk ON dk.ref = start_ref),
    ov AS (SELECT request_id, sum(CASE WHEN ((az > pz) <> (bz > pz)) AND px < (bx - ax) * (pz - az) / (CASE WHEN bz <> az THEN bz - az END) + ax THEN 1 ELSE 0 END) % 2 = 1 AS over FROM q JOIN de USING (ref) GROUP BY request_id),
    tp AS (SELECT request_id, over, px, pz, tri.ref, i, flags, ax, ay, az, bx, b_y AS "by", bz, cx, cy, cz FROM q JOIN ov USING (request_id) JOIN tri USING (ref)),
    w AS (SELECT *, cx - ax AS v0x, cz - az AS v0z, bx - ax AS v1x, bz - az AS v1z, px - ax AS v2x, pz - az AS v2z FROM tp),
    u AS (SELECT *, CASE WHEN v0x * v1z - v0z * v1x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, abs(v0x * v1z - v0z * v1x) AS det FROM w),
    uv AS (SELECT *, sg * (v1z * v2x - v1x * v2z) AS u, sg * (v0x * v2z - v0z * v2x) AS v FROM u),
    ht AS (SELECT request_id, arg_min(ay + ((cy - ay) * u + ("by" - ay) * v) / det, i) AS h FROM uv WHERE det > 1e-6 AND u >= 0 AND v >= 0 AND u + v <= det GROUP BY request_id),
    sd AS ({_SIDE_SQL}),
    st AS (SELECT *, {_T_SQL} AS k FROM sd WHERE over OR outer_),
    on_ AS (SELECT request_id, n, ax + k * (bx - ax) AS x, ay + k * (b_y - ay) AS y, az + k * (bz - az) AS z, px, pz FROM st),
    near AS (SELECT request_id, arg_min(x, ((x - px) * (x - px) + (z - pz) * (z - pz), n)) AS x, arg_min(y, ((x - px) * (x - px) + (z - pz) * (z - pz), n)) AS y, arg_min(z, ((x - px) * (x - px) + (z - pz) * (z - pz), n)) AS z FROM on_ GROUP BY request_id)
    SELECT q.request_id, q.ref, over, {Q("CASE WHEN over THEN q.px ELSE near.x END")} AS x, {Q("CASE WHEN over THEN coalesce(h, near.y) ELSE near.y END")} AS y, {Q("CASE WHEN over THEN q.pz ELSE near.z END")} AS z FROM q JOIN ov USING (request_id) JOIN near USING (request_id) LEFT JOIN ht USING (request_id)""",
)
def detail_points(spark, d):
    """Heights and closest points of the orders' places on the decks' detail surfaces."""
    key = F.col("request_id")
    pairs = W.deck_rays(spark, d).select("request_id", (F.col("sx") + (key % 13 - 6) * 1.07).alias("px"), F.col("sy").alias("py"), (F.col("sz") + (key % 11 - 5) * 1.13).alias("pz"), F.col("start_ref").alias("ref"))
    found = D.surface_points(pairs, D.surfaces(W.deck_edges(spark, d), details(spark, d)))
    return found.select("request_id", "ref", "over", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


# --- samples and names


@query("poisson_disk")
def poisson_disk(spark, d):
    """Places over each cell of the decks, at least 3 apart and without room for another."""
    cells = W.deck_edges(spark, d).groupBy(F.col("ref").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge", "ax", "az"))), lambda s: F.struct(s["ax"].alias("x"), s["az"].alias("z"))).alias("corners"))  # four corners
    found = S.poisson_disk(cells, 3.0)
    return found.select("id", G.quantised(F.col("x")).alias("x"), G.quantised(F.col("z")).alias("z"))


_ARCHIVE_SQL = "CASE WHEN p_size % 3 = 0 THEN 'Data/enUS/' ELSE 'Data/' END || CASE WHEN p_size % 2 = 0 THEN 'patch' ELSE 'common' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE '-' || (p_size % 13) || 'b2' END || '.MPQ'"


@query(
    "archive_order",
    f"""WITH f AS (SELECT p_partkey % 200 AS file, {_ARCHIVE_SQL} AS archive, p_partkey FROM part),
    k AS (SELECT *, len(string_split(archive, '/')) AS depth, regexp_extract(split_part(archive, '/', -1), '^([^0-9]*)([0-9]*)', 1) AS head, regexp_extract(split_part(archive, '/', -1), '^([^0-9]*)([0-9]*)', 2) AS digits FROM f),
    n AS (SELECT *, coalesce(try_cast(digits AS BIGINT), 0) AS number FROM k)
    SELECT file, archive, p_partkey AS entry FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY depth DESC, number <> 0, head || repeat(' ', len(digits)), number, p_partkey) = 1""",
)
def archive_order(spark, d):
    """Of the archives that have a file, the one that is loaded first."""
    size, key = F.col("p_size"), F.col("p_partkey")
    archive = F.concat(F.when(size % 3 == 0, "Data/enUS/").otherwise("Data/"), F.when(size % 2 == 0, "patch").otherwise("common"), F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("-"), (size % 13).cast("string"), F.lit("b2"))), F.lit(".MPQ"))
    files = W.table(spark, d, "part").select((key % 200).alias("file"), archive.alias("archive"), key.alias("entry"))
    return M.first_wins(files, F.col("file"), natural_key(F.col("archive")), F.col("entry"))


# --- trees of boxes

_STEP = 0.25


def _boxes(spark, d):
    """The cells of the decks as boxes in whole steps, in tiles of 8 x 8 cells."""
    bounds = W.deck_edges(spark, d).groupBy("ref").agg(*(f(f"a{v}").alias(f"{n}{v}") for v in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    tiles = W.decks(spark, d).select("ref", (F.floor(F.col("c") / 8) + 8 * F.floor(F.col("r") / 8)).alias("tile"))
    return B.quantised_boxes(bounds.join(tiles, "ref"), _STEP)


@query(
    "box_tree_search",
    f"""WITH {W.DECKS_SQL}, {W.DECK_RAYS_SQL}, bx AS (SELECT ref, {", ".join(f'CAST(floor(min("a{v}") / {_STEP}) AS INT) AS min{v}, CAST(ceil(max("a{v}") / {_STEP}) AS INT) AS max{v}' for v in "xyz")} FROM de GROUP BY ref),
    q AS (SELECT request_id, {", ".join(f"CAST(floor((s{v} - {e}) / {_STEP}) AS INT) AS lo{v}, CAST(ceil((s{v} + {e}) / {_STEP}) AS INT) AS hi{v}" for v, e in zip("xyz", ("(5.2 - request_id % 3)", "(2.1 - request_id % 2)", "(4.1 - request_id % 4)"), strict=True))} FROM ray)
    SELECT request_id, ref FROM q JOIN bx ON lox <= maxx AND hix >= minx AND loz <= maxz AND hiz >= minz AND loy <= maxy AND hiy >= miny""",
)
def box_tree_search(spark, d):
    """Cells of the decks that boxes about the orders' places meet, found by the tiles' trees."""
    key = F.col("request_id")
    around = {"x": 5.2 - key % 3, "y": 2.1 - key % 2, "z": 4.1 - key % 4}
    rays = W.deck_rays(spark, d)
    boxes = rays.select("request_id", *((F.col(f"s{v}") - e).alias(f"min{v}") for v, e in around.items()), *((F.col(f"s{v}") + e).alias(f"max{v}") for v, e in around.items()))
    whole = B.quantised_boxes(boxes, _STEP)
    # a tile's cells reach a unit and a half beyond it
    tiles = {v: F.sequence(F.floor((F.col(f"min{v}") * _STEP - 1.5) / 80), F.floor((F.col(f"max{v}") * _STEP + 1.5) / 80)) for v in "xz"}
    asked = whole.withColumn("tx", F.explode(tiles["x"])).withColumn("tz", F.explode(tiles["z"])).withColumn("tile", F.col("tx") + 8 * F.col("tz")).filter("tx >= 0 AND tx < 5 AND tz >= 0").drop("tx", "tz")
    return B.search_trees(asked, cut(B.build_trees(_boxes(spark, d))))


# --- terrain files


def _tile_files(spark, d):
    """Parts as the chunks of terrain tiles, written as files' bytes: (path, content), at most 256 chunks in each."""
    import pandas as pd

    from ..sources import chunks as K

    k, size = F.col("p_partkey"), F.col("p_size")
    parts = W.table(spark, d, "part").select(F.floor(k / 256).alias("tile"), (k % 256).cast("int").alias("n"), size.alias("size"), k.alias("key"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        body = K.chunk("MVER", (18).to_bytes(4, "little"))
        for r in pdf.sort_values("n").itertuples():
            heights = [float(r.size) + i * 0.25 for i in range(145)] if r.size % 7 else None
            layers = [(int(r.key) * 3 + i, i, i * 64, 7) for i in range(r.size % 4)]
            tiles = [15 if (i + r.size) % 5 == 0 else i % 8 for i in range(64)]
            liquid = (0.0, 9.0, [float(r.size) + i * 0.5 for i in range(81)], tiles) if r.size % 3 == 0 else None
            body += K.terrain_bytes(int(r.n) % 16, int(r.n) // 16, int(r.key), [0, 4, 8, 16, 32][r.size % 5], int(r.size) * 1317 % 65536, (float(r.n), float(r.size), 1.5), heights, layers, liquid)
        return pd.DataFrame({"path": [f"tile_{pdf.tile.iloc[0]}.adt"], "content": [body]})

    return parts.groupBy("tile").applyInPandas(pack, "path string, content binary")


@query(
    "terrain_files",
    """SELECT 'tile_' || p_partkey // 256 || '.adt' AS path, CAST(p_partkey % 16 AS INT) AS cx, CAST(p_partkey % 256 // 16 AS INT) AS cy, CAST(p_partkey AS BIGINT) AS area_id, CAST(p_size * 1317 % 65536 AS INT) AS holes, CAST(p_partkey % 256 AS BIGINT) AS x,
      CASE WHEN p_size % 7 <> 0 THEN CAST(145 * p_size * 4 + 145 * 72 AS BIGINT) END AS quarters, CASE WHEN p_size % 4 > 0 THEN CAST((p_size % 4) * p_partkey * 3 + (p_size % 4) * (p_size % 4 - 1) // 2 AS BIGINT) END AS textures, false AS damaged FROM part""",
)
def terrain_files(spark, d):
    """The chunks of the parts' tiles, written and read again."""
    from ..sources import chunks as K

    add = lambda name: F.aggregate(name, F.lit(0.0), lambda t, h: t + h)
    read = K.read_terrain(_tile_files(spark, d))
    textures = F.aggregate("layers.texture_id", F.lit(0).cast("long"), lambda t, v: t + v)
    return read.select("path", "cx", "cy", "area_id", "holes", F.col("x").cast("long").alias("x"), (add("heights") * 4).cast("long").alias("quarters"), F.when(F.size("layers") > 0, textures).alias("textures"), F.col("error").isNotNull().alias("damaged"))


@query(
    "old_liquid",
    f"""WITH c AS (SELECT 'tile_' || p_partkey // 256 || '.adt' AS path, CAST(p_partkey % 16 AS INT) AS cx, CAST(p_partkey % 256 // 16 AS INT) AS cy, p_size, p_partkey % 256 AS n FROM part WHERE p_size % 3 = 0 AND p_size % 5 <> 0)
    SELECT path, cx, cy, CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col, ['water', 'ocean', 'magma', 'slime'][CAST(p_size % 5 AS INT)] AS kind, {Q("n - (i // 8) * (533.33333::DOUBLE / 128)")} AS x, CAST(2 * p_size + (i // 8) * 9 + i % 8 AS BIGINT) AS nw2, CAST(2 * p_size + (i // 8 + 1) * 9 + i % 8 + 1 AS BIGINT) AS se2
    FROM c, range(64) AS r(i) WHERE (i + p_size) % 5 <> 0""",
)
def old_liquid(spark, d):
    """Liquid quads of the parts' tiles."""
    from ..sources import chunks as K

    quads = K.old_liquid_quads(K.read_terrain(_tile_files(spark, d)))
    return quads.select("path", "cx", "cy", "row", "col", "kind", G.quantised(F.col("x")).alias("x"), (F.col("nw") * 2).cast("long").alias("nw2"), (F.col("se") * 2).cast("long").alias("se2"))
