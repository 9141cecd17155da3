"""A navigation world derived from the driver's tables, for queries and benchmarks; each table has its SQL twin (a CTE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Areas of the regions' polygons, by r_regionkey; all cost at least 1.
REGION_AREAS = (1, 16, 7, 22, 10)
SPAN_AREAS = (1, 63, 10, 0, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_sql(value: str) -> str:
    """quantised() in SQL."""
    return f"CAST(floor(({value}) * 1e6 + 0.371) AS BIGINT)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event points: (event_id, x, y, z)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.col("user_id").cast("double").alias("z"))


POINTS_SQL = "pts AS (SELECT event_id, value AS x, CAST(event_id % 100 AS DOUBLE) AS y, CAST(user_id AS DOUBLE) AS z FROM events)"


def polylines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Paths of each user's events in time order, dealt to a number of `tasks` where one is given."""
    from ..operators.paths import number_points

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), (F.col("user_id") + F.col("event_id") % 7).cast("double").alias("z"))
    return number_points(events.repartition(tasks, "user_id") if tasks else events, "user_id", ["ts", "event_id"])


PATHS_SQL = """p AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  value AS x, CAST(event_id % 100 AS DOUBLE) AS y, CAST(user_id + event_id % 7 AS DOUBLE) AS z FROM events)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rectangles, of four kinds in turn: water, road, city, faction."""
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    low_x, low_z = (key % 50) * 10.0, (key % 16) * 10.0
    heights = [(price / 100 + k * (size % 7)).alias(f"h{k}") for k in range(4)]
    return table(spark, sf_dir, "part").select(
        key.alias("rect_seq"), low_x.alias("minx"), (low_x + size).alias("maxx"), low_z.alias("minz"), (low_z + size % 10 + 1).alias("maxz"), *heights,
        (16 + 3 * (key % 4)).cast("int").alias("type"), (1 + key % 2).cast("int").alias("faction"), (key % 4).cast("int").alias("kind"),
    )


RECTS_SQL = """r AS (SELECT p_partkey AS rect_seq, (p_partkey % 50) * 10.0::DOUBLE AS minx, (p_partkey % 50) * 10.0::DOUBLE + p_size AS maxx,
  (p_partkey % 16) * 10.0::DOUBLE AS minz, (p_partkey % 16) * 10.0::DOUBLE + p_size % 10 + 1 AS maxz,
  p_retailprice / 100 AS h0, p_retailprice / 100 + 1 * (p_size % 7) AS h1, p_retailprice / 100 + 2 * (p_size % 7) AS h2, p_retailprice / 100 + 3 * (p_size % 7) AS h3,
  CAST(16 + 3 * (p_partkey % 4) AS INT) AS type, CAST(1 + p_partkey % 2 AS INT) AS faction, CAST(p_partkey % 4 AS INT) AS kind FROM part)"""


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item spans on 64 x 64 cells: (x, z, smin, smax, area)."""
    low = ((F.col("l_orderkey") % 37) * 5).cast("int")
    area = F.element_at(F.array(*map(F.lit, SPAN_AREAS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("z"), low.alias("smin"), (low + 1 + F.col("l_quantity").cast("int") % 9).alias("smax"), area.alias("area"))


RAW_SPANS_SQL = """raw AS (SELECT CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS z, CAST((l_orderkey % 37) * 5 AS INT) AS smin,
  CAST((l_orderkey % 37) * 5 + 1 + CAST(trunc(l_quantity) AS INT) % 9 AS INT) AS smax, [1, 63, 10, 0, 2][CAST(l_linenumber % 5 + 1 AS INT)] AS area FROM lineitem)"""

SPANS_SQL = (
    RAW_SPANS_SQL
    + """, st AS (SELECT *, CASE WHEN smin <= max(smax) OVER (PARTITION BY x, z ORDER BY smin, smax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM raw),
il AS (SELECT *, sum(starts) OVER (PARTITION BY x, z ORDER BY smin, smax ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS layer FROM st),
tp AS (SELECT *, max(smax) OVER (PARTITION BY x, z, layer) AS top FROM il),
spans AS (SELECT x, z, CAST(layer AS BIGINT) AS layer, min(smin) AS smin, max(smax) AS smax, max(CASE WHEN top - smax <= 6 THEN area END) AS area FROM tp GROUP BY x, z, layer)"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.columns import coalesce_spans

    return coalesce_spans(raw_spans(spark, sf_dir))


def marked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as marking takes them: (span_id, x, z, y, area), y the top in voxels of 0.2."""
    return spans(spark, sf_dir).select(((F.col("x") * 64 + F.col("z")) * 1000 + F.col("layer")).cast("long").alias("span_id"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), F.col("smax").alias("y"), "area")


MARKED_SQL = SPANS_SQL + ", sp AS (SELECT CAST((x * 64 + z) * 1000 + layer AS BIGINT) AS span_id, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z, smax AS y, area FROM spans)"


def corners(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Triangles (or longer runs) of orders with neighbouring keys: (o_orderkey, ax, ay, az, bx, ... )."""
    at = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_totalprice") / 10000).alias("y"), (F.col("o_orderkey") * 7 % 97).cast("double").alias("z"))
    out = None
    for i, name in enumerate("abcd"[:n]):
        part = at.select((F.col("o_orderkey") - i).alias("o_orderkey"), *(F.col(v).alias(f"{name}{v}") for v in "xyz"))
        out = part if out is None else out.join(part, "o_orderkey")
    return out


CORNERS_SQL = """o AS (SELECT o_orderkey AS k, CAST(o_custkey % 100 AS DOUBLE) AS x, o_totalprice / 10000 AS y, CAST(o_orderkey * 7 % 97 AS DOUBLE) AS z FROM orders),
t AS (SELECT a.k AS o_orderkey, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM o a JOIN o b ON b.k = a.k + 1 JOIN o c ON c.k = a.k + 2)"""


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a 5 x 5 grid of unit squares, rows by x: edges around each, with neighbours and height by region."""
    row, col = F.floor(F.col("n_nationkey") / 5).cast("int"), (F.col("n_nationkey") % 5).cast("int")
    squares = table(spark, sf_dir, "nation").filter("n_nationkey < 25").select(F.col("n_nationkey").cast("long").alias("ref"), col.cast("double").alias("c"), row.cast("double").alias("r"), (F.col("n_regionkey") * 0.5).alias("h"))
    # corners run from (x, z) to (x, z+1), (x+1, z+1), (x+1, z); an edge's neighbour is beyond it
    around = [(0, 0, 0, 1, -1, 0), (0, 1, 1, 1, 0, 1), (1, 1, 1, 0, 1, 0), (1, 0, 0, 0, 0, -1)]
    sides = F.array(*(F.struct(F.lit(e).alias("edge"), *(F.lit(v).alias(n) for n, v in zip(("ax", "az", "bx", "bz", "dc", "dr"), s, strict=True))) for e, s in enumerate(around)))
    edges = squares.withColumn("s", F.explode(sides))
    to_c, to_r = F.col("c") + F.col("s.dc"), F.col("r") + F.col("s.dr")
    nei = F.when(to_c.between(0, 4) & to_r.between(0, 4), to_r * 5 + to_c).otherwise(-1).cast("long")
    return edges.select("ref", "s.edge", (F.col("c") + F.col("s.ax")).alias("ax"), F.col("h").alias("ay"), (F.col("r") + F.col("s.az")).alias("az"), (F.col("c") + F.col("s.bx")).alias("bx"), F.col("h").alias("by"), (F.col("r") + F.col("s.bz")).alias("bz"), nei.alias("nei"))


GRID_SQL = "g AS (SELECT CAST(n_nationkey AS BIGINT) AS ref, CAST(n_nationkey % 5 AS DOUBLE) AS c, CAST(n_nationkey // 5 AS DOUBLE) AS r, n_regionkey * 0.5::DOUBLE AS h, [1, 16, 7, 22, 10][n_regionkey + 1] AS area FROM nation WHERE n_nationkey < 25)"


def grid_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.element_at(F.array(*map(F.lit, REGION_AREAS)), F.col("n_regionkey") + 1)
    return table(spark, sf_dir, "nation").filter("n_nationkey < 25").select(F.col("n_nationkey").cast("long").alias("ref"), area.alias("area"))


def walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event points over the grid, never on its lines: (request_id, x, y, z)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("value") / 100 + 0.00037).alias("x"), ((F.col("event_id") % 100) / 25.0).alias("y"), (F.col("user_id") % 150 / 30 + 0.01234).alias("z"))


WALKERS_SQL = "w AS (SELECT event_id AS request_id, value / 100 + 0.00037 AS x, (event_id % 100) / 25.0::DOUBLE AS y, user_id % 150 / 30::DOUBLE + 0.01234 AS z FROM events)"


# --- decks: parts as the cells of two floors, with bent walls, tiles of eight columns, and links over the tiles' borders that cover part of an edge

DECK_COLUMNS = 40
DECK_COSTS = (1.0, 1.6, 4.0)


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, c, r, floor, cost) of the cells that are open; the others are holes."""
    key = F.col("p_partkey")
    cell = F.floor(key / 2)
    cost = F.element_at(F.array(*map(F.lit, DECK_COSTS)), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").filter("p_size % 9 <> 0").select(key.alias("ref"), (cell % DECK_COLUMNS).alias("c"), F.floor(cell / DECK_COLUMNS).alias("r"), (key % 2).alias("floor"), cost.alias("cost"))


def _corner(c, r, floor):
    x = c * 10.0 + ((c * 7 + r * 13) % 5 - 2) * 0.5
    z = r * 10.0 + ((c * 11 + r * 3) % 5 - 2) * 0.5
    return x, (c * 5 + r * 3) % 4 * 0.4 + floor * 8.0, z


def deck_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the cells; nei is -1, or -2 - side on a tile's border (side 0 is x-, 2 is x+)."""
    cells = decks(spark, sf_dir)
    around = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))
    sides = []
    for edge, (c0, r0, c1, r1) in enumerate(around):
        a, b = (_corner(F.col("c") + dc, F.col("r") + dr, F.col("floor")) for dc, dr in ((c0, r0), (c1, r1)))
        nei = F.when((F.col("c") % 8 == 0) & F.lit(edge == 0), -2).when((F.col("c") % 8 == 7) & F.lit(edge == 2), -4).otherwise(-1)
        sides.append(F.struct(F.lit(edge).alias("edge"), *(v.alias(f"{p}{n}") for p, q in (("a", a), ("b", b)) for n, v in zip("xyz", q, strict=True)), nei.cast("long").alias("nei")))
    return cells.select("ref", F.explode(F.array(*sides)).alias("s")).select("ref", "s.*")


def deck_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_ref, to_ref, edge, bmin, bmax): whole edges within a tile; over a border one part of an edge, or two."""
    cells = decks(spark, sf_dir)
    steps = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(k).alias("dk"), F.lit(dc).alias("dc")) for e, k, dc in ((0, -2, -1), (1, 2 * DECK_COLUMNS, 0), (2, 2, 1), (3, -2 * DECK_COLUMNS, 0))))
    mine = cells.withColumn("s", F.explode(steps)).select("ref", "c", "r", F.col("s.edge").alias("edge"), F.col("s.dc").alias("dc"), (F.col("ref") + F.col("s.dk")).alias("to_ref"))
    both = mine.join(cells.select(F.col("ref").alias("to_ref"), F.col("c").alias("to_c")).hint("merge"), "to_ref").filter("to_c = c + dc")
    border = ((F.col("edge") == 2) & (F.col("c") % 8 == 7)) | ((F.col("edge") == 0) & (F.col("c") % 8 == 0))
    low_ref = F.least("ref", "to_ref")
    start = low_ref * 37 % 120
    stop = start + 60 + low_ref % 3 * 15
    ranges = F.when(border, F.when(low_ref % 4 == 0, F.array(F.struct(start.alias("lo"), stop.alias("hi")), F.struct((stop + 20).alias("lo"), (stop + 40).alias("hi")))).otherwise(F.array(F.struct(start.alias("lo"), stop.alias("hi")))))
    ranges = F.coalesce(ranges, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(255).cast("long").alias("hi"))))
    out = both.withColumn("b", F.explode(ranges))
    flip = F.col("edge") == 0
    return out.select(F.col("ref").alias("from_ref"), "to_ref", "edge", F.when(flip, 255 - F.col("b.hi")).otherwise(F.col("b.lo")).cast("int").alias("bmin"), F.when(flip, 255 - F.col("b.lo")).otherwise(F.col("b.hi")).cast("int").alias("bmax"))


def deck_stairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as of deck_links() from every tenth column's cells to the next cell of the other floor."""
    cells = decks(spark, sf_dir)
    mine = cells.filter("c % 10 = 5").select(F.col("ref").alias("from_ref"), (F.col("ref") + 3 - 2 * F.col("floor")).alias("to_ref"))
    return mine.join(cells.select(F.col("ref").alias("to_ref")), "to_ref").select("from_ref", "to_ref", F.lit(2).alias("edge"), F.lit(0).alias("bmin"), F.lit(255).alias("bmax"))


def _corner_sql(c: str, r: str, p: str) -> str:
    return f"""({c}) * 10.0::DOUBLE + ((({c}) * 7 + ({r}) * 13) % 5 - 2) * 0.5::DOUBLE AS "{p}x", ((({c}) * 5 + ({r}) * 3) % 4) * 0.4::DOUBLE + f * 8.0::DOUBLE AS "{p}y",
  ({r}) * 10.0::DOUBLE + ((({c}) * 11 + ({r}) * 3) % 5 - 2) * 0.5::DOUBLE AS "{p}z\""""


_RANGED_SQL = "least(ref, to_ref) * 37 % 120"
DECKS_SQL = f"""dk AS (SELECT p_partkey AS ref, p_partkey // 2 % {DECK_COLUMNS} AS c, p_partkey // 2 // {DECK_COLUMNS} AS r, p_partkey % 2 AS f, [1.0::DOUBLE, 1.6, 4.0][p_size % 3 + 1] AS cost FROM part WHERE p_size % 9 <> 0),
de AS (SELECT ref, 0 AS edge, {_corner_sql("c", "r", "a")}, {_corner_sql("c", "r + 1", "b")} FROM dk UNION ALL SELECT ref, 1, {_corner_sql("c", "r + 1", "a")}, {_corner_sql("c + 1", "r + 1", "b")} FROM dk
  UNION ALL SELECT ref, 2, {_corner_sql("c + 1", "r + 1", "a")}, {_corner_sql("c + 1", "r", "b")} FROM dk UNION ALL SELECT ref, 3, {_corner_sql("c + 1", "r", "a")}, {_corner_sql("c", "r", "b")} FROM dk),
dp AS (SELECT a.ref, b.ref AS to_ref, edge, ((edge = 2 AND a.c % 8 = 7) OR (edge = 0 AND a.c % 8 = 0)) AS border FROM dk a, (VALUES (0, -2, -1), (1, {2 * DECK_COLUMNS}, 0), (2, 2, 1), (3, {-2 * DECK_COLUMNS}, 0)) AS s(edge, dk, dc) JOIN dk b ON b.ref = a.ref + s.dk AND b.c = a.c + s.dc),
dr AS (SELECT ref, to_ref, edge, 0 AS lo, 255 AS hi FROM dp WHERE NOT border UNION ALL SELECT ref, to_ref, edge, {_RANGED_SQL}, {_RANGED_SQL} + 60 + least(ref, to_ref) % 3 * 15 FROM dp WHERE border
  UNION ALL SELECT ref, to_ref, edge, {_RANGED_SQL} + 80 + least(ref, to_ref) % 3 * 15, {_RANGED_SQL} + 100 + least(ref, to_ref) % 3 * 15 FROM dp WHERE border AND least(ref, to_ref) % 4 = 0),
dl AS (SELECT ref AS from_ref, to_ref, edge, CASE WHEN edge = 0 THEN 255 - hi ELSE lo END AS bmin, CASE WHEN edge = 0 THEN 255 - lo ELSE hi END AS bmax FROM dr)"""


def deck_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rays over the decks from the customer's cell: (request_id, start_ref, sx .. gz)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cell = F.floor(cust / 2)
    sx, sz, sy = cell % DECK_COLUMNS * 10.0 + 5.13, F.floor(cell / DECK_COLUMNS) * 10.0 + 4.87, cust % 2 * 8.0 + 0.3
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"), cust.alias("start_ref"), sx.alias("sx"), sy.alias("sy"), sz.alias("sz"),
        (sx + (key * 17 % 61 - 30) * 1.003).alias("gx"), sy.alias("gy"), (sz + (key * 29 % 53 - 26) * 1.007).alias("gz"),
    )


DECK_RAYS_SQL = f"""ray AS (SELECT o_orderkey AS request_id, o_custkey AS start_ref, (o_custkey // 2 % {DECK_COLUMNS}) * 10.0::DOUBLE + 5.13 AS sx, (o_custkey % 2) * 8.0::DOUBLE + 0.3 AS sy, (o_custkey // 2 // {DECK_COLUMNS}) * 10.0::DOUBLE + 4.87 AS sz,
  (o_orderkey * 17 % 61 - 30) * 1.003::DOUBLE AS dx, (o_orderkey * 29 % 53 - 26) * 1.007::DOUBLE AS dz FROM orders)"""
