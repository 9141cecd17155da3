"""Spatial requests on the nation grid, with their SQL where it has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas as A
from ..functions import geometry as G
from ..operators import meshes as M
from ..operators import paths as P
from ..operators import search as S
from ..operators.rounds import cut, relax
from . import world as W

Q = W.q_sql
CLIMB = 1.2
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def doors(spark, d):
    edges = W.grid_edges(spark, d)
    return S.portals(M.internal_links(edges), edges)


def costs(spark, d):
    return W.grid_areas(spark, d).join(F.broadcast(A.areas(spark)), "area").select("ref", "cost")


def _nearest_sql(extent: float, lift: str) -> str:
    """Squares are boxes, so the closest point is a clamp; points never lie on the grid's lines."""
    return f"""WITH {W.GRID_SQL}, {W.WALKERS_SQL}, c AS (SELECT request_id, ref, h, x, y {lift} AS y, z, least(greatest(x, c), c + 1) AS nx, least(greatest(z, r), r + 1) AS nz, x BETWEEN c AND c + 1 AND z BETWEEN r AND r + 1 AS over FROM w JOIN g
      ON c <= x + 6 AND c + 1 >= x - 6 AND r <= z + 6 AND r + 1 >= z - 6 AND h BETWEEN y {lift} - {extent} AND y {lift} + {extent}),
    s AS (SELECT *, CASE WHEN over THEN greatest(abs(h - y) - 1.2, 0) ** 2 ELSE (nx - x) ** 2 + (h - y) ** 2 + (nz - z) ** 2 END AS d FROM c)
    SELECT request_id, arg_min(ref, (d, ref)) AS ref, {Q("arg_min(nx, (d, ref))")} AS x, {Q("arg_min(h, (d, ref))")} AS y, {Q("arg_min(nz, (d, ref))")} AS z FROM s GROUP BY request_id"""


def _snapped(found):
    return found.select("request_id", "ref", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


@query("nearest_poly", _nearest_sql(6.0, ""))
def nearest_poly(spark, d):
    return _snapped(S.nearest(W.walkers(spark, d), W.grid_edges(spark, d), CLIMB))


@query("height_query", _nearest_sql(2500.0, "+ 1000"))
def height_query(spark, d):
    points = W.walkers(spark, d).withColumn("y", F.col("y") + 1000)
    return _snapped(S.nearest(points, W.grid_edges(spark, d), CLIMB, S.TALL_EXTENTS))


def grid_polylines(spark, d):
    """Paths over the grid, some points beyond it: (path_id, seq, x, y, z)."""
    points = W.walkers(spark, d).select((F.col("request_id") % 40).alias("path_id"), F.col("request_id").alias("n"), (F.col("x") * 1.5 - 0.7).alias("x"), "y", "z")
    return P.number_points(points, "path_id", ["n"])


@query(
    "cpop_snap",
    f"""WITH {W.GRID_SQL}, {W.WALKERS_SQL}, p AS (SELECT request_id % 40 AS path_id, row_number() OVER (PARTITION BY request_id % 40 ORDER BY request_id) - 1 AS seq, x * 1.5 - 0.7 AS x, y, z FROM w),
    c AS (SELECT path_id, seq, ref, h, x, y, z, least(greatest(x, c), c + 1) AS nx, least(greatest(z, r), r + 1) AS nz, x BETWEEN c AND c + 1 AND z BETWEEN r AND r + 1 AS over FROM p JOIN g ON c <= x + 6 AND c + 1 >= x - 6 AND r <= z + 6 AND r + 1 >= z - 6 AND h BETWEEN y - 6 AND y + 6),
    s AS (SELECT *, CASE WHEN over THEN greatest(abs(h - y) - 1.2, 0) ** 2 ELSE (nx - x) ** 2 + (h - y) ** 2 + (nz - z) ** 2 END AS d FROM c),
    b AS (SELECT path_id, seq, arg_min(nx, (d, ref)) AS x, arg_min(h, (d, ref)) AS y, arg_min(nz, (d, ref)) AS z FROM s GROUP BY path_id, seq)
    SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS BIGINT) AS seq, {Q("x")} AS x, {Q("y")} AS y, {Q("z")} AS z FROM b""",
)
def cpop_snap(spark, d):
    out = S.snap_paths(grid_polylines(spark, d), W.grid_edges(spark, d), CLIMB)
    return out.select("path_id", F.col("seq").cast("long").alias("seq"), *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


@query(
    "grid_shortest_path",
    f"""WITH RECURSIVE {W.GRID_SQL}, ar(area, cost) AS (VALUES (1, 1.0::DOUBLE), (16, 1.6), (7, 1.0), (22, 4.0), (10, 1.0)), k AS (SELECT ref, c, r, cost FROM g JOIN ar USING (area)),
    arcs AS (SELECT a.ref AS node, b.ref AS to_node, (a.cost + b.cost) / 2 AS weight FROM k a JOIN k b ON abs(a.c - b.c) + abs(a.r - b.r) = 1),
    best(id, cost) USING KEY (id) AS (SELECT s.ref * 100 + s.ref, 0.0::DOUBLE FROM g s UNION SELECT b.id // 100 * 100 + a.to_node, min(b.cost + a.weight) FROM best b JOIN arcs a ON a.node = b.id % 100 LEFT JOIN recurring.best o ON o.id = b.id // 100 * 100 + a.to_node
      WHERE o.cost IS NULL OR b.cost + a.weight < o.cost - 1e-12 GROUP BY 1)
    SELECT id // 100 AS source, id % 100 AS node, {Q("cost")} AS cost FROM best""",
)
def grid_shortest_path(spark, d):
    grid = costs(spark, d)
    arcs = M.internal_links(W.grid_edges(spark, d)).join(grid.withColumnsRenamed({"ref": "from_ref", "cost": "c0"}), "from_ref").join(grid.withColumnsRenamed({"ref": "to_ref", "cost": "c1"}), "to_ref")
    arcs = arcs.select(F.col("from_ref").alias("node"), F.col("to_ref").alias("to_node"), ((F.col("c0") + F.col("c1")) / 2).alias("weight"))
    best = relax(grid.select(F.col("ref").alias("source"), F.col("ref").alias("node"), F.lit(0.0).alias("cost")), arcs)
    return best.select("source", "node", G.quantised(F.col("cost")).alias("cost"))


def journeys(spark, d):
    """Order requests over the grid: (request_id, sx..sz, gx..gz)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return W.table(spark, d, "orders").select(
        key.alias("request_id"), (cust % 5 + 0.31).alias("sx"), F.lit(0.5).alias("sy"), (F.floor(cust / 5) % 5 + 0.57).alias("sz"), (key % 5 + 0.43).alias("gx"), F.lit(0.5).alias("gy"), (F.floor(key / 5) % 5 + 0.71).alias("gz")
    )


def placed(spark, d, requests):
    """Requests with the polygons of both ends and the ends moved onto those; a request without one goes."""
    edges = W.grid_edges(spark, d)
    for p, name in (("s", "start_ref"), ("g", "goal_ref")):
        found = S.nearest(requests.select("request_id", *(F.col(f"{p}{v}").alias(v) for v in "xyz")), edges, CLIMB)
        requests = requests.drop(*(f"{p}{v}" for v in "xyz")).join(found.select("request_id", F.col("ref").alias(name), *(F.col(v).alias(f"{p}{v}") for v in "xyz")), "request_id")
    return requests


def same_journeys(asked):
    """(different, members): each different journey once, as a request whose request_id is the journey itself, and (request_id, journey) of all that ask for it."""
    journey = F.struct(*(f"{p}{v}" for p in "sg" for v in "xyz"))
    different = cut(asked.select(journey.alias("request_id")).distinct())
    return different.select("request_id", "request_id.*"), asked.select("request_id", journey.alias("journey"))


def straight_paths(spark, d):
    """(members, paths): the path of each different journey of the orders, as path_id, and the orders that take it; a journey whose goal can't be reached leads to where it's nearest."""
    different, members = same_journeys(journeys(spark, d))
    requests = cut(placed(spark, d, different))
    found = cut(S.routes(requests, doors(spark, d), costs(spark, d), partial=True))
    return members, cut(S.pull_tight(S.with_ends(requests, found, W.grid_edges(spark, d)), found))


def of_members(members, paths):
    """What was found for journeys (path_id), for each order (path_id) that takes one."""
    return members.withColumnRenamed("request_id", "member").join(paths.withColumnRenamed("path_id", "journey"), "journey").drop("journey").withColumnRenamed("member", "path_id")


@query("path_request")
def path_request(spark, d):
    """PATH for each order: snapped, routed, pulled tight, smoothed by corner cutting, with stats."""
    members, paths = straight_paths(spark, d)
    stats = cut(P.stats(P.truncate(P.chaikin(paths))).select("path_id", "points", G.quantised(F.col("length")).alias("length")))
    return of_members(members, stats).select(F.col("path_id").alias("request_id"), "points", "length")


@query("path_points")
def path_points(spark, d):
    members, paths = straight_paths(spark, d)
    return of_members(members, paths).select("path_id", "seq", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


@query("random_path")
def random_path(spark, d):
    """RANDOM_PATH: inner points of each path moved to a random point of the polygons around them."""
    members, paths = straight_paths(spark, d)
    inner = paths.withColumn("n", F.count("*").over(P.whole_path())).withColumn("at", F.struct("path_id", "seq"))
    asked = inner.filter("seq > 0 AND seq < n - 1").select(F.col("at").alias("request_id"), *"xyz")
    near = S.nearest(asked, W.grid_edges(spark, d), CLIMB).select(F.col("request_id").alias("at"), F.col("ref").alias("start_ref"), F.col("x").alias("sx"), F.col("z").alias("sz"))
    every = of_members(members, cut(inner.join(near, "at", "left").drop("at", "n")))
    at = every.filter("start_ref IS NOT NULL").select(F.struct("path_id", "seq").alias("request_id"), "start_ref", "sx", "sz", F.lit(1.0).alias("radius"))
    moved = S.random_points_around(at, W.grid_edges(spark, d), doors(spark, d)).select("request_id.*", *"xyz")
    kept = every.filter("start_ref IS NULL").select("path_id", "seq", *"xyz")
    return kept.unionByName(moved).select("path_id", "seq", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


@query("mas_validate")
def mas_validate(spark, d):
    """Paths of the orders, walked along the surface."""
    members, paths = straight_paths(spark, d)
    out = cut(S.walk(paths, W.grid_edges(spark, d), doors(spark, d), CLIMB))
    return of_members(members, out).select("path_id", "seq", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


INNER_WALLS = "(ref = 7 AND edge = 2) OR (ref = 8 AND edge = 0) OR (ref = 16 AND edge = 1) OR (ref = 21 AND edge = 3) OR (ref = 12 AND edge = 1) OR (ref = 17 AND edge = 3)"


def walls(spark, d):
    """The grid's rim and three walls inside it."""
    return W.grid_edges(spark, d).filter(f"nei < 0 OR {INNER_WALLS}")


WALLS_SQL = """wl(ax, az, bx, bz) AS (SELECT c + dx0, r + dz0, c + dx1, r + dz1 FROM g, (VALUES (0, 0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1, 0), (3, 1, 0, 0, 0, 0, -1)) AS s(edge, dx0, dz0, dx1, dz1, dc, dr)
  WHERE NOT (c + dc BETWEEN 0 AND 4 AND r + dr BETWEEN 0 AND 4) OR (ref, edge) IN ((7, 2), (8, 0), (16, 1), (21, 3), (12, 1), (17, 3)))"""
JOURNEYS_SQL = "j AS (SELECT o_orderkey AS request_id, o_custkey % 5 + 0.31::DOUBLE AS sx, o_custkey // 5 % 5 + 0.57::DOUBLE AS sz, o_orderkey % 5 + 0.43::DOUBLE AS gx, o_orderkey // 5 % 5 + 0.71::DOUBLE AS gz FROM orders)"


@query(
    "cast_ray",
    f"""WITH {W.GRID_SQL}, {WALLS_SQL}, {JOURNEYS_SQL}, x AS (SELECT request_id, (gx - sx) * (bz - az) - (gz - sz) * (bx - ax) AS det, (ax - sx) * (bz - az) - (az - sz) * (bx - ax) AS tn, (ax - sx) * (gz - sz) - (az - sz) * (gx - sx) AS un FROM j, wl),
    h AS (SELECT request_id, min(tn / det) AS t FROM x WHERE abs(det) > 1e-12 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1 GROUP BY request_id)
    SELECT j.request_id, h.t IS NULL AS clear, coalesce({Q("h.t")}, -1) AS t FROM j LEFT JOIN h USING (request_id)""",
)
def cast_ray(spark, d):
    found = S.cast_rays(journeys(spark, d), walls(spark, d), 2.0)
    return found.select("request_id", F.col("t").isNull().alias("clear"), F.coalesce(G.quantised(F.col("t")), F.lit(-1)).alias("t"))


@query(
    "wall_distance",
    f"""WITH {W.GRID_SQL}, {WALLS_SQL}, {W.WALKERS_SQL}, d AS (SELECT request_id, x, z, ax, az, bx, bz, least(greatest((x - ax) * (bx - ax) + (z - az) * (bz - az), 0.0), 1.0) AS t FROM w, wl),
    e AS (SELECT request_id, sqrt((ax + t * (bx - ax) - x) ** 2 + (az + t * (bz - az) - z) ** 2) AS distance FROM d) SELECT request_id, {Q("min(distance)")} AS distance FROM e GROUP BY request_id HAVING min(distance) <= 1.5""",
)
def wall_distance(spark, d):
    found = S.wall_distance(W.walkers(spark, d).select("request_id", "x", "z"), walls(spark, d), 1.5)
    return found.select("request_id", G.quantised(F.col("distance")).alias("distance"))


@query("move_along_surface", f"WITH {JOURNEYS_SQL} SELECT request_id, {Q('least(greatest(gx * 1.3 - 0.5, 0.0), 5.0)')} AS x, {Q('least(greatest(gz * 1.3 - 0.5, 0.0), 5.0)')} AS z FROM j")
def move_along_surface(spark, d):
    """Moves toward goals that may lie beyond the grid: a walker ends at the point of the grid next to its goal."""
    asked, members = same_journeys(journeys(spark, d).withColumns({"gx": F.col("gx") * 1.3 - 0.5, "gz": F.col("gz") * 1.3 - 0.5}))
    edges = W.grid_edges(spark, d)
    start = S.nearest(asked.select("request_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")), edges, CLIMB).select("request_id", F.col("ref").alias("start_ref"))
    found = cut(S.move_along(asked.join(start, "request_id"), edges, doors(spark, d)).withColumnRenamed("request_id", "path_id"))
    return of_members(members, found).select(F.col("path_id").alias("request_id"), G.quantised(F.col("x")).alias("x"), G.quantised(F.col("z")).alias("z"))


@query("random_point")
def random_point(spark, d):
    """RANDOM_POINT for each customer over the whole grid."""
    asked = W.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"))
    return _snapped(S.random_points_anywhere(asked, W.grid_edges(spark, d)))


@query("random_point_around")
def random_point_around(spark, d):
    edges = W.grid_edges(spark, d)
    asked = journeys(spark, d)
    places = asked.select(F.struct("sx", "sy", "sz").alias("request_id")).distinct().select("request_id", *(F.col(f"request_id.s{v}").alias(v) for v in "xyz"))
    start = cut(S.nearest(places, edges, CLIMB).select(F.col("request_id").alias("place"), F.col("ref").alias("start_ref")))
    at = asked.withColumn("place", F.struct("sx", "sy", "sz")).join(start, "place").withColumn("radius", F.lit(0.6))
    return _snapped(S.random_points_around(at, edges, doors(spark, d)))


@query(
    "polys_around_circle",
    f"""WITH {W.GRID_SQL} SELECT s.ref AS request_id, t.ref FROM g s, g t WHERE ((t.c + 0.5 - (s.c + 0.5)) = 0 AND t.r = s.r) OR (abs(t.c - s.c) + abs(t.r - s.r) = 1)""",
)
def polys_around_circle(spark, d):
    """Polygons within reach of a circle about each polygon's centre that touches its edges' middles."""
    grid = W.grid_edges(spark, d).filter("edge = 0")
    circles = grid.select(F.col("ref").alias("request_id"), (F.col("ax") + 0.5).alias("cx"), (F.col("az") + 0.5).alias("cz"), F.lit(0.55).alias("radius"))
    return S.reach(circles, doors(spark, d), grid.select(F.col("ref").alias("request_id"), "ref"))


@query("path_answers")
def path_answers(spark, d):
    """Customers' polylines of four points over and beyond the grid, smoothed and validated by the flags of their keys."""
    k = F.col("c_custkey")
    corners = F.array(*(F.struct((k * (3 + i) % 7 - 0.7).cast("double").alias("x"), F.lit(0.5).alias("y"), (k * (5 - i) % 6 - 0.3).cast("double").alias("z")) for i in range(4)))
    journey = F.struct(corners.alias("corners"), (k % 32).cast("int").alias("flags"))
    members = W.table(spark, d, "customer").filter("c_custkey IS NOT NULL").select(k.alias("request_id"), journey.alias("journey"))
    # paths of the same points and flags, 672 at most, are answered once
    different = cut(members.select(F.col("journey").alias("path_id")).distinct())
    points = different.select("path_id", F.posexplode("path_id.corners").alias("seq", "p")).select("path_id", "seq", "p.x", "p.y", "p.z")
    out = cut(S.answer_paths(points, different.select("path_id", "path_id.flags"), W.grid_edges(spark, d), doors(spark, d), CLIMB))
    return of_members(members, out).select("path_id", "seq", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))
