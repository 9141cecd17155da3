"""Walls, rays and routes that end early, on the decks and on the grid with islands, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import around as N
from ..operators import offmesh as O
from ..operators import search as S
from ..operators import walls as L
from ..operators.meshes import border_links
from ..operators.rounds import cut
from . import meshes as PM
from . import requests as R
from . import world as W

Q = W.q_sql
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CLIMB = 1.2


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _segments(found):
    return found.select("ref", "edge", "bmin", "bmax", "to_ref", *(G.quantised(F.col(f"{p}{v}")).alias(f"{p}{v}") for p in "ab" for v in "xyz"))


def _gaps_sql(edges: str, links: str) -> str:
    """Steps of an edge that no link covers, put together where they follow each other."""
    return f"""st AS (SELECT ref, edge, i FROM {edges}, range(255) AS s(i) WHERE NOT EXISTS (SELECT 1 FROM {links} l WHERE l.from_ref = {edges}.ref AND l.edge = {edges}.edge AND l.bmin <= i AND i < l.bmax)),
  run AS (SELECT ref, edge, i, i - row_number() OVER (PARTITION BY ref, edge ORDER BY i) AS g FROM st), gap AS (SELECT ref, edge, CAST(min(i) AS INT) AS bmin, CAST(max(i) + 1 AS INT) AS bmax FROM run GROUP BY ref, edge, g)"""


_ENDS_SQL = ", ".join(Q(f'e."a{v}" + (e."b{v}" - e."a{v}") * ({t} / 255.0::DOUBLE)') + f' AS "{p}{v}"' for p, t in (("a", "g.bmin"), ("b", "g.bmax")) for v in "xyz")


@query(
    "wall_segments",
    f"""WITH {W.DECKS_SQL}, {_gaps_sql("de", "dl")}, seg AS (SELECT ref, edge, bmin, bmax, CAST(NULL AS BIGINT) AS to_ref FROM gap UNION ALL SELECT from_ref, edge, bmin, bmax, to_ref FROM dl)
    SELECT g.ref, g.edge, CAST(g.bmin AS INT) AS bmin, CAST(g.bmax AS INT) AS bmax, g.to_ref, {_ENDS_SQL} FROM seg g JOIN de e USING (ref, edge)""",
)
def wall_segments(spark, d):
    """Walls and portals of the decks."""
    return _segments(L.wall_segments(W.deck_edges(spark, d), W.deck_links(spark, d), with_portals=True))


@query(
    "border_walls",
    f"""WITH {PM.BORDER_SQL}, {PM.BORDER_LINKS_SQL}, be AS (SELECT ref, 0 AS edge, lo, hi FROM e), {_gaps_sql("be", "bl")}
    SELECT g.ref, g.bmin, g.bmax, {Q("be.lo + (be.hi - be.lo) * (g.bmin / 255.0::DOUBLE)")} AS az, {Q("be.lo + (be.hi - be.lo) * (g.bmax / 255.0::DOUBLE)")} AS bz FROM gap g JOIN be USING (ref, edge)""",
)
def border_walls(spark, d):
    """What the links over the suppliers' borders, which overlap, leave of each edge."""
    edges = PM.border_edges(spark, d)
    return _segments(L.wall_segments(edges, border_links(edges, CLIMB))).select("ref", "bmin", "bmax", "az", "bz")


_SIDES_SQL = """dface AS (SELECT ref, list({'edge': edge, 'ax': ax, 'ay': ay, 'az': az, 'bx': bx, 'b_y': "by", 'bz': bz} ORDER BY edge) AS sides FROM de GROUP BY ref),
ddoor AS (SELECT from_ref AS ref, list({'edge': edge, 'to_ref': to_ref, 'bmin': bmin, 'bmax': bmax}) AS doors FROM dl GROUP BY ref),
df AS (SELECT dk.ref, dk.cost AS ground, sides, coalesce(doors, []) AS doors FROM dk JOIN dface USING (ref) LEFT JOIN ddoor USING (ref))"""


@query(
    "walk_ray",
    f"""WITH RECURSIVE {W.DECKS_SQL}, {_SIDES_SQL}, {W.DECK_RAYS_SQL},
    way AS (SELECT request_id, start_ref AS ref, sx, sz, sy, sx + dx - sx AS dx, sz + dz - sz AS dz, sx + dx AS gx, sz + dz AS gz, sy AS gy, 0.0::DOUBLE AS t, sx AS px, sy AS py, sz AS pz, 0.0::DOUBLE AS cost, 0 AS polys, start_ref AS nxt, false AS clear, NULL::DOUBLE AS nx, NULL::DOUBLE AS nz FROM ray
      UNION ALL SELECT request_id, ref, sx, sz, sy, dx, dz, gx, gz, gy, t2 AS t, qx, qy, qz, CASE WHEN missed THEN cost ELSE cost + sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz)) * ground END, CASE WHEN missed THEN polys ELSE polys + 1 END,
        CASE WHEN NOT missed AND NOT inside THEN list_min(list_transform(list_filter(doors, lambda o: o.edge = s.edge AND ((o.bmin = 0 AND o.bmax = 255) OR (along * 255 >= o.bmin AND along * 255 <= o.bmax))), lambda o: o.to_ref)) END, inside,
        CASE WHEN NOT missed AND NOT inside THEN ez / sqrt(ex * ex + ez * ez) END, CASE WHEN NOT missed AND NOT inside THEN -ex / sqrt(ex * ex + ez * ez) END
      FROM (SELECT *, CASE WHEN missed THEN px WHEN inside THEN gx ELSE sx + dx * t2 END AS qx, CASE WHEN missed THEN pz WHEN inside THEN gz ELSE sz + dz * t2 END AS qz, CASE WHEN missed THEN py WHEN inside THEN gy ELSE s.ay + (s.b_y - s.ay) * along END AS qy
        FROM (SELECT *, CASE WHEN ex * ex > ez * ez THEN (sx + dx * t2 - s.ax) / ex ELSE (sz + dz * t2 - s.az) / ez END AS along
        FROM (SELECT *, s.bx - s.ax AS ex, s.bz - s.az AS ez, CASE WHEN missed OR inside THEN t ELSE greatest(t, out.t) END AS t2
        FROM (SELECT *, NOT missed AND coalesce(out.t, 1.0) >= 1.0 AS inside, list_filter(sides, lambda s: s.edge = out.edge)[1] AS s
        FROM (SELECT *, beside OR coalesce(greatest(0.0, enters), 0.0) > least(coalesce(out.t, 1.0), 1.0) AS missed
        FROM (SELECT *, list_max(list_transform(list_filter(met, lambda m: m.turn <= -1e-6), lambda m: m.inside / m.turn)) AS enters,
          list_sort(list_transform(list_filter(met, lambda m: m.turn >= 1e-6), lambda m: {{'t': m.inside / m.turn, 'edge': m.edge}}))[1] AS out, len(list_filter(met, lambda m: abs(m.turn) < 1e-6 AND m.inside < 0)) > 0 AS beside
        FROM (SELECT w.* EXCLUDE (ref, nxt, clear, nx, nz), w.nxt AS ref, f.ground, f.sides, f.doors,
          list_transform(f.sides, lambda s: {{'edge': s.edge, 'inside': (s.bz - s.az) * (w.sx - s.ax) - (s.bx - s.ax) * (w.sz - s.az), 'turn': w.dz * (s.bx - s.ax) - w.dx * (s.bz - s.az)}}) AS met
          FROM way w JOIN df f ON f.ref = w.nxt))))))))
    SELECT request_id, ref, {Q("t")} AS t, clear, {Q("nx")} AS nx, {Q("nz")} AS nz, {Q("cost")} AS cost, polys FROM way WHERE nxt IS NULL""",
)
def walk_ray(spark, d):
    """Rays of the orders over the decks: neither the other floor's walls nor the closed part of a border edge are mistaken."""
    found = L.walk_rays(W.deck_rays(spark, d), L.faces(W.deck_edges(spark, d), W.deck_links(spark, d), W.decks(spark, d).select("ref", "cost")))
    return found.select("request_id", "ref", *(G.quantised(F.col(v)).alias(v) for v in ("t", "nx", "nz", "cost")), "clear", "polys")


_RADIUS = 16.0
_NEAR_SQL = "(ax + k * (bx - ax) - x) * (ax + k * (bx - ax) - x) + (az + k * (bz - az) - z) * (az + k * (bz - az) - z)"
_ALONG_SQL = "least(greatest(((x - ax) * (bx - ax) + (z - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 0.0), 1.0)"


@query(
    "reachable_wall",
    f"""WITH RECURSIVE {W.DECKS_SQL}, {W.DECK_RAYS_SQL}, pts AS (SELECT request_id, start_ref AS ref, sx + (request_id % 7 - 3) * 1.1 AS x, sz + (request_id % 5 - 2) * 1.3 AS z FROM ray JOIN dk ON dk.ref = start_ref),
    ent(request_id, ref, x, z, entered) USING KEY (request_id, ref) AS (SELECT request_id, ref, x, z, 0.0::DOUBLE FROM pts
      UNION SELECT n.request_id, n.to_ref, n.x, n.z, min(n.e) FROM (SELECT request_id, to_ref, x, z, greatest(entered, sqrt({_NEAR_SQL})) AS e FROM (SELECT e.*, l.to_ref, ax, az, bx, bz, {_ALONG_SQL} AS k FROM ent e JOIN dl l ON l.from_ref = e.ref JOIN de ON de.ref = e.ref AND de.edge = l.edge)) n
      LEFT JOIN recurring.ent o ON o.request_id = n.request_id AND o.ref = n.to_ref WHERE n.e <= {_RADIUS} AND (o.entered IS NULL OR n.e < o.entered) GROUP BY n.request_id, n.to_ref, n.x, n.z),
    hit AS (SELECT request_id, ref, edge, entered, sqrt({_NEAR_SQL}) AS distance FROM (SELECT e.*, edge, ax, az, bx, bz, {_ALONG_SQL} AS k FROM ent e JOIN de USING (ref) WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.from_ref = de.ref AND dl.edge = de.edge)))
    SELECT request_id, {Q("arg_min(distance, (greatest(entered, distance), distance, ref, edge))")} AS distance, arg_min(ref, (greatest(entered, distance), distance, ref, edge)) AS ref, arg_min(edge, (greatest(entered, distance), distance, ref, edge)) AS edge
    FROM hit WHERE distance <= {_RADIUS} GROUP BY request_id""",
)
def reachable_wall(spark, d):
    """The wall next to each order's place on the decks, among those that can be walked to."""
    rays = W.deck_rays(spark, d)
    key = F.col("request_id")
    points = rays.join(W.decks(spark, d).select(F.col("ref").alias("start_ref")), "start_ref").select("request_id", F.col("start_ref").alias("ref"), (F.col("sx") + (key % 7 - 3) * 1.1).alias("x"), (F.col("sz") + (key % 5 - 2) * 1.3).alias("z"))
    found = L.reachable_wall(points, L.faces(W.deck_edges(spark, d), W.deck_links(spark, d), W.decks(spark, d).select("ref", "cost")), _RADIUS)
    return found.select("request_id", G.quantised(F.col("distance")).alias("distance"), "ref", "edge")


# --- islands: the grid without its water and lava, so that some goals can't be reached

_ISLANDS = "area NOT IN (16, 22)"
_ISLANDS_SQL = f"""{W.GRID_SQL}, ar(area, cost) AS (VALUES (1, 1.0::DOUBLE), (7, 1.0), (10, 1.0)), k AS (SELECT ref, c, r, h, cost FROM g JOIN ar USING (area)), {R.JOURNEYS_SQL},
  pt AS (SELECT request_id, 's' AS side, sx AS x, 0.5::DOUBLE AS y, sz AS z FROM j UNION ALL SELECT request_id, 'g', gx, 0.5, gz FROM j),
  cl AS (SELECT request_id, side, ref, h, x, y, z, least(greatest(x, c), c + 1) AS nx, least(greatest(z, r), r + 1) AS nz, x BETWEEN c AND c + 1 AND z BETWEEN r AND r + 1 AS over FROM pt JOIN k ON c <= x + 6 AND c + 1 >= x - 6 AND r <= z + 6 AND r + 1 >= z - 6 AND h BETWEEN y - 6 AND y + 6),
  sc AS (SELECT *, CASE WHEN over THEN greatest(abs(h - y) - 1.2, 0) ** 2 ELSE (nx - x) ** 2 + (h - y) ** 2 + (nz - z) ** 2 END AS d FROM cl),
  sn AS (SELECT request_id, side, arg_min(ref, (d, ref)) AS ref, arg_min(nx, (d, ref)) AS x, arg_min(h, (d, ref)) AS y, arg_min(nz, (d, ref)) AS z FROM sc GROUP BY ALL),
  q AS (SELECT s.request_id, s.ref AS sr, s.x AS sx, s.y AS sy, s.z AS sz, g.ref AS gr, g.x AS gx, g.y AS gy, g.z AS gz FROM sn s JOIN sn g USING (request_id) WHERE s.side = 's' AND g.side = 'g'),
  dd AS (SELECT a.ref * 100 + b.ref AS node, a.ref AS fr, b.ref AS tr, a.cost AS fc, b.cost AS tc, (a.c + b.c) / 2 + 0.5 AS mx, a.h AS my, (a.r + b.r) / 2 + 0.5 AS mz FROM k a JOIN k b ON abs(a.c - b.c) + abs(a.r - b.r) = 1),
  src AS (SELECT DISTINCT sr, sx, sy, sz, dense_rank() OVER (ORDER BY sr, sx, sy, sz) AS source FROM q)"""


@query(
    "partial_route",
    f"""WITH RECURSIVE {_ISLANDS_SQL}, best(source, node, cost) USING KEY (source, node) AS (SELECT source, node, sqrt((mx - sx) ** 2 + (my - sy) ** 2 + (mz - sz) ** 2) * fc FROM src JOIN dd ON fr = sr
      UNION SELECT n.source, n.node, min(n.cost) FROM (SELECT b.source, e.node, b.cost + sqrt((e.mx - d.mx) ** 2 + (e.my - d.my) ** 2 + (e.mz - d.mz) ** 2) * e.fc AS cost FROM best b JOIN dd d ON d.node = b.node JOIN dd e ON e.fr = d.tr) n
      LEFT JOIN recurring.best o ON o.source = n.source AND o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost - 1e-12 GROUP BY n.source, n.node),
    w AS (SELECT q.*, source FROM q JOIN src USING (sr, sx, sy, sz)),
    full_way AS (SELECT request_id, min(b.cost + sqrt((gx - mx) ** 2 + (gy - my) ** 2 + (gz - mz) ** 2) * tc) AS cost FROM w JOIN dd ON tr = gr JOIN best b ON b.source = w.source AND b.node = dd.node WHERE sr <> gr GROUP BY request_id
      UNION ALL SELECT request_id, sqrt((gx - sx) ** 2 + (gy - sy) ** 2 + (gz - sz) ** 2) * cost FROM w JOIN k ON k.ref = sr WHERE sr = gr),
    stuck AS (SELECT * FROM w WHERE request_id NOT IN (SELECT request_id FROM full_way)),
    inn AS (SELECT source, tr AS end_ref, min(b.cost) AS cost, arg_min(mx, (b.cost, mx, my, mz)) AS mx, arg_min(my, (b.cost, mx, my, mz)) AS my, arg_min(mz, (b.cost, mx, my, mz)) AS mz FROM best b JOIN dd USING (node) GROUP BY source, tr),
    cand AS (SELECT request_id, sqrt((gx - mx) ** 2 + (gy - my) ** 2 + (gz - mz) ** 2) AS rest, cost, end_ref FROM stuck JOIN inn USING (source) WHERE end_ref <> sr
      UNION ALL SELECT request_id, sqrt((gx - sx) ** 2 + (gy - sy) ** 2 + (gz - sz) ** 2), 0.0, sr FROM stuck),
    part_way AS (SELECT request_id, arg_min(cost, (rest, cost, end_ref)) AS cost, arg_min(end_ref, (rest, cost, end_ref)) AS end_ref FROM cand GROUP BY request_id),
    ends AS (SELECT request_id, gr AS end_ref, false AS partial, cost, gx, gy, gz FROM full_way JOIN w USING (request_id)
      UNION ALL SELECT request_id, p.end_ref, true, p.cost, least(greatest(gx, c), c + 1), h, least(greatest(gz, r), r + 1) FROM part_way p JOIN w USING (request_id) JOIN k ON k.ref = p.end_ref)
    SELECT request_id, end_ref, partial, {Q("cost")} AS cost, {Q("gx")} AS gx, {Q("gy")} AS gy, {Q("gz")} AS gz FROM ends""",
)
def partial_route(spark, d):
    """Routes of the orders over the islands; those whose goal lies on another island end at the nearest point that was reached."""
    asked, edges, costs, members = _island_requests(spark, d)
    found = cut(S.routes(asked, R.doors(spark, d), costs, partial=True))
    ends = cut(S.with_ends(asked, found, edges).join(found.select("request_id", "cost"), "request_id").withColumnRenamed("request_id", "path_id"))
    return R.of_members(members, ends).select(F.col("path_id").alias("request_id"), "end_ref", "partial", *(G.quantised(F.col(v)).alias(v) for v in ("cost", "gx", "gy", "gz")))


def _island_requests(spark, d):
    """(different journeys of the orders with both ends on the islands, the islands' edges, their costs, the orders that take each journey)."""
    dry = W.grid_areas(spark, d).filter(_ISLANDS).select("ref")
    edges = W.grid_edges(spark, d).join(dry, "ref", "left_semi")
    costs = R.costs(spark, d).join(dry, "ref", "left_semi")
    asked, members = R.same_journeys(R.journeys(spark, d))
    ends = asked.select("request_id", F.explode(F.array(*(F.struct(F.lit(p).alias("side"), *(F.col(f"{p}{v}").alias(v) for v in "xyz")) for p in "sg"))).alias("p"))
    at = S.nearest(ends.select(F.struct("request_id", "p.side").alias("request_id"), "p.x", "p.y", "p.z"), edges, CLIMB)
    at = at.select("request_id.request_id", "request_id.side", "ref", *"xyz").groupBy("request_id").agg(*(F.max(F.when(F.col("side") == p, F.col(v))).alias(n) for p, r in (("s", "start_ref"), ("g", "goal_ref")) for v, n in (("ref", r), *((v, f"{p}{v}") for v in "xyz"))))
    return cut(at.filter("start_ref IS NOT NULL AND goal_ref IS NOT NULL")), edges, costs, members


# --- shapes

_PENTAGON = ((-1.0, -0.6), (-0.4, 1.0), (0.7, 0.9), (1.0, -0.2), (0.2, -1.0))


def _customers(spark, d):
    """Customers as places on the decks with a pentagon about each: (request_id, start_ref, sx, sy, sz, corners, radius)."""
    k = F.col("c_custkey")
    cell, size = F.floor(k / 2), (k % 4 + 1) * 5.0
    x, z = cell % W.DECK_COLUMNS * 10.0 + 5.13, F.floor(cell / W.DECK_COLUMNS) * 10.0 + 4.87
    corners = N.shape(*((x + size * px, z + size * pz) for px, pz in _PENTAGON))
    return W.table(spark, d, "customer").select(k.alias("request_id"), k.alias("start_ref"), x.alias("sx"), (k % 2 * 8.0 + 0.3).alias("sy"), z.alias("sz"), corners.alias("corners"), size.alias("radius"))


_CUSTOMERS_SQL = f"""cu AS (SELECT c_custkey AS request_id, (c_custkey // 2 % {W.DECK_COLUMNS}) * 10.0::DOUBLE + 5.13 AS sx, (c_custkey % 2) * 8.0::DOUBLE + 0.3 AS sy, (c_custkey // 2 // {W.DECK_COLUMNS}) * 10.0::DOUBLE + 4.87 AS sz, (c_custkey % 4 + 1) * 5.0::DOUBLE AS radius FROM customer)"""
_DOORS_SQL = """dw AS (SELECT l.from_ref, l.to_ref, l.edge, l.bmin, k.cost AS ground, ax + (bx - ax) * (bmin / 255.0::DOUBLE) AS ax, ay + ("by" - ay) * (bmin / 255.0::DOUBLE) AS ay, az + (bz - az) * (bmin / 255.0::DOUBLE) AS az,
  ax + (bx - ax) * (bmax / 255.0::DOUBLE) AS bx, ay + ("by" - ay) * (bmax / 255.0::DOUBLE) AS "by", az + (bz - az) * (bmax / 255.0::DOUBLE) AS bz FROM dl l JOIN de ON de.ref = l.from_ref AND de.edge = l.edge JOIN dk k ON k.ref = l.from_ref),
dw2 AS (SELECT *, row_number() OVER (ORDER BY from_ref, edge, to_ref, bmin) AS portal, (ax + bx) / 2 AS mx, (ay + "by") / 2 AS my, (az + bz) / 2 AS mz FROM dw)"""


def _around_sql(meets: str, start: str) -> str:
    return f"""WITH RECURSIVE {W.DECKS_SQL}, {_CUSTOMERS_SQL}, {_DOORS_SQL}, {start},
    ok AS (SELECT request_id, portal, from_ref, to_ref, ground, mx, my, mz FROM shp, dw2 WHERE ax BETWEEN sx - 45 AND sx + 45 AND az BETWEEN sz - 45 AND sz + 45 AND {meets}),
    best(request_id, portal, cost) USING KEY (request_id, portal) AS (SELECT request_id, portal, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy) + (mz - sz) * (mz - sz)) * ground FROM ok JOIN cu USING (request_id) WHERE from_ref = request_id
      UNION SELECT n.request_id, n.portal, min(n.cost) FROM (SELECT b.request_id, e.portal, b.cost + sqrt((e.mx - d.mx) * (e.mx - d.mx) + (e.my - d.my) * (e.my - d.my) + (e.mz - d.mz) * (e.mz - d.mz)) * e.ground AS cost FROM best b JOIN ok d ON d.request_id = b.request_id AND d.portal = b.portal JOIN ok e ON e.request_id = b.request_id AND e.from_ref = d.to_ref) n
      LEFT JOIN recurring.best o ON o.request_id = n.request_id AND o.portal = n.portal WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.request_id, n.portal),
    ref_cost AS (SELECT request_id, to_ref AS ref, cost FROM best JOIN ok USING (request_id, portal) UNION ALL SELECT request_id, request_id, 0.0 FROM cu JOIN dk ON dk.ref = request_id)
    SELECT request_id, ref, {Q("min(cost)")} AS cost FROM ref_cost GROUP BY request_id, ref"""


_SHAPE_START_SQL = "shp AS (SELECT *, [" + ", ".join(f"{{'x': sx + radius * {x}, 'z': sz + radius * {z}}}" for x, z in _PENTAGON) + "] AS p FROM cu)"
#: A convex shape has a point of a segment unless it lies beyond one of its edges, or all of it on one side of the segment: separating axes.
_SHAPE_MEETS_SQL = """NOT list_aggregate([greatest((p[i % 5 + 1].z - p[i].z) * (ax - p[i].x) - (p[i % 5 + 1].x - p[i].x) * (az - p[i].z), (p[i % 5 + 1].z - p[i].z) * (bx - p[i].x) - (p[i % 5 + 1].x - p[i].x) * (bz - p[i].z)) FOR i IN [1, 2, 3, 4, 5]], 'min') < 0
      AND list_aggregate([(bz - az) * (v.x - ax) - (bx - ax) * (v.z - az) FOR v IN p], 'min') <= 0 AND list_aggregate([(bz - az) * (v.x - ax) - (bx - ax) * (v.z - az) FOR v IN p], 'max') >= 0"""


@query("polys_around_shape", _around_sql(_SHAPE_MEETS_SQL, _SHAPE_START_SQL))
def polys_around_shape(spark, d):
    """Polygons of the decks that each customer reaches through portals within its pentagon, with the way's cost."""
    found = N.polygons_around(_customers(spark, d).withColumn("sides", N.sides_of(F.col("corners"))), S.portals(W.deck_links(spark, d), W.deck_edges(spark, d)), W.decks(spark, d).select("ref", "cost"), N.segment_meets_sides, ["sides"])
    return found.select("request_id", "ref", G.quantised(F.col("cost")).alias("cost"))


_CIRCLE_T = "least(greatest(((sx - ax) * (bx - ax) + (sz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 0.0), 1.0)"


@query("around_circle_cost", _around_sql(f"(ax + {_CIRCLE_T} * (bx - ax) - sx) ** 2 + (az + {_CIRCLE_T} * (bz - az) - sz) ** 2 <= radius * radius", "shp AS (SELECT * FROM cu)"))
def around_circle_cost(spark, d):
    """Polygons of the decks that each customer reaches within its circle, with the way's cost."""
    found = N.polygons_around(_customers(spark, d).withColumn("sides", N.sides_of(F.col("corners"))), S.portals(W.deck_links(spark, d), W.deck_edges(spark, d)), W.decks(spark, d).select("ref", "cost"), N.segment_in_circle, ["sx", "sz", "radius"])
    return found.select("request_id", "ref", G.quantised(F.col("cost")).alias("cost"))


_TRI_SQL = f"""{W.CORNERS_SQL}, tr AS (SELECT o_orderkey AS id, [{', '.join(f"{{'x': {p}x * 0.2 + o_orderkey % 37 * 10, 'z': {p}z * 0.2 + o_orderkey % 23 * 10}}" for p in 'abc')}] AS p FROM t),
cells AS (SELECT ref AS other, list({{'x': ax, 'z': az}} ORDER BY edge) AS p FROM de GROUP BY ref)"""


def _shadow_sql(of: str, other: str, n: int) -> str:
    nx, nz = f"({of}[i % {n} + 1].z - {of}[i].z)", f"({of}[i].x - {of}[i % {n} + 1].x)"
    here, there = (f"[{nx} * v.x + {nz} * v.z FOR v IN {p}]" for p in (of, other))
    return f"len([i FOR i IN range(1, {n + 1}) IF list_aggregate({here}, 'min') + 1e-4 > list_aggregate({there}, 'max') OR list_aggregate({here}, 'max') - 1e-4 < list_aggregate({there}, 'min')]) = 0"


@query(
    "convex_overlap",
    f"""WITH {W.DECKS_SQL}, {_TRI_SQL}, bx1 AS (SELECT id, p, list_aggregate([v.x FOR v IN p], 'min') AS lx, list_aggregate([v.x FOR v IN p], 'max') AS hx, list_aggregate([v.z FOR v IN p], 'min') AS lz, list_aggregate([v.z FOR v IN p], 'max') AS hz FROM tr),
    bx2 AS (SELECT other, p AS q, list_aggregate([v.x FOR v IN p], 'min') AS lx2, list_aggregate([v.x FOR v IN p], 'max') AS hx2, list_aggregate([v.z FOR v IN p], 'min') AS lz2, list_aggregate([v.z FOR v IN p], 'max') AS hz2 FROM cells),
    pairs AS (SELECT id, other, p, q FROM bx1 JOIN bx2 ON lx <= hx2 AND lx2 <= hx AND lz <= hz2 AND lz2 <= hz)
    SELECT id, other FROM pairs WHERE {_shadow_sql("p", "q", 3)} AND {_shadow_sql("q", "p", 4)}""",
)
def convex_overlap(spark, d):
    """Triangles of orders that overlap cells of the decks."""
    key = F.col("o_orderkey")
    corners = N.shape(*((F.col(f"{p}x") * 0.2 + key % 37 * 10, F.col(f"{p}z") * 0.2 + key % 23 * 10) for p in "abc"))
    shapes = W.corners(spark, d).select(key.alias("id"), corners.alias("corners"))
    cells = W.deck_edges(spark, d).groupBy(F.col("ref").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge", "ax", "az"))), lambda s: F.struct(s["ax"].alias("x"), s["az"].alias("z"))).alias("corners"))  # four corners
    return N.overlapping(shapes, cells)


@query("local_neighbourhood")
def local_neighbourhood(spark, d):
    """Rings of polygons about each customer's place on the decks, with stairs between the floors: no two lie over each other unless linked."""
    links = W.deck_links(spark, d).unionByName(W.deck_stairs(spark, d))
    around = L.faces(W.deck_edges(spark, d), links, W.decks(spark, d).select("ref", "cost"))
    points = _customers(spark, d).select("request_id", F.col("start_ref").alias("ref"), F.col("sx").alias("x"), F.col("sz").alias("z"))
    return N.local_neighbourhood(points, around, 18.0)


# --- off-mesh connections


def _connections(spark, d):
    """Suppliers as jumps between places of the grid."""
    k = F.col("s_suppkey")
    a, b = (k % 5 + 0.55, F.lit(0.5), F.floor(k / 5) % 5 + 0.45), ((k * 3 + 2) % 5 + 0.4, F.lit(0.5), F.floor(k * 7 / 3) % 5 + 0.6)
    return W.table(spark, d, "supplier").select(k.alias("id"), *(v.cast("double").alias(f"{p}{n}") for p, q in (("a", a), ("b", b)) for n, v in zip("xyz", q, strict=True)), F.lit(0.7).alias("radius"), (k % 2 == 0).alias("both"), (1.0 + k % 3).alias("cost"))


@query(
    "off_mesh_route",
    f"""WITH RECURSIVE {_ISLANDS_SQL}, oc AS (SELECT s_suppkey AS id, s_suppkey % 5 + 0.55::DOUBLE AS ax, s_suppkey // 5 % 5 + 0.45::DOUBLE AS az, (s_suppkey * 3 + 2) % 5 + 0.4::DOUBLE AS bx, s_suppkey * 7 // 3 % 5 + 0.6::DOUBLE AS bz, s_suppkey % 2 = 0 AS two_way, 1.0::DOUBLE + s_suppkey % 3 AS cost FROM supplier),
    oe AS (SELECT id, 's' AS side, ax AS x, az AS z FROM oc UNION ALL SELECT id, 'e', bx, bz FROM oc),
    on1 AS (SELECT id, side, ref, h, x, z, least(greatest(x, c), c + 1) AS nx, least(greatest(z, r), r + 1) AS nz, x BETWEEN c AND c + 1 AND z BETWEEN r AND r + 1 AS over FROM oe JOIN k ON c <= x + 0.7 AND c + 1 >= x - 0.7 AND r <= z + 0.7 AND r + 1 >= z - 0.7 AND h BETWEEN 0.5 - 1.2 AND 0.5 + 1.2),
    on2 AS (SELECT *, CASE WHEN over THEN greatest(abs(h - 0.5) - 1.2, 0) ** 2 ELSE (nx - x) ** 2 + (h - 0.5) ** 2 + (nz - z) ** 2 END AS d FROM on1),
    on3 AS (SELECT id, side, any_value(x) AS x0, any_value(z) AS z0, arg_min(ref, (d, ref)) AS ref, arg_min(nx, (d, ref)) AS x, arg_min(h, (d, ref)) AS y, arg_min(nz, (d, ref)) AS z FROM on2 GROUP BY id, side),
    on4 AS (SELECT * FROM on3 WHERE (x - x0) ** 2 + (z - z0) ** 2 <= 0.7::DOUBLE * 0.7::DOUBLE),
    os AS (SELECT oc.id, two_way, oc.cost, s.ref AS sref, s.x AS sx0, s.y AS sy0, s.z AS sz0, ks.cost AS sc, e.ref AS eref, e.x AS ex0, e.y AS ey0, e.z AS ez0, ke.cost AS ec FROM oc JOIN on4 s ON s.id = oc.id AND s.side = 's' JOIN on4 e ON e.id = oc.id AND e.side = 'e' JOIN k ks ON ks.ref = s.ref JOIN k ke ON ke.ref = e.ref),
    da AS (SELECT fr, tr, fc, tc, mx, my, mz FROM dd UNION ALL SELECT sref, -1 - id, sc, cost, sx0, sy0, sz0 FROM os UNION ALL SELECT -1 - id, eref, cost, ec, ex0, ey0, ez0 FROM os
      UNION ALL SELECT eref, -1 - id, ec, cost, ex0, ey0, ez0 FROM os WHERE two_way UNION ALL SELECT -1 - id, sref, cost, sc, sx0, sy0, sz0 FROM os WHERE two_way),
    dn AS (SELECT *, row_number() OVER (ORDER BY fr, tr, mx, mz) AS node FROM da),
    best(source, node, cost) USING KEY (source, node) AS (SELECT source, node, sqrt((mx - sx) ** 2 + (my - sy) ** 2 + (mz - sz) ** 2) * fc FROM src JOIN dn ON fr = sr
      UNION SELECT n.source, n.node, min(n.cost) FROM (SELECT b.source, e.node, b.cost + sqrt((e.mx - d.mx) ** 2 + (e.my - d.my) ** 2 + (e.mz - d.mz) ** 2) * e.fc AS cost FROM best b JOIN dn d ON d.node = b.node JOIN dn e ON e.fr = d.tr) n
      LEFT JOIN recurring.best o ON o.source = n.source AND o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost - 1e-12 GROUP BY n.source, n.node),
    w AS (SELECT q.*, source FROM q JOIN src USING (sr, sx, sy, sz)),
    way AS (SELECT request_id, min(b.cost + sqrt((gx - mx) ** 2 + (gy - my) ** 2 + (gz - mz) ** 2) * tc) AS cost FROM w JOIN dn ON tr = gr JOIN best b ON b.source = w.source AND b.node = dn.node WHERE sr <> gr GROUP BY request_id
      UNION ALL SELECT request_id, sqrt((gx - sx) ** 2 + (gy - sy) ** 2 + (gz - sz) ** 2) * cost FROM w JOIN k ON k.ref = sr WHERE sr = gr)
    SELECT request_id, {Q("cost")} AS cost FROM way""",
)
def off_mesh_route(spark, d):
    """Routes of the orders over the islands and the jumps between them."""
    asked, edges, costs, members = _island_requests(spark, d)
    doors, jumps = O.off_mesh_doors(cut(O.without_copies(O.snap_connections(_connections(spark, d), edges, CLIMB))))
    found = S.routes(asked, R.doors(spark, d).join(costs.select(F.col("ref").alias("from_ref")), "from_ref", "left_semi").unionByName(doors), costs.unionByName(jumps))
    found = cut(found.select(F.col("request_id").alias("path_id"), G.quantised(F.col("cost")).alias("cost")))
    return R.of_members(members, found).select(F.col("path_id").alias("request_id"), "cost")


# --- points on polygons and triangles, changes of polygons


@query(
    "boundary_points",
    f"""WITH {W.DECKS_SQL}, {W.DECK_RAYS_SQL}, q AS (SELECT request_id, start_ref AS ref, sx + (request_id % 17 - 8) * 1.07 AS x, sy AS y, sz + (request_id % 11 - 5) * 1.13 AS z FROM ray JOIN dk ON dk.ref = start_ref),
    s AS (SELECT request_id, q.ref, x, y, z, edge, ax, ay, az, bx, "by", bz, {_ALONG_SQL} AS k, CASE WHEN ((az > z) <> (bz > z)) AND x < (bx - ax) * (z - az) / (CASE WHEN bz <> az THEN bz - az END) + ax THEN 1 ELSE 0 END AS hit FROM q JOIN de USING (ref)),
    n AS (SELECT *, {_NEAR_SQL} AS d FROM s),
    b AS (SELECT request_id, ref, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, sum(hit) % 2 = 1 AS inside, arg_min(ax + k * (bx - ax), (d, edge)) AS ex, arg_min(ay + k * ("by" - ay), (d, edge)) AS ey, arg_min(az + k * (bz - az), (d, edge)) AS ez FROM n GROUP BY request_id, ref)
    SELECT request_id, ref, inside, {Q("CASE WHEN inside THEN x ELSE ex END")} AS x, {Q("CASE WHEN inside THEN y ELSE ey END")} AS y, {Q("CASE WHEN inside THEN z ELSE ez END")} AS z FROM b""",
)
def boundary_points(spark, d):
    """Places of the orders, those beside their cell moved onto its boundary."""
    key = F.col("request_id")
    pairs = W.deck_rays(spark, d).select("request_id", (F.col("sx") + (key % 17 - 8) * 1.07).alias("px"), F.col("sy").alias("py"), (F.col("sz") + (key % 11 - 5) * 1.13).alias("pz"), F.col("start_ref").alias("ref"))
    found = S.boundary_points(pairs, W.deck_edges(spark, d))
    return found.select("request_id", "ref", "inside", *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


def _side_sql(a: str, b: str) -> str:
    d = {v: f"({b}{v} - {a}{v})" for v in "xyz"}
    return f"least(greatest(((px - {a}x) * {d['x']} + (py - {a}y) * {d['y']} + (pz - {a}z) * {d['z']}) / ({d['x']} * {d['x']} + {d['y']} * {d['y']} + {d['z']} * {d['z']}), 0.0), 1.0)"


_SIDES3_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS i, px, py, pz, {a}x + k * ({b}x - {a}x) AS x, {a}y + k * ({b}y - {a}y) AS y, {a}z + k * ({b}z - {a}z) AS z FROM (SELECT *, {_side_sql(a, b)} AS k FROM w)" for i, (a, b) in enumerate((("a", "q"), ("q", "c"), ("c", "a")))
)


@query(
    "closest_on_triangle",
    f"""WITH {W.CORNERS_SQL}, w AS (SELECT o_orderkey, ax, ay, az, bx AS qx, b_y AS qy, bz AS qz, cx, cy, cz, (o_orderkey * 31 % 97)::DOUBLE AS px, (o_orderkey * 13 % 41)::DOUBLE AS py, (o_orderkey * 17 % 89)::DOUBLE AS pz FROM t),
    e AS (SELECT *, (qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) + (qz - az) * (qz - az) AS uu, (qx - ax) * (cx - ax) + (qy - ay) * (cy - ay) + (qz - az) * (cz - az) AS uv, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) + (cz - az) * (cz - az) AS vv,
      (px - ax) * (qx - ax) + (py - ay) * (qy - ay) + (pz - az) * (qz - az) AS wu, (px - ax) * (cx - ax) + (py - ay) * (cy - ay) + (pz - az) * (cz - az) AS wv FROM w),
    f AS (SELECT *, (vv * wu - uv * wv) / (CASE WHEN uu * vv - uv * uv > 1e-6 THEN uu * vv - uv * uv END) AS s, (uu * wv - uv * wu) / (CASE WHEN uu * vv - uv * uv > 1e-6 THEN uu * vv - uv * uv END) AS t FROM e),
    sd AS ({_SIDES3_SQL}), n AS (SELECT o_orderkey, arg_min(x, ((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), i)) AS x, arg_min(y, ((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), i)) AS y, arg_min(z, ((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), i)) AS z FROM sd GROUP BY o_orderkey),
    res AS (SELECT o_orderkey, coalesce(s >= 0 AND t >= 0 AND s + t <= 1, false) AS within, CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN ax + s * (qx - ax) + t * (cx - ax) ELSE n.x END AS x, CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN ay + s * (qy - ay) + t * (cy - ay) ELSE n.y END AS y, CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN az + s * (qz - az) + t * (cz - az) ELSE n.z END AS z FROM f JOIN n USING (o_orderkey))
    SELECT o_orderkey, {Q("x")} AS x, {Q("y")} AS y, {Q("z")} AS z FROM res""",
)
def closest_on_triangle(spark, d):
    """The point of each orders' triangle that is nearest to a place in space."""
    key = F.col("o_orderkey")
    place = tuple((key * m % n).cast("double") for m, n in ((31, 97), (13, 41), (17, 89)))
    at = G.closest_on_triangle(place, *(tuple(F.col(f"{c}{v}") for v in "xyz") for c in "abc"))
    return W.corners(spark, d).select("o_orderkey", at.alias("p")).select("o_orderkey", *(G.quantised(F.col(f"p.{v}")).alias(v) for v in "xyz"))


@query(
    "set_polygons",
    """WITH c AS (SELECT l_partkey AS ref, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 25 THEN CAST(l_suppkey % 27 + 1 AS INT) END AS area, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS INT) END AS flags FROM lineitem),
    a AS (SELECT ref, max(area) AS area FROM c JOIN (SELECT ref, max(seq) AS seq FROM c WHERE area IS NOT NULL GROUP BY ref) USING (ref, seq) WHERE area IS NOT NULL GROUP BY ref), f AS (SELECT ref, max(flags) AS flags FROM c JOIN (SELECT ref, max(seq) AS seq FROM c WHERE flags IS NOT NULL GROUP BY ref) USING (ref, seq) WHERE flags IS NOT NULL GROUP BY ref)
    SELECT p_partkey AS ref, coalesce(a.area, 1) AS area, coalesce(f.flags, 4) AS flags FROM part LEFT JOIN a ON a.ref = p_partkey LEFT JOIN f ON f.ref = p_partkey""",
)
def set_polygons(spark, d):
    """Parts as polygons, line items as changes of their area and flags."""
    from ..operators import meshes as M

    polys = W.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.lit(1).alias("area"), F.lit(4).alias("flags"))
    items = W.table(spark, d, "lineitem")
    changes = items.select(F.col("l_partkey").alias("ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_quantity") > 25, (F.col("l_suppkey") % 27 + 1).cast("int")).alias("area"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("int")).alias("flags"))
    # of changes of one seq, those of the greatest values count
    changes = changes.groupBy("ref", "seq").agg(F.max("area").alias("area"), F.max("flags").alias("flags"))
    return M.set_polygons(polys, changes)
