"""Queries on scalars, areas, rectangles, heightfields and smoothing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas as A
from ..functions import geometry as G
from ..operators import columns as C
from ..operators import paths as P
from ..operators import regions as R
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


AREA_VALUES = ", ".join(f"({a}, '{k}', {f}, {g}, {c})" for a, k, f, g, c in A.area_rows())
AREAS_SQL = f"areas(area, kind, faction, flags, cost) AS (VALUES {AREA_VALUES})"


@query("coord_roundtrip", f"WITH {W.POINTS_SQL} SELECT event_id, y AS mesh_x, z AS mesh_y, x AS mesh_z, x AS game_x, y AS game_y, z AS game_z FROM pts")
def coord_roundtrip(spark, d):
    point = F.struct("x", "y", "z")
    mesh = G.to_mesh(point)
    out = W.points(spark, d).withColumn("m", mesh).withColumn("g", G.to_game(F.col("m")))
    return out.select("event_id", *(F.col(f"{s}.{v}").alias(f"{n}_{v}") for s, n in (("m", "mesh"), ("g", "game")) for v in "xyz"))


@query("world_to_tile", f"SELECT event_id, CAST(trunc(32 - (value - 250) * 100 / {G.TILE_SIZE}) AS INT) AS tile, {Q(f'(32 - trunc(32 - (value - 250) * 100 / {G.TILE_SIZE})) * {G.TILE_SIZE}')} AS edge FROM events")
def world_to_tile(spark, d):
    tile = G.world_to_tile((F.col("x") - 250) * 100)
    return W.points(spark, d).select("event_id", tile.alias("tile"), G.quantised(G.tile_to_world(tile)).alias("edge"))


@query("mesh_tile_loc", "SELECT event_id, CAST(floor((value - (SELECT min(value) FROM events)) / 50) AS BIGINT) AS tx, CAST(floor(user_id / 50) AS BIGINT) AS tz FROM events")
def mesh_tile_loc(spark, d):
    points = W.points(spark, d)
    origin = F.lit(points.agg(F.min("x")).first()[0])
    return points.select("event_id", G.mesh_tile(F.col("x"), origin, 50.0).alias("tx"), G.mesh_tile(F.col("z"), F.lit(0.0), 50.0).alias("tz"))


@query("flag_filter", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS flags FROM lineitem WHERE (CAST(trunc(l_quantity) AS INT) & 6) <> 0 AND (CAST(trunc(l_quantity) AS INT) & 1) = 0")
def flag_filter(spark, d):
    rows = W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("flags"))
    return rows.filter(G.passes(F.col("flags"), F.lit(6), F.lit(1)))


@query("area_flags", f"WITH {AREAS_SQL} SELECT p_partkey, areas.area, kind, faction, flags FROM part JOIN areas ON areas.area = 1 + p_size % 27")
def area_flags(spark, d):
    parts = W.table(spark, d, "part").select("p_partkey", (1 + F.col("p_size") % 27).alias("area"))
    return parts.join(F.broadcast(A.areas(spark)), "area").select("p_partkey", "area", "kind", "faction", "flags")


DEFAULTS_SQL = f"""{AREAS_SQL}, states(state, danger) AS (VALUES ('normal', -1), ('alliance', 2), ('horde', 1), ('dead', -1)),
defaults AS (SELECT state, area, CASE WHEN state = 'dead' THEN 1.0 WHEN faction = danger AND kind NOT IN ('lava', 'slime') THEN cost * 3.0 ELSE cost END AS cost FROM areas, states WHERE area > 0)"""


@query("filter_defaults", f"WITH {DEFAULTS_SQL} SELECT state, area, {Q('cost')} AS cost FROM defaults")
def filter_defaults(spark, d):
    return A.default_costs(spark).select("state", "area", G.quantised(F.col("cost")).alias("cost"))


_MMAP_SQL = ", ".join(f"('{k}', '{st}', {inc}, {exc}, {costs.get(1, 1.0)}::DOUBLE, {costs.get(2, 1.0)}::DOUBLE, {costs.get(4, 1.0)}::DOUBLE, {costs.get(8, 1.0)}::DOUBLE)" for k, st, inc, exc, costs in A.mmap_rows())


@query(
    "mmap_filter",
    f"""WITH f(format, state, inc, exc, c1, c2, c4, c8) AS (VALUES {_MMAP_SQL})
    SELECT p_partkey, format, state, CASE p_size % 10 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 4 THEN c4 WHEN 8 THEN c8 ELSE 1.0::DOUBLE END AS cost FROM part, f WHERE (p_size % 16) & inc <> 0 AND (p_size % 16) & exc = 0""",
)
def mmap_filter(spark, d):
    """Parts as polygons of the older formats: which walkers may enter each, and at what cost."""
    polys = W.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 16).alias("flags"), (F.col("p_size") % 10).alias("area"))
    asked = polys.join(F.broadcast(A.mmap_filters(spark)))  # eight filters
    kept = asked.filter(G.passes(F.col("flags"), F.col("include"), F.col("exclude")))
    return kept.select("p_partkey", "format", "state", F.coalesce(F.try_element_at("costs", F.col("area")), F.lit(1.0)).alias("cost"))


@query(
    "filter_override",
    f"""WITH {DEFAULTS_SQL}, last AS (SELECT user_id AS client_id, CAST(event_id % 27 + 1 AS INT) AS area, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
    clients AS (SELECT DISTINCT user_id AS client_id FROM events)
    SELECT c.client_id, d.area, {Q("coalesce(last.value, d.cost)")} AS cost FROM clients c JOIN defaults d ON d.state = 'normal' LEFT JOIN last ON last.client_id = c.client_id AND last.area = d.area""",
)
def filter_override(spark, d):
    from ..operators.session import resolve_filters

    events = W.table(spark, d, "events").select(F.col("user_id").alias("client_id"), F.struct("ts", "event_id").alias("seq"), F.lit("normal").alias("state"), (F.col("event_id") % 27 + 1).cast("int").alias("area"), F.col("value").alias("cost"))
    return resolve_filters(events, A.default_costs(spark)).select("client_id", "area", G.quantised(F.col("cost")).alias("cost"))


@query("poly_area", f"WITH {W.CORNERS_SQL} SELECT o_orderkey, {Q('(cx - ax) * (bz - az) - (bx - ax) * (cz - az)')} AS area2 FROM t")
def poly_area(spark, d):
    return W.corners(spark, d).select("o_orderkey", G.quantised(G.cross_2d(*(F.col(c) for c in ("ax", "az", "bx", "bz", "cx", "cz")))).alias("area2"))


@query(
    "slope_clear",
    f"""WITH {W.CORNERS_SQL}, n AS (SELECT o_orderkey, (b_y - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS nz FROM t)
    SELECT o_orderkey, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 0 AND ny / sqrt(nx * nx + ny * ny + nz * nz) > cos(radians(55.0)) THEN 1 ELSE 0 END AS area FROM n""",
)
def slope_clear(spark, d):
    from ..operators.meshes import slope_area

    return W.corners(spark, d).withColumn("area", F.lit(1)).select("o_orderkey", slope_area().alias("area"))


@query("point_seg_dist", f"""WITH {W.CORNERS_SQL}, s AS (SELECT *, (bx - ax) * (bx - ax) + (bz - az) * (bz - az) AS l FROM t),
    u AS (SELECT *, CASE WHEN l > 0 THEN least(greatest(((cx - ax) * (bx - ax) + (cz - az) * (bz - az)) / l, 0.0), 1.0) ELSE 0.0 END AS q FROM s)
    SELECT o_orderkey, {Q("(ax + q * (bx - ax) - cx) * (ax + q * (bx - ax) - cx) + (az + q * (bz - az) - cz) * (az + q * (bz - az) - cz)")} AS d FROM u""")
def point_seg_dist(spark, d):
    c = [F.col(n) for n in ("cx", "cz", "ax", "az", "bx", "bz")]
    return W.corners(spark, d).select("o_orderkey", G.quantised(G.segment_distance_sq(*c)).alias("d"))


@query("tri_height", f"""WITH {W.CORNERS_SQL}, s AS (SELECT *, 0.2 * ax + 0.3 * bx + 0.5 * cx AS px, 0.2 * az + 0.3 * bz + 0.5 * cz AS pz, abs((cx - ax) * (bz - az) - (cz - az) * (bx - ax)) AS area FROM t)
    SELECT o_orderkey, CASE WHEN area > 1e-6 THEN CAST(floor((0.2 * ay + 0.3 * b_y + 0.5 * cy) * 1e6 + 0.371) AS BIGINT) ELSE -1 END AS h FROM s""")
def tri_height(spark, d):
    at = {v: 0.2 * F.col(f"a{v}") + 0.3 * F.col(f"b{v}") + 0.5 * F.col(f"c{v}") for v in "xz"}
    height = G.triangle_height(at["x"], at["z"], *(tuple(F.col(f"{p}{v}") for v in "xyz") for p in "abc"))
    return W.corners(spark, d).select("o_orderkey", F.coalesce(G.quantised(height), F.lit(-1)).alias("h"))


POLYGONS = {1: [(10, 10), (200, 20), (120, 140)], 2: [(0, 0), (0, 75), (75, 75), (75, 0)], 3: [(300, 5), (450, 60), (380, 145), (310, 90)], 4: [(50, 50), (480, 55), (470, 61)], 5: [(250, 0), (260, 150), (240, 150)]}
POLYGON_EDGES = [(p, float(a[0]) + 0.137, float(a[1]) + 0.291, float(b[0]) + 0.137, float(b[1]) + 0.291) for p, v in POLYGONS.items() for a, b in zip(v, v[1:] + v[:1], strict=True)]
EDGES_SQL = "e(poly, ax, az, bx, bz) AS (VALUES " + ", ".join(f"({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {dd}::DOUBLE)" for p, a, b, c, dd in POLYGON_EDGES) + ")"


@query("point_in_poly", f"""WITH {W.POINTS_SQL}, {EDGES_SQL} SELECT event_id, poly FROM pts, e WHERE (az > z) <> (bz > z) AND x < (bx - ax) * (z - az) / (bz - az) + ax GROUP BY event_id, poly HAVING count(*) % 2 = 1""")
def point_in_poly(spark, d):
    """Polygons are put in the buckets of their boxes; a point meets the edges of those alone."""
    edges = spark.createDataFrame(POLYGON_EDGES, "poly int, ax double, az double, bx double, bz double")
    boxes = edges.groupBy("poly").agg(F.min("ax").alias("minx"), F.max("ax").alias("maxx"), F.min("az").alias("minz"), F.max("az").alias("maxz"))
    near = R.rects_at(W.points(spark, d), boxes, 64.0).select("event_id", "x", "z", "poly").join(F.broadcast(edges), "poly")
    crossing = G.crosses_edge(*(F.col(c) for c in ("x", "z", "ax", "az", "bx", "bz")))
    return near.filter(crossing).groupBy("event_id", "poly").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("event_id", "poly")


@query("aabb_overlap", f"WITH {W.POINTS_SQL}, {W.RECTS_SQL} SELECT rect_seq, count(*) AS n FROM pts JOIN r ON x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz GROUP BY rect_seq")
def aabb_overlap(spark, d):
    return R.rects_at(W.points(spark, d), W.rects(spark, d).select("rect_seq", "minx", "maxx", "minz", "maxz")).groupBy("rect_seq").agg(F.count("*").alias("n"))


HEIGHT_SQL = """(h0 + (h1 - h0) * least(greatest((x - minx) / (maxx - minx), 0.0), 1.0)) + ((h2 + (h3 - h2) * least(greatest((x - minx) / (maxx - minx), 0.0), 1.0))
    - (h0 + (h1 - h0) * least(greatest((x - minx) / (maxx - minx), 0.0), 1.0))) * least(greatest((z - minz) / (maxz - minz), 0.0), 1.0)"""


@query("water_lookup", f"""WITH {W.POINTS_SQL}, {W.RECTS_SQL}, f AS (SELECT event_id, type, rect_seq, {HEIGHT_SQL} AS height FROM pts JOIN r ON x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz WHERE kind = 0)
    SELECT event_id, {Q("max(height)")} AS height, arg_max(type, (height, -rect_seq)) AS type FROM f GROUP BY event_id""")
def water_lookup(spark, d):
    found = R.water_at(W.points(spark, d), W.rects(spark, d).filter("kind = 0"), "event_id")
    return found.select("event_id", G.quantised(F.col("height")).alias("height"), "type")


@query("road_lookup", f"WITH {W.POINTS_SQL}, {W.RECTS_SQL} SELECT event_id FROM pts WHERE EXISTS (SELECT 1 FROM r WHERE kind = 1 AND x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz)")
def road_lookup(spark, d):
    return R.covered(W.points(spark, d), W.rects(spark, d).filter("kind = 1"), "event_id").select("event_id")


WATER_SQL = f"""{W.MARKED_SQL}, {W.RECTS_SQL}, wet AS (SELECT span_id, arg_min(type, rect_seq) AS type FROM sp JOIN r ON x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz
  WHERE kind = 0 AND NOT area BETWEEN 10 AND 27 AND y * 0.2 <= greatest(h0, h1, h2, h3) + 0.5 AND NOT EXISTS (SELECT 1 FROM sp a WHERE a.x = sp.x AND a.z = sp.z AND a.area BETWEEN 10 AND 15 AND a.y > sp.y AND (a.y - sp.y) * 0.2 <= 3 * 0.2) GROUP BY span_id),
m1 AS (SELECT sp.span_id, x, z, y, coalesce(wet.type, area) AS area FROM sp LEFT JOIN wet USING (span_id))"""
GROUND_SQL = """{out} AS (SELECT span_id, x, z, y, CASE WHEN area IN (1, 63) AND EXISTS (SELECT 1 FROM r WHERE kind = {kind} AND x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz) THEN {area} ELSE area END AS area FROM {src})"""
FACTION_SQL = """m4 AS (SELECT s.span_id, s.area + CASE WHEN s.area BETWEEN 1 AND 27 AND (s.area - 1) % 3 = 0 THEN coalesce(f.faction, 0) ELSE 0 END AS area FROM m3 s
  LEFT JOIN (SELECT span_id, arg_min(faction, rect_seq) AS faction FROM m3 JOIN r ON x BETWEEN minx AND maxx AND z BETWEEN minz AND maxz WHERE kind = 3 GROUP BY span_id) f USING (span_id))"""


@query("mark_water", f"WITH {WATER_SQL} SELECT span_id, area FROM m1")
def mark_water(spark, d):
    return R.mark_water(W.marked_spans(spark, d), W.rects(spark, d).filter("kind = 0"), 0.2).select("span_id", "area")


@query("mark_areas", f"WITH {WATER_SQL}, {GROUND_SQL.format(out='m2', kind=1, area=4, src='m1')}, {GROUND_SQL.format(out='m3', kind=2, area=7, src='m2')}, {FACTION_SQL} SELECT span_id, area FROM m4")
def mark_areas(spark, d):
    rects = W.rects(spark, d)
    return R.mark_all(W.marked_spans(spark, d), *(rects.filter(F.col("kind") == k) for k in range(4)), 0.2).select("span_id", "area")


@query("span_coalesce", f"WITH {W.SPANS_SQL} SELECT * FROM spans")
def span_coalesce(spark, d):
    return W.spans(spark, d)


@query("low_hanging", f"""WITH {W.SPANS_SQL}, l AS (SELECT *, lag(area) OVER w AS below, lag(smax) OVER w AS top FROM spans WINDOW w AS (PARTITION BY x, z ORDER BY smin, smax))
    SELECT x, z, smin, smax, CASE WHEN area = 0 AND below > 0 AND smax - top <= 6 THEN below ELSE area END AS area FROM l""")
def low_hanging(spark, d):
    return C.filter_low_obstacles(W.spans(spark, d).select("x", "z", "smin", "smax", "area"))


@query("low_ceiling", f"""WITH {W.SPANS_SQL}, l AS (SELECT *, lead(smin) OVER (PARTITION BY x, z ORDER BY smin, smax) AS above FROM spans)
    SELECT x, z, smin, smax, CASE WHEN coalesce(above, 65535) - smax < 10 THEN 0 ELSE area END AS area FROM l""")
def low_ceiling(spark, d):
    return C.filter_low_ceilings(W.spans(spark, d).select("x", "z", "smin", "smax", "area"))


DIRS_SQL = "dirs(dir, dx, dz) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1))"
OPEN_SQL = f"{W.SPANS_SQL}, os AS (SELECT x, z, smin, smax, area, smax AS floor, coalesce(lead(smin) OVER (PARTITION BY x, z ORDER BY smin, smax), 65535) AS ceiling FROM spans)"


@query(
    "ledge_filter",
    f"""WITH {OPEN_SQL}, {DIRS_SQL},
    gaps AS (SELECT x, z, floor, ceiling, true AS solid FROM os UNION ALL SELECT x, z, -6, min(smin), false FROM os GROUP BY x, z),
    asked AS (SELECT os.*, x + dx AS nx, z + dz AS nz FROM os, dirs WHERE area > 0),
    b AS (SELECT a.x, a.z, a.smin, a.smax, a.floor, a.ceiling, NOT (nx BETWEEN 0 AND 63 AND nz BETWEEN 0 AND 63) AS outside, coalesce(g.floor, -6) AS nf, coalesce(g.ceiling, 65535) AS nc, coalesce(g.solid, false) AS solid FROM asked a LEFT JOIN gaps g ON g.x = nx AND g.z = nz),
    s AS (SELECT x, z, smin, smax, floor, min(CASE WHEN outside OR least(ceiling, nc) - greatest(floor, nf) > 10 THEN nf - floor END) AS dropped,
      min(CASE WHEN NOT outside AND solid AND least(ceiling, nc) - greatest(floor, nf) > 10 AND abs(nf - floor) <= 6 THEN nf END) AS low, max(CASE WHEN NOT outside AND solid AND least(ceiling, nc) - greatest(floor, nf) > 10 AND abs(nf - floor) <= 6 THEN nf END) AS high FROM b GROUP BY ALL),
    bad AS (SELECT x, z, smin, smax FROM s WHERE coalesce(dropped, 65535) < -6 OR greatest(coalesce(high, floor), floor) - least(coalesce(low, floor), floor) > 6)
    SELECT os.x, os.z, os.smin, os.smax, CASE WHEN bad.x IS NULL THEN area ELSE 0 END AS area FROM os LEFT JOIN bad USING (x, z, smin, smax)""",
)
def ledge_filter(spark, d):
    return C.filter_ledges(W.spans(spark, d).select("x", "z", "smin", "smax", "area"), 64, 64)


@query("neighbour_links", f"""WITH {OPEN_SQL}, {DIRS_SQL}, sp AS (SELECT *, row_number() OVER (PARTITION BY x, z ORDER BY smin, smax) - 1 AS layer FROM os WHERE area > 0)
    SELECT a.x, a.z, a.layer, dir, min(b.layer) AS to_layer FROM sp a, dirs JOIN sp b ON b.x = a.x + dx AND b.z = a.z + dz
    WHERE least(a.ceiling, b.ceiling) - greatest(a.floor, b.floor) >= 10 AND abs(b.floor - a.floor) <= 6 AND a.layer <= 62 AND b.layer <= 62 GROUP BY ALL""")
def neighbour_links(spark, d):
    return C.neighbour_links(W.spans(spark, d))


CELLS_SQL = f"{W.SPANS_SQL}, cells AS (SELECT x, z, arg_max(area, layer) AS area FROM spans GROUP BY x, z)"


def top_cells(spark, d):
    return W.spans(spark, d).groupBy("x", "z").agg(F.max_by("area", "layer").alias("area"))


@query("median_areas", f"""WITH {CELLS_SQL}, n AS (SELECT c.x, c.z, c.area AS own, CASE WHEN coalesce(o.area, 0) > 0 THEN o.area ELSE c.area END AS seen
    FROM cells c, (SELECT unnest([-1, 0, 1]) AS dx) AS sx, (SELECT unnest([-1, 0, 1]) AS dz) AS sz LEFT JOIN cells o ON o.x = c.x + dx AND o.z = c.z + dz)
    SELECT x, z, CASE WHEN any_value(own) = 0 THEN 0 ELSE list_sort(list(seen))[5] END AS area FROM n GROUP BY x, z""")
def median_areas(spark, d):
    return C.median_areas(top_cells(spark, d))


# --- paths


@query("path_stats", f"""WITH {W.PATHS_SQL}, l AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS leg FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq))
    SELECT path_id, count(*) AS points, CAST(floor(coalesce(sum(leg), 0) * 1e4 + 0.371) AS BIGINT) AS length, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM l GROUP BY path_id""")
def path_stats(spark, d):
    return P.stats(W.polylines(spark, d)).withColumn("length", F.floor(F.col("length") * 1e4 + 0.371))


def _rounded(paths):
    return paths.select("path_id", F.col("seq").cast("long").alias("seq"), *(G.quantised(F.col(v)).alias(v) for v in "xyz"))


ROUNDED = f"path_id, CAST(seq AS BIGINT) AS seq, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z"


_CHAIKIN = f"""WITH {W.PATHS_SQL}, l AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    c AS (SELECT path_id, seq + s AS place, (1 - s) * x + s * x1 AS x, (1 - s) * y + s * y1 AS y, (1 - s) * z + s * z1 AS z FROM l, (SELECT unnest([0.25::DOUBLE, 0.75::DOUBLE]) AS s) WHERE x1 IS NOT NULL
      UNION ALL SELECT path_id, 0.0, x, y, z FROM l WHERE seq = 0 UNION ALL SELECT path_id, seq, x, y, z FROM l WHERE x1 IS NULL AND seq > 0),
    o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY place) - 1 AS seq, x, y, z FROM c) SELECT path_id, seq, x, y, z FROM o"""


@query("chaikin", f"SELECT {ROUNDED} FROM ({_CHAIKIN})")
def chaikin(spark, d):
    return _rounded(P.chaikin(W.polylines(spark, d)))


_BEZIER = f"""WITH {W.PATHS_SQL}, l AS (SELECT *, {", ".join(f"lead({v}, {n}) OVER w AS {v}{n}" for v in "xyz" for n in (1, 2, 3))} FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    k AS (SELECT *, k / 7.0::DOUBLE AS t, 1 - k / 7.0::DOUBLE AS u FROM l, (SELECT unnest(range(8)) AS k) WHERE seq % 3 = 0 AND x3 IS NOT NULL),
    o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq, k) - 1 AS seq, {", ".join(f"u * u * u * {v} + 3 * u * u * t * {v}1 + 3 * u * t * t * {v}2 + t * t * t * {v}3 AS {v}" for v in "xyz")} FROM k) SELECT path_id, seq, x, y, z FROM o"""


@query("bezier", f"SELECT {ROUNDED} FROM ({_BEZIER})")
def bezier(spark, d):
    return _rounded(P.bezier(W.polylines(spark, d)))


def _mix(p: str, q: str, low: str, high: str, out: str) -> str:
    return ", ".join(f"{p}{v} * (({high} - t) / ({high} - {low})) + {q}{v} * ((t - {low}) / ({high} - {low})) AS {out}{v}" for v in "xyz")


_LEADS = ", ".join(f"{f} AS {k}{v}" for v in "xyz" for k, f in (("k", f"lag({v}) OVER w"), ("l", v), ("m", f"lead({v}) OVER w"), ("n", f"lead({v}, 2) OVER w")))


def _gap(p: str, q: str) -> str:
    return "(" + " + ".join(f"({p}{v} - {q}{v}) * ({p}{v} - {q}{v})" for v in "xyz") + ") ** 0.25"


_CATMULL = f"""WITH {W.PATHS_SQL}, l AS (SELECT path_id, seq, {_LEADS} FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    g AS (SELECT *, {_gap("l", "k")} AS t1, {_gap("m", "l")} + {_gap("l", "k")} AS t2, {_gap("n", "m")} + ({_gap("m", "l")} + {_gap("l", "k")}) AS t3 FROM l WHERE kx IS NOT NULL AND nx IS NOT NULL),
    k AS (SELECT *, 0.0::DOUBLE AS t0, t1 + (t2 - t1) * k / 4 AS t FROM g, (SELECT unnest(range(4)) AS k) WHERE t1 > 0 AND t2 > t1 AND t3 > t2),
    m1 AS (SELECT *, {_mix("k", "l", "t0", "t1", "e")}, {_mix("l", "m", "t1", "t2", "f")}, {_mix("m", "n", "t2", "t3", "h")} FROM k),
    m2 AS (SELECT *, {_mix("e", "f", "t0", "t2", "i")}, {_mix("f", "h", "t1", "t3", "j")} FROM m1),
    m3 AS (SELECT path_id, seq, k, {_mix("i", "j", "t1", "t2", "")} FROM m2 UNION ALL SELECT path_id, -1, 0, x, y, z FROM p WHERE seq = 0),
    o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq, k) - 1 AS seq, x, y, z FROM m3) SELECT path_id, seq, x, y, z FROM o"""
COARSE = "path_id, CAST(seq AS BIGINT) AS seq, " + ", ".join(f"CAST(floor({v} * 1e4 + 0.371) AS BIGINT) AS {v}" for v in "xyz")


def _coarse(paths):
    return paths.select("path_id", F.col("seq").cast("long").alias("seq"), *(F.floor(F.col(v) * 1e4 + 0.371).alias(v) for v in "xyz"))


@query("catmull_rom", f"SELECT {COARSE} FROM ({_CATMULL})")
def catmull_rom(spark, d):
    return _coarse(P.catmull_rom(W.polylines(spark, d)))


@query("path_truncate", f"WITH {W.PATHS_SQL} SELECT {ROUNDED} FROM p WHERE seq < 48")
def path_truncate(spark, d):
    return _rounded(P.truncate(W.polylines(spark, d), 48))


@query("path_smooth_flags", f"""WITH {W.PATHS_SQL},
    kinds AS (SELECT path_id, CASE WHEN path_id & 1 > 0 AND count(*) >= 3 THEN 1 WHEN path_id & 2 > 0 AND count(*) >= 4 THEN 2 WHEN path_id & 4 > 0 AND count(*) >= 4 THEN 4 ELSE 0 END AS kind FROM p GROUP BY path_id),
    every AS (SELECT 0 AS kind, path_id, seq, x, y, z FROM p UNION ALL SELECT 1, * FROM ({_CHAIKIN}) UNION ALL SELECT 2, * FROM ({_CATMULL}) UNION ALL SELECT 4, * FROM ({_BEZIER}))
    SELECT {COARSE} FROM every JOIN kinds USING (path_id, kind) WHERE seq < 512""")
def path_smooth_flags(spark, d):
    """Smoothing by flags: the flags of a path are its id modulo 8."""
    paths = W.polylines(spark, d, 128)  # the sorts of all smoothers stay in a task's memory, so it has few paths
    flags = paths.select("path_id", (F.col("path_id") % 8).cast("int").alias("flags")).distinct()
    return _coarse(P.smooth(paths, flags))
