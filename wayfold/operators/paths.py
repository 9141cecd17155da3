"""Ordered polylines: smoothing, length, bounds and truncation.

A path is rows of (path_id, seq, x, y, z), seq from 0 without gaps. Each smoother makes of every point, from it and its neighbours, a
number of points in place: one window over path_id and one explode, so a path is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

AXES = ("x", "y", "z")
# Defaults of the smoothers.
BEZIER_POINTS = 8
CATMULL_POINTS = 4
CATMULL_ALPHA = 0.5
MAX_POINTS = 512
# Path flags.
CHAIKIN, CATMULL, BEZIER, SNAP, WALK = 1, 2, 4, 8, 16


def by_path() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("seq")


def whole_path() -> WindowSpec:
    return Window.partitionBy("path_id")


def _renumbered(points: DataFrame, *order: str) -> DataFrame:
    along = Window.partitionBy("path_id").orderBy(*order)
    return points.select("path_id", (F.row_number().over(along) - 1).alias("seq"), *AXES)


def number_points(points: DataFrame, path_id: str, order: list[str]) -> DataFrame:
    """`points` as paths: seq counts the rows of each path in the given order."""
    along = Window.partitionBy(path_id).orderBy(*order)
    return points.select(F.col(path_id).alias("path_id"), (F.row_number().over(along) - 1).alias("seq"), *AXES)


def _with_neighbours(paths: DataFrame) -> DataFrame:
    """`paths` with the point before (x_, y_, z_) and the three after (x1 to z3) each point, from one window."""
    before = {f"{a}_": F.lag(a).over(by_path()) for a in AXES}
    return paths.withColumns(before | {f"{a}{n}": F.lead(a, n).over(by_path()) for n in (1, 2, 3) for a in AXES})


def _grown(paths: DataFrame, count: Column) -> DataFrame:
    """`count` rows for each point, numbered k."""
    some = paths.withColumn("count", count).filter("count > 0")
    return some.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))


def _named(name: str, axes: dict[str, Column]) -> dict[str, Column]:
    return {f"{name}{a}": c for a, c in axes.items()}


def _last() -> Column:
    return F.col("x1").isNull()


def _chaikin_count() -> Column:
    """Points for a point: itself if it is the first or last, and two on the leg after it."""
    return F.when(_last(), 1).when(F.col("seq") == 0, 3).otherwise(2)


def _chaikin_value() -> dict[str, Column]:
    """The k-th: a first or last point itself, then a quarter and three quarters of the leg after it."""
    nth = F.col("k") - F.when(F.col("seq") == 0, 1).otherwise(0)
    share = F.when(_last() | (nth < 0), 0.0).when(nth == 0, 0.25).otherwise(0.75)
    return {a: F.when(share == 0, F.col(a)).otherwise((1 - share) * F.col(a) + share * F.col(f"{a}1")) for a in AXES}


def chaikin(paths: DataFrame) -> DataFrame:
    """Corner cutting: the first point, a quarter and three quarters of each leg, and the last point; 2n points for n."""
    grown = _grown(_with_neighbours(paths), _chaikin_count())
    return _renumbered(grown.select("path_id", "seq", "k", *(c.alias(a) for a, c in _chaikin_value().items())), "seq", "k")


#: Of a leg from b to c, with a before and d after it: what a point with its neighbours calls their columns after the axis.
_ABOUT = {"a": "_", "b": "", "c": "1", "d": "2"}


def _at(p: str, axis: str) -> Column:
    return F.col(f"{axis}{_ABOUT[p]}" if p in _ABOUT else f"{p}{axis}")


def _blend(p: str, q: str, t0: Column, t1: Column) -> dict[str, Column]:
    """Between points p and q, which have times t0 and t1, at time t."""
    t = F.col("t")
    return {a: _at(p, a) * ((t1 - t) / (t1 - t0)) + _at(q, a) * ((t - t0) / (t1 - t0)) for a in AXES}


def _timed(paths: DataFrame, alpha: float) -> DataFrame:
    """Points with the times t1 to t3 of b, c and d of the leg after each, null where there is no leg with a point on either side."""

    def gap(p: str, q: str) -> Column:
        return F.pow(sum(((_at(p, a) - _at(q, a)) * (_at(p, a) - _at(q, a)) for a in AXES), F.lit(0.0)), F.lit(alpha / 2))

    return paths.withColumn("t1", gap("b", "a")).withColumn("t2", gap("c", "b") + F.col("t1")).withColumn("t3", gap("d", "c") + F.col("t2"))


def _catmull_count(points: int, keep_last: bool) -> Column:
    """Points for a point: itself if it is the first, `points` samples of the leg after it if that has a point on either side."""
    out = F.when(F.col("seq") == 0, 1).when((F.col("t1") > 0) & (F.col("t2") > F.col("t1")) & (F.col("t3") > F.col("t2")), points).otherwise(0)
    return F.when(_last(), 1).otherwise(out) if keep_last else out


def _with_catmull(grown: DataFrame, points: int) -> DataFrame:
    """`grown` timed points with the k-th sample (rx, ry, rz) of their legs."""
    zero, t1, t2, t3 = F.lit(0.0), F.col("t1"), F.col("t2"), F.col("t3")
    out = grown.withColumn("t", t1 + (t2 - t1) * F.col("k") / points)
    out = out.withColumns(_named("e", _blend("a", "b", zero, t1)) | _named("f", _blend("b", "c", t1, t2)) | _named("g", _blend("c", "d", t2, t3)))
    out = out.withColumns(_named("h", _blend("e", "f", zero, t2)) | _named("i", _blend("f", "g", t1, t3)))
    return out.withColumns(_named("r", _blend("h", "i", t1, t2)))


def _catmull_value() -> dict[str, Column]:
    return {a: F.when((F.col("seq") == 0) | _last(), F.col(a)).otherwise(F.col(f"r{a}")) for a in AXES}


def catmull_rom(paths: DataFrame, points: int = CATMULL_POINTS, alpha: float = CATMULL_ALPHA, keep_last: bool = False) -> DataFrame:
    """Centripetal Catmull-Rom: the first point, then `points` samples of each leg that has a point on either side.

    The last two points have no leg of that kind, so the path ends before them, as its users expect; `keep_last` adds the last.
    Legs with a degenerate time are left out.
    """
    grown = _with_catmull(_grown(_timed(_with_neighbours(paths), alpha), _catmull_count(points, keep_last)), points)
    return _renumbered(grown.select("path_id", "seq", "k", *(c.alias(a) for a, c in _catmull_value().items())), "seq", "k")


def _bezier_count(points: int, keep_last: bool) -> Column:
    """Points for a point: `points` samples of the run of four that starts at it, if one does."""
    out = F.when((F.col("seq") % 3 == 0) & F.col("x3").isNotNull(), points).otherwise(0)
    return F.when(_last() & (F.col("seq") % 3 != 0), 1).otherwise(out) if keep_last else out


def _bezier_value(points: int) -> dict[str, Column]:
    t = F.col("k") / float(points - 1)
    u = 1 - t
    curve = {a: u * u * u * F.col(a) + 3 * u * u * t * F.col(f"{a}1") + 3 * u * t * t * F.col(f"{a}2") + t * t * t * F.col(f"{a}3") for a in AXES}
    return {a: F.when(_last(), F.col(a)).otherwise(c) for a, c in curve.items()}


def bezier(paths: DataFrame, points: int = BEZIER_POINTS, keep_last: bool = False) -> DataFrame:
    """Cubic Bezier curves through every fourth point: `points` samples of each run of four, which starts at the third of the run
    before it. Points beyond the last whole run are left out; `keep_last` adds the last."""
    grown = _grown(_with_neighbours(paths), _bezier_count(points, keep_last))
    return _renumbered(grown.select("path_id", "seq", "k", *(c.alias(a) for a, c in _bezier_value(points).items())), "seq", "k")


def smoothing_of(flags: Column, points: Column) -> Column:
    """Which smoother a path of so many points takes: Chaikin before Catmull-Rom before Bezier, where it has the points for it (3, 4, 4), or
    0; a flag of an earlier one that lacks points leaves the later ones open."""

    def has(flag: int) -> Column:
        return flags.bitwiseAND(flag) != 0

    return F.when(has(CHAIKIN) & (points >= 3), CHAIKIN).when(has(CATMULL) & (points >= 4), CATMULL).when(has(BEZIER) & (points >= 4), BEZIER).otherwise(0)


def smooth(paths: DataFrame, flags: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """Paths smoothed as their flags (path_id, flags) say, others as they are; at most max_points of each. Paths without flags are left out.
    The paths are shuffled once; each smoother reads that shuffle."""
    chosen = paths.join(flags, "path_id").withColumn("kind", smoothing_of(F.col("flags"), F.count("*").over(whole_path())))

    def part(value: int) -> DataFrame:
        return chosen.filter(F.col("kind") == value).select("path_id", "seq", *AXES)

    return truncate(part(0).unionByName(chaikin(part(CHAIKIN))).unionByName(catmull_rom(part(CATMULL))).unionByName(bezier(part(BEZIER))), max_points)


def truncate(paths: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    return paths.filter(F.col("seq") < max_points)


def stats(paths: DataFrame) -> DataFrame:
    """(path_id, points, length, and the bounds of each axis)."""
    legs = paths.withColumn("leg", F.sqrt(sum(((F.col(a) - F.lag(a).over(by_path())) * (F.col(a) - F.lag(a).over(by_path())) for a in AXES), F.lit(0.0))))
    bounds = [f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]
    return legs.groupBy("path_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("length"), *bounds)


def split_legs(paths: DataFrame, longest: float) -> DataFrame:
    """Paths whose legs are cut into equal steps of at most `longest`, ends kept."""
    before = paths.select("path_id", "seq", *AXES, *(F.lag(a).over(by_path()).alias(f"{a}0") for a in AXES))
    length = F.sqrt(sum(((F.col(a) - F.col(f"{a}0")) * (F.col(a) - F.col(f"{a}0")) for a in AXES), F.lit(0.0)))
    cut = before.withColumn("steps", F.greatest(F.ceil(F.coalesce(length, F.lit(0.0)) / longest), F.lit(1)).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(1), "steps")))
    moved = [F.when(F.col("x0").isNull() | (F.col("k") == F.col("steps")), F.col(a)).otherwise(F.col(f"{a}0") + (F.col(a) - F.col(f"{a}0")) * F.col("k") / F.col("steps")).alias(a) for a in AXES]
    return _renumbered(cut.select("path_id", "seq", "k", *moved), "seq", "k")
