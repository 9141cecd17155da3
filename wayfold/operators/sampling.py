"""Poisson-disk sampling: points spread over outlines so that none is nearer than a radius to another and no room is left."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut
from .volumes import in_outline

#: Candidates along a radius.
FINENESS = 4
#: Squares of the lattice over an outline up to which its rounds are done in one place.
MOST = 1 << 16


def _draw(seed: int, *key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(1 << 53)


def candidates(outlines: DataFrame, radius: float, seed: int = 0, fineness: int = FINENESS) -> DataFrame:
    """(id, i, j, x, z, rank): a place at random in each square of a lattice, where it lies in the outline (id, corners); rank is a random order without ties. Squares are
    radius / fineness wide, or narrower in an outline of little width, so that it has some; one without width has none."""
    sized = _lattice(outlines, radius, fineness)
    for n in "ij":
        sized = sized.withColumn(n, F.explode(F.sequence(f"lo_{n}", f"hi_{n}")))
    key = [F.col("id"), F.col("i"), F.col("j")]
    placed = sized.withColumns({"x": (F.col("i") + _draw(seed, *key)) * F.col("step"), "z": (F.col("j") + _draw(seed + 1, *key)) * F.col("step")})
    return placed.filter(in_outline(F.col("x"), F.col("z"), F.col("corners"))).select("id", "i", "j", "x", "z", F.struct(F.xxhash64(F.lit(seed + 2), *key).alias("draw"), "i", "j").alias("rank"))


def poisson_disk(outlines: DataFrame, radius: float, seed: int = 0, fineness: int = FINENESS, most: int = MOST) -> DataFrame:
    """(id, x, z): of the candidates() of each outline a largest set, in that none can be added, of places at least `radius` apart. Reruns agree.

    Squares of radius / sqrt(2) hold one place at most. In a round each square offers its first candidate by rank; an offer stands if none within the radius, of the squares
    around, has a smaller rank; candidates within the radius of what stands go. The first of all always stands, so rounds end; a few thin out most of it.

    Outlines don't bear on each other. The rounds of one with at most `most` squares of the lattice are done where its candidates are made, so those are neither shuffled nor
    written; those of the others are tables.
    """
    whole = Window.partitionBy("id")
    # outlines of one id share their places, so they go together
    squares = (F.col("hi_i") - F.col("lo_i") + 1.0) * (F.col("hi_j") - F.col("lo_j") + 1.0)
    sized = cut(_lattice(outlines, radius, fineness).select("id", "corners", ((squares <= most) & (F.count("*").over(whole) == 1) & F.col("id").isNotNull()).alias("small")))
    large = sized.filter("NOT small").select("id", "corners")
    found = _of_small(sized.filter("small").select("id", "corners"), radius, seed, fineness)
    return found if large.isEmpty() else found.unionByName(_of_large(large, radius, seed, fineness))


def _lattice(outlines: DataFrame, radius: float, fineness: int) -> DataFrame:
    """`outlines` with the width of their squares and the first and last square each way."""
    reach = {v: F.array_max(f"corners.{v}") - F.array_min(f"corners.{v}") for v in "xz"}
    sized = outlines.select("id", "corners", F.least(F.lit(radius / fineness), *(w / (2 * fineness) for w in reach.values())).alias("step")).filter("step > 0")
    ends = {f"{end}_{n}": F.floor(f(f"corners.{v}") / F.col("step")) for n, v in (("i", "x"), ("j", "z")) for end, f in (("lo", F.array_min), ("hi", F.array_max))}
    return sized.withColumns(ends)


def _of_small(outlines: DataFrame, radius: float, seed: int, fineness: int) -> DataFrame:
    """The rounds by Arrow batches of whole outlines; a row of candidates follows the other of its outline, of which the first has the corners."""
    kind = dict(outlines.dtypes)["id"]
    sized = _lattice(outlines, radius, fineness)
    for n in "ij":
        sized = sized.withColumn(n, F.explode(F.sequence(f"lo_{n}", f"hi_{n}")))
    key = [F.col("id"), F.col("i"), F.col("j")]
    first = (F.col("i") == F.col("lo_i")) & (F.col("j") == F.col("lo_j"))
    place = [((F.col(n) + _draw(seed + k, *key)) * F.col("step")).alias(v) for k, (n, v) in enumerate((("i", "x"), ("j", "z")))]
    rows = sized.select(F.when(first, F.col("id")).alias("id"), F.when(first, F.col("corners")).alias("corners"), first.alias("first"), "i", "j", *place, F.xxhash64(F.lit(seed + 2), *key).alias("draw"))

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            starts = np.flatnonzero(table["first"].to_numpy())
            if len(starts) < 2:
                rest = table
                continue
            rest = table.slice(starts[-1])
            yield from _stand(table.slice(0, starts[-1]), radius)
        if rest is not None and rest.num_rows:
            yield from _stand(rest, radius)

    return rows.mapInArrow(run, f"id {kind}, x double, z double")


#: The squares that a place within the radius of one in a square can lie in.
_AROUND = [(dx, dz) for dx in range(-2, 3) for dz in range(-2, 3) if abs(dx) + abs(dz) < 4]


def _inside(x: np.ndarray, z: np.ndarray, corners: list, of: np.ndarray) -> np.ndarray:
    """volumes.in_outline() of places, each in the outline of its number; a corner that is missing, or lacks a coordinate, meets nothing."""
    n = np.array([len(c) for c in corners])
    at = np.full((2, len(corners), max(n.max(), 1)), np.nan)
    for k, outline in enumerate(corners):
        for m, p in enumerate(outline):
            if p is not None:
                at[:, k, m] = [np.nan if p[v] is None else p[v] for v in "xz"]
    odd = np.zeros(len(x), bool)
    with np.errstate(all="ignore"):
        for m in range(at.shape[2]):
            prior = np.where(m == 0, n - 1, m - 1)
            (ax, az), (bx, bz) = at[:, :, m], at[:, np.arange(len(corners)), prior]
            ax, az, bx, bz = ax[of], az[of], bx[of], bz[of]
            odd ^= (m < n[of]) & ((az > z) != (bz > z)) & (x < (bx - ax) * (z - az) / (bz - az) + ax)
    return odd


def _stand(table: pa.Table, radius: float):
    """The places that stand of a table of whole outlines' candidates."""
    first = table["first"].to_numpy()
    of = np.cumsum(first) - 1
    x, z, i, j, draw = (table[n].to_numpy() for n in ("x", "z", "i", "j", "draw"))
    ids = table["id"].filter(table["first"])
    kept = np.flatnonzero(_inside(x, z, table["corners"].filter(table["first"]).to_pylist(), of))
    if not len(kept):
        return
    rank = np.empty(len(kept), np.int64)
    rank[np.lexsort((j[kept], i[kept], draw[kept]))] = np.arange(len(kept))
    side = radius / math.sqrt(2)
    cx, cz = (np.floor(v[kept] / side).astype(np.int64) for v in (x, z))
    # squares by number, with a margin of two so that those around one are its outline's own
    for c in (cx, cz):
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, of[kept], c)
        c -= low[of[kept]] - 2
    wide, deep = int(cx.max()) + 3, int(cz.max()) + 3
    code = (of[kept] * wide + cx) * deep + cz
    order = np.lexsort((rank, code))
    kept, rank, code = kept[order], rank[order], code[order]
    squares, square = np.unique(code, return_inverse=True)
    near = np.full((len(_AROUND), len(squares)), -1)
    for k, (dx, dz) in enumerate(_AROUND):
        other = squares + dx * deep + dz
        found = np.minimum(np.searchsorted(squares, other), len(squares) - 1)
        near[k] = np.where(squares[found] == other, found, -1)
    px, pz = x[kept], z[kept]

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (px[a] - px[b]) * (px[a] - px[b]) + (pz[a] - pz[b]) * (pz[a] - pz[b]) < radius * radius

    alive, stood = np.arange(len(kept)), []
    while len(alive):
        offers = alive[np.concatenate(([True], square[alive][1:] != square[alive][:-1]))]
        offer = np.full(len(squares) + 1, -1)
        offer[square[offers]] = offers
        beaten = np.zeros(len(offers), bool)
        for k in range(len(_AROUND)):
            other = offer[near[k][square[offers]]]
            beaten |= (other >= 0) & (rank[other] < rank[offers]) & within(offers, other)
        stands = offers[~beaten]
        stood.append(stands)
        stand = np.full(len(squares) + 1, -1)
        stand[square[stands]] = stands
        gone = np.zeros(len(alive), bool)
        for k in range(len(_AROUND)):
            other = stand[near[k][square[alive]]]
            gone |= (other >= 0) & within(alive, other)
        alive = alive[~gone]
    rows = kept[np.concatenate(stood)]
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[rows])).combine_chunks(), pa.array(x[rows]), pa.array(z[rows])], names=["id", "x", "z"])


def _of_large(outlines: DataFrame, radius: float, seed: int, fineness: int) -> DataFrame:
    """The rounds as tables."""
    side = radius / math.sqrt(2)
    alive = candidates(outlines, radius, seed, fineness).withColumns({"cx": F.floor(F.col("x") / side), "cz": F.floor(F.col("z") / side)})
    alive = cut(alive.select("id", "x", "z", "rank", "cx", "cz"))
    around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx in range(-2, 3) for dz in range(-2, 3) if abs(dx) + abs(dz) < 4)))

    def spread(df: DataFrame) -> DataFrame:
        """Each place in the squares that a place within the radius can lie in."""
        out = df.select("id", F.col("x").alias("ox"), F.col("z").alias("oz"), F.col("rank").alias("other"), "cx", "cz", around.alias("s"))
        return out.select("id", "ox", "oz", "other", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cz") + F.col("s.dz")).alias("cz"))

    near = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("z") - F.col("oz")) * (F.col("z") - F.col("oz")) < radius * radius
    parts = []
    while not alive.isEmpty():
        offers = cut(alive.groupBy("id", "cx", "cz").agg(F.min_by(F.struct("x", "z"), "rank").alias("p"), F.min("rank").alias("rank")).select("id", "p.x", "p.z", "rank", "cx", "cz"))
        beaten = offers.join(spread(offers), ["id", "cx", "cz"]).filter((F.col("other") < F.col("rank")) & near).select("id", "rank").distinct()
        stands = cut(offers.join(beaten, ["id", "rank"], "left_anti"))
        parts.append(stands.select("id", "x", "z"))
        gone = alive.join(spread(stands), ["id", "cx", "cz"]).filter(near).select("id", "rank").distinct()
        alive = cut(alive.join(gone, ["id", "rank"], "left_anti"))
    if not parts:
        return outlines.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("z")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
