"""Column functions of mesh geometry. All are built-in expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiles of the world, and voxels of a tile.
TILE_SIZE = 533.33333
TILES = 64
CELL = TILE_SIZE / 2560
SEGMENT_EPSILON = 1e-6
#: Game x, y, z in mesh order.
MESH_AXES = ("y", "z", "x")
GAME_AXES = ("z", "x", "y")


def quantised(value: Column) -> Column:
    """Millionths as a whole number; the odd offset keeps sums that differ in the last bit from falling on either side."""
    return F.floor(value * 1e6 + 0.371)


def vector(x, y, z) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip("xyz", (x, y, z), strict=True)))


def to_mesh(point: Column) -> Column:
    """A game point (x north, y west, z up) in the mesh's frame."""
    return F.struct(*(point[a].alias(n) for a, n in zip(MESH_AXES, "xyz", strict=True)))


def to_game(point: Column) -> Column:
    return F.struct(*(point[a].alias(n) for a, n in zip(GAME_AXES, "xyz", strict=True)))


def world_to_tile(coordinate: Column) -> Column:
    """Index of the tile of a world coordinate; cut toward zero, as tile numbers are."""
    return (F.lit(TILES / 2) - coordinate / TILE_SIZE).cast("int")


def tile_to_world(tile: Column) -> Column:
    """Larger edge of a tile."""
    return (F.lit(TILES / 2) - tile) * TILE_SIZE


def mesh_tile(coordinate: Column, origin: Column, size: float = TILE_SIZE) -> Column:
    return F.floor((coordinate - origin) / size)


def passes(flags: Column, include: Column, exclude: Column) -> Column:
    """Whether a polygon's flags have one that is included and none that is excluded."""
    return (flags.bitwiseAND(include) != 0) & (flags.bitwiseAND(exclude) == 0)


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        total = total + (q - p) * (q - p)
    return F.sqrt(total)


def cross_2d(ax, az, bx, bz, cx, cz) -> Column:
    """Twice the signed area of a triangle on the ground; positive where a, b, c turn from z to x."""
    return (cx - ax) * (bz - az) - (bx - ax) * (cz - az)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def segment_t(px, pz, ax, az, bx, bz) -> Column:
    """Where on segment a b the point nearest to p is, from 0 to 1; 0 for a segment without length."""
    length = (bx - ax) * (bx - ax) + (bz - az) * (bz - az)
    return F.when(length > 0, clamp(((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / F.when(length > 0, length))).otherwise(0.0)


def segment_distance_sq(px, pz, ax, az, bx, bz) -> Column:
    t = segment_t(px, pz, ax, az, bx, bz)
    dx, dz = ax + t * (bx - ax) - px, az + t * (bz - az) - pz
    return dx * dx + dz * dz


def crosses_edge(px, pz, ax, az, bx, bz) -> Column:
    """Whether a ray from p along x crosses edge a b (half open, so a corner counts once)."""
    return ((az > pz) != (bz > pz)) & (px < (bx - ax) * (pz - az) / F.when(bz != az, bz - az) + ax)


def triangle_height(px, pz, a: tuple, b: tuple, c: tuple) -> Column:
    """Height of triangle a b c (x, y, z each) over p; null outside or on a triangle without area."""
    v0x, v0z, v1x, v1z, v2x, v2z = c[0] - a[0], c[2] - a[2], b[0] - a[0], b[2] - a[2], px - a[0], pz - a[2]
    det = v0x * v1z - v0z * v1x
    sign = F.when(det < 0, -1.0).otherwise(1.0)
    u, v, d = sign * (v1z * v2x - v1x * v2z), sign * (v0x * v2z - v0z * v2x), F.abs(det)
    inside = (d > SEGMENT_EPSILON) & (u >= 0) & (v >= 0) & (u + v <= d)
    return F.when(inside, a[1] + ((c[1] - a[1]) * u + (b[1] - a[1]) * v) / F.when(d > 0, d))


def overlaps(a_min, a_max, b_min, b_max) -> Column:
    return (a_min <= b_max) & (b_min <= a_max)


def rotate_zyx(x, y, z, rx, ry, rz) -> Column:
    """A row vector turned about z, then y, then x (angles in radians)."""
    x1, y1 = x * F.cos(rz) - y * F.sin(rz), x * F.sin(rz) + y * F.cos(rz)
    x2, z2 = x1 * F.cos(ry) + z * F.sin(ry), z * F.cos(ry) - x1 * F.sin(ry)
    y3, z3 = y1 * F.cos(rx) - z2 * F.sin(rx), y1 * F.sin(rx) + z2 * F.cos(rx)
    return vector(x2, y3, z3)


def segment_meeting(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[Column, Column]:
    """Where lines a b and c d (x, z each) meet, as shares of both; null if they are parallel."""
    ux, uz, vx, vz, wx, wz = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1], a[0] - c[0], a[1] - c[1]
    det = ux * vz - uz * vx
    safe = F.when(F.abs(det) >= SEGMENT_EPSILON, det)
    return (vx * wz - vz * wx) / safe, (ux * wz - uz * wx) / safe


# Bits of a polygon reference, from the low end: polygon, tile, salt.
POLY_BITS, TILE_BITS = 31, 21


def encode_ref(salt: Column, tile: Column, poly: Column) -> Column:
    return F.shiftleft(salt.cast("long"), POLY_BITS + TILE_BITS).bitwiseOR(F.shiftleft(tile.cast("long"), POLY_BITS)).bitwiseOR(poly.cast("long"))


def decode_ref(ref: Column) -> Column:
    """A reference's salt, tile and poly."""
    tile = F.shiftrightunsigned(ref, POLY_BITS).bitwiseAND(F.lit((1 << TILE_BITS) - 1))
    return F.struct(F.shiftrightunsigned(ref, POLY_BITS + TILE_BITS).alias("salt"), tile.alias("tile"), ref.bitwiseAND(F.lit((1 << POLY_BITS) - 1)).alias("poly"))


def closest_on_segment(p: tuple, a: tuple, b: tuple) -> tuple[Column, ...]:
    """The point of segment a b (x, y, z each) that is nearest to p in space."""
    d = [q - r for q, r in zip(b, a, strict=True)]
    length = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    along = (p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1] + (p[2] - a[2]) * d[2]
    t = F.when(length > 0, clamp(along / F.when(length > 0, length))).otherwise(0.0)
    return tuple(r + t * q for q, r in zip(d, a, strict=True))


def closest_on_triangle(p: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """The point (struct x, y, z) of triangle a b c that is nearest to p: below or above it the foot on its plane, else the nearest point of its sides, the first of equals in the order ab, bc, ca. A
    triangle without area has sides alone."""
    u, v, w = ([q[i] - a[i] for i in range(3)] for q in (b, c, p))
    uu, uv, vv, wu, wv = (sum((x * y for x, y in zip(m[1:], n[1:], strict=True)), m[0] * n[0]) for m, n in ((u, u), (u, v), (v, v), (w, u), (w, v)))
    det = uu * vv - uv * uv
    safe = F.when(det > SEGMENT_EPSILON, det)
    s, t = (vv * wu - uv * wv) / safe, (uu * wv - uv * wu) / safe
    foot = F.struct(*((a[i] + s * u[i] + t * v[i]).alias(n) for i, n in enumerate("xyz")))

    def on_side(i: int, q: tuple, r: tuple) -> Column:
        at = closest_on_segment(p, q, r)
        apart = (at[0] - p[0]) * (at[0] - p[0]) + (at[1] - p[1]) * (at[1] - p[1]) + (at[2] - p[2]) * (at[2] - p[2])
        return F.struct(apart.alias("d"), F.lit(i).alias("i"), F.struct(*(x.alias(n) for x, n in zip(at, "xyz", strict=True))).alias("p"))

    beside = F.least(*(on_side(i, q, r) for i, (q, r) in enumerate(((a, b), (b, c), (c, a)))))["p"]
    return F.when((s >= 0) & (t >= 0) & (s + t <= 1), foot).otherwise(beside)
