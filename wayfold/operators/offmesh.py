"""Off-mesh connections: ways between two places that no polygon edge joins, such as jumps and ladders.

A connection (id, ax .. az, bx .. bz, radius, both, cost) becomes a virtual polygon between the polygons that its ends snap to; it's entered and left at points, so its doors have the form of
search.portals() with both ends in one place, and routes run over it as over any polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import nearest


def virtual_ref(number: Column) -> Column:
    """The ref of a connection's virtual polygon: below all polygons'."""
    return -1 - number


def snap_connections(connections: DataFrame, edges: DataFrame, climb: float) -> DataFrame:
    """`connections` with start_ref, end_ref and the ends moved onto those polygons: sx .. sz, ex .. ez. An end goes to the nearest polygon within its radius over the ground and a climb in
    height; connections that have an end without one go."""
    widest = connections.agg(F.max("radius")).first()[0]
    if widest is None:
        return connections.select("id", "radius", "both", "cost", *(F.lit(None).cast(t).alias(n) for n, t in [("start_ref", "long"), ("end_ref", "long"), *((f"{p}{v}", "double") for p in "se" for v in "xyz")]))
    ends = connections.select("id", "radius", F.explode(F.array(*(F.struct(F.lit(p).alias("side"), *(F.col(f"{p}{v}").alias(v) for v in "xyz")) for p in "ab"))).alias("p"))
    asked = ends.select(F.struct("id", "p.side", "radius", F.col("p.x").alias("px"), F.col("p.z").alias("pz")).alias("request_id"), "p.x", "p.y", "p.z")
    found = nearest(asked, edges, climb, (widest, climb, widest)).select("request_id.*", "ref", *"xyz")
    apart = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("z") - F.col("pz")) * (F.col("z") - F.col("pz"))
    found = found.filter(apart <= F.col("radius") * F.col("radius"))
    sides = found.groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(n) for s, p, r in (("a", "s", "start_ref"), ("b", "e", "end_ref")) for c, n in (("ref", r), *((v, f"{p}{v}") for v in "xyz"))))
    sides = sides.filter("start_ref IS NOT NULL AND end_ref IS NOT NULL")
    return connections.select("id", "radius", "both", "cost").join(sides, "id")


def without_copies(snapped: DataFrame) -> DataFrame:
    """Of the connections of snap_connections() that lead from one place to the same other one, in the same directions and at the same cost, that with the smallest id: no route gets cheaper by the
    others, and doors of a polygon meet each other in pairs."""
    same = ["both", "cost", "start_ref", "end_ref", *(f"{p}{v}" for p in "se" for v in "xyz")]
    return snapped.groupBy(*same).agg(F.min("id").alias("id"), F.max("radius").alias("radius")).select(*snapped.columns)


def off_mesh_doors(snapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doors, costs) to be put to search.portals() and to the costs of polygons: in at the start and out at the end, and the other way round where `both` is true."""
    virtual = virtual_ref(F.col("id"))

    def door(start: Column, end: Column, at: str, which: int) -> Column:
        place = [F.col(f"{at}{v}").alias(f"{p}{v}") for p in "abm" for v in "xyz"]
        return F.struct(start.alias("from_ref"), end.alias("to_ref"), F.lit(which).alias("edge"), *place)

    one = [door(F.col("start_ref"), virtual, "s", 0), door(virtual, F.col("end_ref"), "e", 1)]
    back = [door(F.col("end_ref"), virtual, "e", 1), door(virtual, F.col("start_ref"), "s", 0)]
    doors = snapped.select(F.explode(F.when(F.col("both"), F.array(*one, *back)).otherwise(F.array(*one))).alias("d")).select("d.*")
    names = ["from_ref", "to_ref", "edge", *(f"{p}{v}" for p in "abm" for v in "xyz")]
    return doors.select(*names, F.xxhash64(F.lit("off-mesh"), "from_ref", "edge", "to_ref").alias("portal")), snapped.select(virtual.alias("ref"), "cost")


def connection_ends(crossings: DataFrame, snapped: DataFrame) -> DataFrame:
    """(request_id, from_x .. from_z, to_x .. to_z) for crossings (request_id, prev_ref, ref) of virtual polygons: from the end that prev_ref holds to the other; a ref of no connection, or a prev_ref at
    neither end, gives none. Where both ends are in prev_ref, the start comes first."""
    joined = crossings.join(snapped.withColumn("ref", virtual_ref(F.col("id"))), "ref")
    forward = F.col("prev_ref") == F.col("start_ref")
    joined = joined.filter(forward | (F.col("prev_ref") == F.col("end_ref")))
    return joined.select("request_id", *(F.when(forward, F.col(f"{a}{v}")).otherwise(F.col(f"{b}{v}")).alias(f"{n}_{v}") for n, a, b in (("from", "s", "e"), ("to", "e", "s")) for v in "xyz"))
