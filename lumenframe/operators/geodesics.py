"""Geodesic distances and paths over surfaces that stay in tables.

The faces are cut into blocks of neighbours. In a round, each block that has something new relaxes its own
triangles in one task until they agree; Spark then takes, of every vertex that several blocks share, the least
distance, and the blocks for which that is news are the next round's. A round's distances are a stored table,
so a lost executor costs a task. A head's surface takes some rounds, as few as a wave crosses blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.scratch import discard, scratch_dir, stored
from ..functions.eikonal import relax
from .geometry import corners, edges, interleaved

BLOCK_FACES = 100_000
DISTANCES = "block long, vertex long, distance double, seen double"


def morton(faces: DataFrame, bits: int = 10) -> Column:
    """A number that is near for near centroids, of faces with corner coordinates: the bits of the three coordinates in turn."""
    mean = {c: (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 for c in "xyz"}
    ends = faces.agg(*[f(mean[c]).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return interleaved(mean, ends, bits)


def blocks_of(faces: DataFrame, vertices: DataFrame, block_faces: int = BLOCK_FACES, by: Column | None = None) -> DataFrame:
    """(block, a, b, c, la, lb, lc): corners and the sides opposite to them, stored; near faces share a block."""
    f = stored(corners(faces, vertices))
    n = -(-max(f.count(), 1) // block_faces)
    side = lambda p, q: F.sqrt(sum(((F.col(f"{p}{c}") - F.col(f"{q}{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    keyed = f.select((morton(f) if by is None else by).alias("key"), "a", "b", "c", side("b", "c").alias("la"), side("c", "a").alias("lb"), side("a", "b").alias("lc"))
    return stored(keyed.repartitionByRange(n, "key", "a").select(F.spark_partition_id().cast("long").alias("block"), "a", "b", "c", "la", "lb", "lc"))


def _relaxed(through_faces: bool):
    def run(key, faces: pa.Table, known: pa.Table) -> pa.Table:
        ends = np.stack([np.asarray(faces.column(c)) for c in "abc"], 1)
        ids, local = np.unique(ends, return_inverse=True)
        distance = np.full(len(ids), np.inf)
        at = np.searchsorted(ids, np.asarray(known.column("vertex")))
        old, seen = np.asarray(known.column("distance")), np.asarray(known.column("seen"))
        distance[at] = old
        lengths = np.stack([np.asarray(faces.column(f"l{c}")) for c in "abc"], 1)
        out = relax(local.reshape(-1, 3), lengths, distance, at[old < seen], through_faces)
        held = np.isfinite(out)
        return pa.table({"block": np.full(held.sum(), key[0].as_py()), "vertex": ids[held], "distance": out[held], "seen": out[held]})

    # grouped functions tell their kind by whole annotations or none
    run.__annotations__ = {}
    return run


def geodesic_distance(faces: DataFrame, vertices: DataFrame, sources: DataFrame, block_faces: int = BLOCK_FACES, by: Column | None = None, rounds: int = 1000, through_faces: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """(vertex, distance) of every vertex to its nearest source along the surface; null where none is reached.

    sources: vertex. by: what neighbours share, if not their place (the face's number, for surfaces that are
    numbered along). through_faces False: the way may only follow edges. RuntimeError if rounds do not suffice.
    """
    spark = faces.sparkSession
    parts = blocks_of(faces, vertices, block_faces, by)
    members = stored(parts.select("block", F.explode(F.array("a", "b", "c")).alias("vertex")).distinct())
    shared = stored(members.join(members.groupBy("vertex").agg(F.count("*").alias("n")).where("n > 1").select("vertex"), "vertex"))
    path = scratch_dir(spark)
    start = members.join(sources.select("vertex").distinct(), "vertex").select("block", "vertex", F.lit(0.0).alias("distance"), F.lit(float("inf")).alias("seen"))
    now = stored(start, path)
    for _ in range(rounds):
        # seen: the distance that the block's triangles have been relaxed with
        active = now.where("distance < seen").select("block").distinct()
        if active.isEmpty():
            break
        mine = parts.join(active, "block").groupBy("block").cogroup(now.join(active, "block").groupBy("block"))
        new = stored(now.join(active, "block", "left_anti").unionByName(mine.applyInArrow(_relaxed(through_faces), DISTANCES)))
        least = shared.join(new.select("block", "vertex", "distance"), ["block", "vertex"]).groupBy("vertex").agg(F.min("distance").alias("least"))
        rest = new.join(shared, ["block", "vertex"], "left_anti")
        # to every block that has the vertex, also to those that did not reach it yet
        own = F.coalesce("distance", F.lit(float("inf")))
        told = shared.join(least, "vertex").join(new, ["block", "vertex"], "left").select("block", "vertex", F.when(F.col("least") < own * (1 - tolerance), F.col("least")).otherwise(F.col("distance")).alias("distance"), F.coalesce("seen", F.lit(float("inf"))).alias("seen"))
        before, path = path, scratch_dir(spark)
        now = stored(rest.unionByName(told), path)
        discard(spark, before)
    else:
        raise RuntimeError(f"distances did not settle in {rounds} rounds")
    found = now.groupBy("vertex").agg(F.min("distance").alias("distance"))
    return vertices.select("vertex").join(found, "vertex", "left")


def downhill(faces: DataFrame, distances: DataFrame) -> DataFrame:
    """(vertex, next): of a vertex and its neighbours the one with the least distance, of equal ones the smallest; itself at a source."""
    e = edges(faces).select("i", "j")
    both = e.union(e.select("j", "i")).union(distances.select("vertex", "vertex")).toDF("vertex", "to")
    near = both.join(distances.where("distance IS NOT NULL").select(F.col("vertex").alias("to"), "distance"), "to")
    return near.groupBy("vertex").agg(F.min_by("to", F.struct("distance", "to")).alias("next"))


def geodesic_path(faces: DataFrame, distances: DataFrame, starts: DataFrame, longest: int = 1000) -> DataFrame:
    """(start, step, vertex): the way down from each start (vertex) to a source, in rounds that double the steps taken.

    A vertex without a lower neighbour has no jump, so a jump of so many steps is there only if the way is that
    long: each place of a way is found once, and written once. RuntimeError if a way has more than longest vertices.
    """
    jump = stored(downhill(faces, distances).where("next <> vertex"))
    way = stored(starts.select(F.col("vertex").alias("start"), F.lit(0).cast("long").alias("step"), "vertex").distinct())
    width = 1
    while not jump.isEmpty():
        far = stored(way.join(jump, "vertex").select("start", (F.col("step") + width).alias("step"), F.col("next").alias("vertex")))
        if far.isEmpty():
            break
        if not far.where(F.col("step") >= longest).isEmpty():
            raise RuntimeError(f"a path has more than {longest} vertices")
        way = way.unionByName(far)
        second = jump.select(F.col("vertex").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(second, "next").select("vertex", F.col("after").alias("next")))
        width *= 2
    return way
