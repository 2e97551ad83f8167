"""Surfaces from volumes: marching tetrahedra as joins and expressions over a sparse table of voxels.

A cell has eight voxels as corners and is cut into six tetrahedra around its diagonal, which fit those of its
neighbours. Where the level lies between two corners of a tetrahedron, the surface has a vertex on that edge,
interpolated; its number is made of the edge's voxel and direction, so that cells agree on it without a join. A
voxel that the table lacks is 0, so surfaces are closed, also where the volume ends.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners by bits (1: next in i, 2: in j, 4: in k), along the six ways from corner 0 to corner 7.
TETRAHEDRA = [(0, a, a | b, 7) for a, b, _ in permutations((1, 2, 4))]


def cells(volume: DataFrame, level: float) -> DataFrame:
    """(i, j, k, v0 ... v7): the corners' values of cells that the level divides. volume: i, j, k, value; one row a voxel."""
    shift = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(c & 1).alias("di"), F.lit(c >> 1 & 1).alias("dj"), F.lit(c >> 2).alias("dk")) for c in range(8)]))
    each = volume.where("value <> 0").select("i", "j", "k", "value", shift.alias("s"))
    at = [(F.col(a) - F.col(f"s.d{a}")).cast("long").alias(a) for a in "ijk"]
    corner = [F.coalesce(F.max(F.when(F.col("c") == c, F.col("value"))), F.lit(0.0)).cast("double").alias(f"v{c}") for c in range(8)]
    whole = each.select(*at, "s.c", "value").groupBy("i", "j", "k").agg(*corner)
    values = [F.col(f"v{c}") for c in range(8)]
    return whole.where((F.greatest(*values) >= level) & (F.least(*values) < level))


def _crossing(p: str, q: str, level: float) -> Column:
    """The vertex between two corners: its number and place."""
    a, b = F.col(p), F.col(q)
    low, high = F.least(a["c"], b["c"]), F.greatest(a["c"], b["c"])
    share = (F.lit(level) - a["v"]) / (b["v"] - a["v"])
    base = [(F.col(x) + F.shiftright(low, n).bitwiseAND(F.lit(1)) + 1).cast("long") for n, x in enumerate("ijk")]
    number = (F.shiftleft(base[0], 40) + F.shiftleft(base[1], 20) + base[2]) * 8 + low.bitwiseXOR(high)
    where = [(F.col(x) + F.shiftright(a["c"], n).bitwiseAND(F.lit(1)) + share * (F.shiftright(b["c"], n).bitwiseAND(F.lit(1)) - F.shiftright(a["c"], n).bitwiseAND(F.lit(1)))).alias(c) for n, (x, c) in enumerate(zip("ijk", "xyz", strict=True))]
    return F.struct(number.alias("vertex"), *where)


def triangles(volume: DataFrame, level: float = 0.5) -> DataFrame:
    """(p, q, r): the corners of each triangle as (vertex, x, y, z), turned so that its normal points to lower values."""
    one = lambda c: F.struct(F.lit(c).alias("c"), F.col(f"v{c}").alias("v"))
    t = cells(volume, level).select("i", "j", "k", F.explode(F.array(*[F.array(*[one(c) for c in tet]) for tet in TETRAHEDRA])).alias("t"))
    t = t.select("i", "j", "k", F.filter("t", lambda x: x["v"] >= level).alias("up"), F.filter("t", lambda x: x["v"] < level).alias("low")).where(F.size("up").between(1, 3))
    t = t.select("i", "j", "k", F.size("up").alias("n"), *[F.get("up", F.lit(m)).alias(f"u{m}") for m in range(3)], *[F.get("low", F.lit(m)).alias(f"l{m}") for m in range(3)])
    edge = {(u, w): _crossing(f"u{u}", f"l{w}", level) for u in range(3) for w in range(3)}
    tri = lambda *e: F.struct(*[edge[x].alias(n) for x, n in zip(e, "pqr", strict=True)])
    kinds = F.when(F.col("n") == 1, F.array(tri((0, 0), (0, 1), (0, 2)))).when(F.col("n") == 3, F.array(tri((0, 0), (1, 0), (2, 0)))).otherwise(F.array(tri((0, 0), (0, 1), (1, 1)), tri((0, 0), (1, 1), (1, 0))))
    # from the middle of the higher corners to that of the lower ones
    bit = lambda name, n: F.shiftright(F.col(name)["c"], n).bitwiseAND(F.lit(1))
    mean = lambda side, n, count: sum((F.coalesce(bit(f"{side}{m}", n), F.lit(0)) for m in range(3)), F.lit(0)) / count
    out = t.select(F.array(*[mean("l", n, 4 - F.col("n")) - mean("u", n, F.col("n")) for n in range(3)]).alias("d"), F.explode(kinds).alias("t")).select("d", "t.*")
    u, v = ([F.col(f"{k}.{c}") - F.col(f"p.{c}") for c in "xyz"] for k in "qr")
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    outward = sum((n * F.col("d")[i] for i, n in enumerate(normal)), F.lit(0.0)) >= 0
    return out.select("p", F.when(outward, F.col("q")).otherwise(F.col("r")).alias("q"), F.when(outward, F.col("r")).otherwise(F.col("q")).alias("r"))


def isosurface(volume: DataFrame, level: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the surface on which values, linear along edges, are level: face, a, b, c and vertex, x, y, z.

    Voxels at the level lie inside. i, j and k are from -1 to a million.
    """
    tri = triangles(volume, level)
    vertices = tri.select(F.explode(F.array("p", "q", "r")).alias("v")).groupBy("v.vertex").agg(*[F.min(f"v.{c}").alias(c) for c in "xyz"])
    return tri.select(F.monotonically_increasing_id().alias("face"), F.col("p.vertex").alias("a"), F.col("q.vertex").alias("b"), F.col("r.vertex").alias("c")), vertices


def surface_of_segments(volume: DataFrame, types: list[str], smoothing: int = 0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) around the voxels of some tissues; volume: i, j, k, seg_type, label. smoothing: rounds of Taubin's."""
    from .geometry import smooth, voxels_from_segmentation

    faces, vertices = isosurface(voxels_from_segmentation(volume, types).withColumn("value", F.lit(1.0)))
    return faces, smooth(faces, vertices, smoothing) if smoothing else vertices
