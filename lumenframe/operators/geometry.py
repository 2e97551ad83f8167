"""Point clouds and surfaces as tables.

points: label, type, x, y, z. vertices: vertex, x, y, z. faces: face, a, b, c. Voxels: i, j, k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.schema import CRSMismatchError
from ..core.scratch import stored
from ..functions import transforms


def crs_of(points: DataFrame) -> str | None:
    return points.schema["x"].metadata.get("crs")


def set_crs(points: DataFrame, crs: str) -> DataFrame:
    for c in "xyz":
        points = points.withMetadata(c, {**points.schema[c].metadata, "crs": crs})
    return points


def affine(points: DataFrame, m: np.ndarray, from_crs: str | None = None, to_crs: str | None = None, perspective: bool = False) -> DataFrame:
    """Coordinates times a 4x4 matrix; with CRS names they are checked and set."""
    if from_crs is not None and crs_of(points) not in (None, from_crs):
        raise CRSMismatchError.wrong_transform(crs_of(points), from_crs)
    row = lambda i: sum((F.lit(float(m[i, j])) * F.col(c) for j, c in enumerate("xyz")), F.lit(float(m[i, 3])))
    w = row(3) if perspective else F.lit(1.0)
    out = points.withColumns({c: row(i) / w for i, c in enumerate("xyz")})
    return set_crs(out, to_crs) if to_crs else out


def common_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").intersect(b.select("label"))


def add_points(points: DataFrame, more: DataFrame) -> DataFrame:
    twice = common_labels(points, more).limit(1).collect()
    if twice:
        raise KeyError(twice[0][0])
    return points.unionByName(more, allowMissingColumns=True)


def remove_points(points: DataFrame, labels: list[str]) -> DataFrame:
    return points.where(~F.col("label").isin(labels))


def rename_points(points: DataFrame, names: dict[str, str]) -> DataFrame:
    return points.replace(names, subset=["label"])


def inferred_types(points: DataFrame) -> DataFrame:
    kind = F.when(F.col("label").contains("S"), "SOURCE").when(F.col("label").contains("D"), "DETECTOR").when(F.col("label").contains("L"), "LANDMARK").otherwise("UNKNOWN")
    return points.withColumn("type", F.when(F.coalesce("type", F.lit("UNKNOWN")) == "UNKNOWN", kind).otherwise(F.col("type")))


def squared(a: str = "", b: str = "_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "xyz"), F.lit(0.0))


#: Targets of a block, and points that meet a block in one task, on average.
BLOCK_POINTS, CHUNK_POINTS = 4096, 65_536


def interleaved(at: dict[str, Column], ends: dict[str, float | None], bits: int = 10) -> Column:
    """A number that is near for near places: the bits of three coordinates, scaled from lo to hi, in turn."""
    code = F.lit(0).cast("long")
    for k, c in enumerate("xyz"):
        lo, hi = ends[f"lo{c}"] or 0.0, ends[f"hi{c}"] or 0.0
        step = F.least(F.floor((at[c] - lo) / ((hi - lo) or 1.0) * (1 << bits)), F.lit((1 << bits) - 1))
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(step, b).bitwiseAND(F.lit(1)).cast("long"), 3 * b + k))
    return code


def _placed() -> Column:
    return F.expr(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))


def _probed(boxes: np.ndarray, first: bool):
    """Points with the block that is nearest by its box or, once a distance is known, every other block that can hold a nearer target."""
    number, low, high = boxes[:, 0].astype(np.int64), boxes[:, 1:4], boxes[:, 4:7]
    step = max(1, 2_000_000 // len(boxes))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                at = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
                gap = sum(np.maximum(np.maximum(low[None, :, k] - at[:, k, None], at[:, k, None] - high[None, :, k]), 0) ** 2 for k in range(3))
                if first:
                    i, b = np.arange(len(at)), gap.argmin(1)
                else:
                    near = gap <= batch.column("d2").to_numpy()[:, None] * (1 + 1e-9)
                    near[np.arange(len(at)), np.searchsorted(number, batch.column("block").to_numpy())] = False
                    i, b = np.nonzero(near)
                rows = batch.select(["point", *"xyz"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(number[b])], names=["point", *"xyz", "block"])

    return run


def _tile():
    """Of each point of a tile its block's nearest target, of equally near ones the smallest."""

    def run(key, points: pa.Table, targets: pa.Table) -> pa.Table:
        targets = targets.sort_by("target")
        p, t = ([np.asarray(x.column(c)) for c in "xyz"] for x in (points, targets))
        best, d2, step = np.zeros(len(points), np.int64), np.zeros(len(points)), max(1, 500_000 // max(len(targets), 1))
        for start in range(0, len(points), step):
            x, y, z = ((p[k][start : start + step, None] - t[k][None]) ** 2 for k in range(3))
            d = x + y + z
            best[start : start + step] = d.argmin(1)
            d2[start : start + step] = d.min(1)
        out = points.select(["point", *"xyz", "block"])
        return out.append_column("d2", pa.array(d2)).append_column("target", targets.column("target").take(pa.array(best)))

    # grouped functions tell their kind by whole annotations or none
    run.__annotations__ = {}
    return run


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str) -> DataFrame:
    """(point, target, d2): the nearest target of each point by x, y, z; ties go to the smaller target. Points without a place have none.

    Targets are sorted along a curve into blocks, whose boxes (a row for each 4096 targets) go to the tasks. A point
    first meets the block whose box is nearest, then those whose boxes are no further off than what it found: no
    pair of point and target is ever a row. Targets in one place are one.
    """
    kinds = f"point {dict(points.dtypes)[point]}, x double, y double, z double, block long"
    kind = dict(targets.dtypes)[target]
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    every = points.select(F.col(point).alias("point"), *xyz)
    t = stored(targets.select(F.col(target).alias("target"), *xyz).where(_placed()).groupBy(*"xyz").agg(F.min("target").alias("target")))
    ends = t.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    empty = points.sparkSession.createDataFrame([], f"point {dict(points.dtypes)[point]}, target {kind}, d2 double").toDF(point, target, "d2")
    if ends["lox"] is None:
        return empty
    lined = t.withColumn("_m", interleaved({c: F.col(c) for c in "xyz"}, ends)).repartitionByRange("_m").sortWithinPartitions("_m").drop("_m")
    t = stored(lined.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_POINTS).cast("long")))
    boxes = np.array([list(r) for r in t.groupBy("block").agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).orderBy("block").collect()], float)
    p = stored(every.where(_placed()))
    chunks = -(-max(p.count(), 1) // CHUNK_POINTS)

    def met(probes: DataFrame) -> DataFrame:
        at = stored(probes.withColumn("chunk", F.pmod(F.xxhash64("point", *"xyz"), F.lit(chunks))))
        tiles = t.join(at.select("block", F.col("chunk").alias("_chunk")).distinct(), "block").select(*"xyz", "target", F.col("block").alias("_block"), "_chunk")
        found = at.groupBy("block", "chunk").cogroup(tiles.groupBy("_block", "_chunk")).applyInArrow(_tile(), f"{kinds}, d2 double, target {kind}")
        return stored(found)

    near = met(p.mapInArrow(_probed(boxes, True), kinds))
    more = met(near.select("point", *"xyz", "block", "d2").mapInArrow(_probed(boxes, False), kinds)) if len(boxes) > 1 else near
    best = near.unionByName(more).groupBy("point").agg(F.min(F.struct("d2", "target")).alias("m")).select("point", "m.target", "m.d2")
    lost = every.where(~_placed()).select("point").distinct().join(best.select("point"), "point", "left_anti")
    return best.unionByName(lost.withColumns({"target": F.lit(None).cast(kind), "d2": F.lit(None).cast("double")})).toDF(point, target, "d2")


def snap(points: DataFrame, vertices: DataFrame, cell: float | None = None) -> DataFrame:
    """(label, vertex, distance): the nearest vertex of each point; ties go to the smaller number.

    cell is of no effect on the result, and blocks of vertices have made it needless; it is kept for callers.
    """
    return nearest(points, vertices, "label", "vertex").select("label", "vertex", F.sqrt("d2").alias("distance"))


def cart2sph(points: DataFrame) -> DataFrame:
    flat = F.hypot("x", "y")
    return points.withColumns({"az": F.atan2("y", "x"), "el": F.atan2(F.col("z"), flat), "r": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)})


def pol2cart(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("rho") * F.cos("theta"), "y": F.col("rho") * F.sin("theta")})


def scalp_projection(points: DataFrame) -> DataFrame:
    """(label, u, v): the frame of LPA, RPA and Nz, spherical angles, flattened by the cosine of elevation."""
    at = {r["label"]: np.array([r["x"], r["y"], r["z"]]) for r in points.where(F.col("label").isin("Nz", "LPA", "RPA")).collect()}
    if len(at) < 3:
        raise ValueError("Nz, LPA and RPA are needed")
    origin = (at["LPA"] + at["RPA"]) / 2
    ex, ey = at["RPA"] - origin, at["Nz"] - origin
    ez = np.cross(ex, ey)
    size = np.linalg.norm(ex)
    frame = np.array([ex / size, ey / size, ez / np.linalg.norm(ez)])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = frame, -frame @ origin
    s = cart2sph(affine(points, m))
    return s.select("label", (F.cos("el") * F.cos("az")).alias("u"), (F.cos("el") * F.sin("az")).alias("v"))


def spread_points(points: DataFrame) -> DataFrame:
    """(role, label): the first point by label, the farthest from it, and the one of median distance."""
    first = points.orderBy("label").limit(1).select(*[F.col(c).alias(f"_{c}") for c in "xyz"], F.col("label").alias("_l"))
    d = points.join(F.broadcast(first)).select("label", "_l", squared().alias("d2"))
    from pyspark.sql import Window

    w = Window.orderBy("d2", "label")
    ranked = d.withColumn("rn", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    role = F.when(F.col("label") == F.col("_l"), "first").when(F.col("rn") == F.col("n") - 1, "farthest").when(F.col("rn") == F.floor(F.col("n") / 2), "median")
    return ranked.select(role.alias("role"), "label").where("role IS NOT NULL")


def spread_of(points: DataFrame) -> DataFrame:
    """Standard deviation (ddof 0) of the distance to the centroid."""
    c = points.agg(*[F.avg(x).alias(f"_{x}") for x in "xyz"])
    return points.join(F.broadcast(c)).agg(F.stddev_pop(F.sqrt(squared())).alias("spread"))


def register(source: DataFrame, target: DataFrame, mode: str = "trans_rot") -> np.ndarray:
    """4x4 transform on all common labels: trans_rot, trans_rot_isoscale, trans_rot_scale or general.

    The fit needs only the count, the centroids and the second moments, which Spark sums; twelve
    points that have the same moments stand for the rows.
    """
    six = [*"xyz", "_x", "_y", "_z"]
    both = source.select("label", *"xyz").join(target.select("label", *[F.col(c).alias(f"_{c}") for c in "xyz"]), "label")
    sums = both.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in six], *[F.covar_pop(p, q).alias(f"{p}{q}") for i, p in enumerate(six) for q in six[i:]]).first()
    transforms._needs(sums["n"], 4 if mode == "general" else 3)
    moments = np.array([[sums[p + q] if i <= j else sums[q + p] for j, q in enumerate(six)] for i, p in enumerate(six)])
    size, axes = np.linalg.eigh(moments)
    root = (axes * np.sqrt(np.maximum(size, 0))).T
    points = np.array([sums[c] for c in six]) + np.r_[root, -root]
    a, b = points[:, :3], points[:, 3:]
    if mode == "general":
        return transforms.affine(a, b)
    return transforms.rigid(a, b, {"trans_rot": "none", "trans_rot_isoscale": "iso", "trans_rot_scale": "axes"}[mode])


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """face, a, b, c and the coordinates ax ... cz."""
    out = faces
    for k in "abc":
        out = out.join(vertices.select(F.col("vertex").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    return out


def _edge(p: str, q: str) -> list[Column]:
    return [F.col(f"{q}{c}") - F.col(f"{p}{c}") for c in "xyz"]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, a, b, c, nx, ny, nz, area): unit normals, zero where a face has no area."""
    n = _cross(_edge("a", "b"), _edge("a", "c"))
    out = corners(faces, vertices).withColumns({f"_{c}": n[i] for i, c in enumerate("xyz")})
    size = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2)
    return out.select("face", "a", "b", "c", *[F.coalesce(F.try_divide(F.col(f"_{c}"), size), F.lit(0.0)).alias(f"n{c}") for c in "xyz"], (size / 2).alias("area"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean of the adjacent face normals, of unit length."""
    each = face_normals(faces, vertices).select(F.explode(F.array("a", "b", "c")).alias("vertex"), "nx", "ny", "nz")
    mean = each.groupBy("vertex").agg(*[F.avg(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return mean.select("vertex", *[F.coalesce(F.try_divide(F.col(f"n{c}"), size), F.lit(0.0)).alias(f"n{c}") for c in "xyz"])


def edges(faces: DataFrame) -> DataFrame:
    """(i, j, n): undirected edges, i < j, with the number of faces."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("i"), F.greatest(p, q).alias("j"))
    return faces.select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).groupBy("e.i", "e.j").agg(F.count("*").alias("n"))


def average_edge_length(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    e = edges(faces).join(vertices.select(F.col("vertex").alias("i"), *"xyz"), "i").join(vertices.select(F.col("vertex").alias("j"), *[F.col(c).alias(f"_{c}") for c in "xyz"]), "j")
    return e.agg(F.avg(F.sqrt(squared())).alias("length"))


def laplacian(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, j, weight): cotangent weights of edges in both directions, and minus their sum at i = j."""
    c = corners(faces, vertices)
    parts = []
    for p, q, r in ("abc", "bca", "cab"):
        u, v = _edge(p, q), _edge(p, r)
        n = _cross(u, v)
        cot = F.coalesce(F.try_divide(_dot(u, v), F.sqrt(_dot(n, n))), F.lit(0.0)) / 2
        parts += [F.struct(F.col(q).alias("i"), F.col(r).alias("j"), cot.alias("w")), F.struct(F.col(r).alias("i"), F.col(q).alias("j"), cot.alias("w"))]
    w = c.select(F.explode(F.array(*parts)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.w").alias("weight"))
    return w.union(w.groupBy("i").agg((-F.sum("weight")).alias("weight")).select("i", F.col("i").alias("j"), "weight"))


def vertex_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return face_normals(faces, vertices).select(F.explode(F.array("a", "b", "c")).alias("vertex"), (F.col("area") / 3).alias("area")).groupBy("vertex").agg(F.sum("area").alias("area"))


def surface_gradient(faces: DataFrame, vertices: DataFrame, scalars: DataFrame) -> DataFrame:
    """(face, gx, gy, gz) of a scalar per vertex (vertex, value)."""
    f = corners(faces, vertices)
    for k in "abc":
        f = f.join(scalars.select(F.col("vertex").alias(k), F.col("value").alias(f"{k}s")), k)
    n = _cross(_edge("a", "b"), _edge("a", "c"))
    f = f.withColumns({f"_{c}": n[i] for i, c in enumerate("xyz")})
    nn = [F.col(f"_{c}") for c in "xyz"]
    size2 = _dot(nn, nn)
    sides = {"a": _edge("b", "c"), "b": _edge("c", "a"), "c": _edge("a", "b")}
    turned = {k: _cross(nn, e) for k, e in sides.items()}
    return f.select("face", *[F.coalesce(F.try_divide(sum((F.col(f"{k}s") * turned[k][i] for k in "abc"), F.lit(0.0)), size2), F.lit(0.0)).alias(f"g{c}") for i, c in enumerate("xyz")])


def smooth(faces: DataFrame, vertices: DataFrame, rounds: int = 10, grow: float = 0.5, shrink: float = -0.53) -> DataFrame:
    """Taubin smoothing: alternate steps towards and away from the neighbours' mean."""
    e = edges(faces)
    both = e.select("i", "j").union(e.select(F.col("j").alias("i"), F.col("i").alias("j")))
    for k in range(2 * rounds):
        mean = both.join(vertices.select(F.col("vertex").alias("j"), *"xyz"), "j").groupBy("i").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
        step = grow if k % 2 == 0 else shrink
        vertices = vertices.join(mean, vertices["vertex"] == mean["i"], "left").select("vertex", *[(F.col(c) + step * (F.coalesce(f"_{c}", c) - F.col(c))).alias(c) for c in "xyz"])
    return vertices


def voxels_from_segmentation(volume: DataFrame, types: list[str]) -> DataFrame:
    return volume.where(F.col("seg_type").isin(types) & (F.col("label") > 0)).select("i", "j", "k").distinct()


def cell_coordinates(volume: DataFrame, m: np.ndarray) -> DataFrame:
    """World coordinates of voxel centres."""
    return affine(volume.withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double"), "z": F.col("k").cast("double")}), m)


def binary_masks(probabilities: DataFrame) -> DataFrame:
    """(i, j, k, seg_type): the likeliest tissue of each voxel; ties go to the smaller name."""
    return probabilities.groupBy("i", "j", "k").agg(F.min_by("seg_type", F.struct((-F.col("p")).alias("p"), F.col("seg_type"))).alias("seg_type"))


def overlapping_voxels(volume: DataFrame) -> DataFrame:
    return volume.where("label > 0").groupBy("i", "j", "k").agg(F.count("*").alias("n")).where("n > 1")
