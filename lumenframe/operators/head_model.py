"""A head model: the tables of a segmented head with its brain and scalp surfaces."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry


@dataclass
class HeadModel:
    voxels: DataFrame
    brain_vertices: DataFrame
    brain_faces: DataFrame
    scalp_vertices: DataFrame
    scalp_faces: DataFrame
    landmarks: DataFrame | None = None
    voxel_to_brain: DataFrame | None = None
    voxel_to_scalp: DataFrame | None = None

    @property
    def crs(self) -> str | None:
        found = {geometry.crs_of(self.brain_vertices), geometry.crs_of(self.scalp_vertices)}
        if len(found) > 1:
            raise geometry.CRSMismatchError(f"surfaces in different systems: {found}")
        return found.pop()

    def apply_transform(self, m: np.ndarray, to_crs: str | None = None) -> HeadModel:
        """Surfaces and landmarks moved by a 4x4 matrix."""
        moved = {n: geometry.affine(getattr(self, n), m, None, to_crs) for n in ("brain_vertices", "scalp_vertices", "landmarks") if getattr(self, n) is not None}
        return replace(self, **moved)

    def save(self, path: str) -> None:
        for f in fields(self):
            if getattr(self, f.name) is not None:
                getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, parts: tuple[str, ...] = ("voxels", "brain_vertices", "brain_faces", "scalp_vertices", "scalp_faces")) -> HeadModel:
        return cls(**{p: spark.read.parquet(f"{path}/{p}") for p in parts})

    def snap_to_scalp(self, points: DataFrame, cell: float | None = None) -> DataFrame:
        """points on their nearest scalp vertices."""
        at = geometry.snap(points, self.scalp_vertices, cell)
        return points.drop("x", "y", "z").join(at, "label").join(self.scalp_vertices, "vertex").select("label", "type", "x", "y", "z")

    def snap_to_scalp_voxels(self, points: DataFrame, cell: float | None = None) -> DataFrame:
        """(label, voxel): of the voxels mapped to a point's scalp vertex the nearest; of all scalp voxels if there are none.

        voxels: voxel, x, y, z. voxel_to_scalp: voxel, vertex.
        """
        at = geometry.snap(points, self.scalp_vertices, cell).select("label", "vertex").join(points.select("label", *"xyz"), "label")
        v = self.voxels.select("voxel", *[F.col(c).alias(f"_{c}") for c in "xyz"])
        mine = at.join(self.voxel_to_scalp, "vertex").join(v, "voxel").groupBy("label").agg(F.min(F.struct(geometry.squared().alias("d"), "voxel")).alias("m")).select("label", "m.voxel")
        rest = points.join(mine, "label", "left_anti")
        scalp = self.voxels.join(self.voxel_to_scalp.select("voxel").distinct(), "voxel", "left_semi")
        near = geometry.snap(rest, scalp.withColumnRenamed("voxel", "vertex")).select("label", F.col("vertex").alias("voxel"))
        return mine.unionByName(near)

    def align_and_snap(self, points: DataFrame, mode: str = "trans_rot_isoscale", cell: float | None = None) -> DataFrame:
        """points registered on the landmarks, then snapped to the scalp."""
        return self.snap_to_scalp(geometry.affine(points, geometry.register(points, self.landmarks, mode)), cell)


def fluence_at(fluence: DataFrame, rays: DataFrame) -> DataFrame:
    """(label, other, wavelength, value): the first positive fluence along each optode's inward ray.

    rays: other, step, voxel, in order of step.
    """
    hit = fluence.join(rays, "voxel").where("value > 0")
    return hit.groupBy("label", "other", "wavelength").agg(F.min_by("value", "step").alias("value"))


def inward_rays(points: DataFrame, normals: DataFrame, longest: float, step: float, size: int) -> DataFrame:
    """(other, step, voxel): voxels of a cube of the given size that a ray from each point against its normal meets."""
    at = lambda c: F.round(F.col(c) - F.col("k") * step * F.col(f"n{c}")).cast("long")
    rows = points.join(normals, "label").select("label", *"xyz", "nx", "ny", "nz", F.explode(F.sequence(F.lit(0), F.lit(int(longest / step)))).alias("k"))
    cells = rows.select(F.col("label").alias("other"), F.col("k").alias("step"), at("x").alias("i"), at("y").alias("j"), at("z").alias("l"))
    inside = (F.least("i", "j", "l") >= 0) & (F.greatest("i", "j", "l") < size)
    return cells.where(inside).select("other", "step", ((F.col("i") * size + F.col("j")) * size + F.col("l")).alias("voxel"))


def object_sizes(voxels: DataFrame, materialize, rounds: int = 200) -> DataFrame:
    """(object, n): face-connected objects of a voxel set by their smallest voxel, largest first.

    Labels are taken from neighbours and shortened by their own label in each round; materialize
    writes the labels and so cuts the lineage.
    """
    key = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))
    cells = voxels.select("i", "j", "k").distinct()
    near = F.array(*[key(F.col("i") + a, F.col("j") + b, F.col("k") + c) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    own = key(F.col("i"), F.col("j"), F.col("k"))
    labels = materialize(cells.select(own.alias("v"), own.alias("label")))
    edges = materialize(cells.select(own.alias("v"), F.explode(near).alias("u")).join(cells.select(own.alias("u")), "u", "left_semi"))
    for _ in range(rounds):
        low = edges.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("low"))
        step = labels.join(low, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = step.join(labels.select(F.col("v").alias("_v"), F.col("label").alias("_l")), step["label"] == F.col("_v")).select("v", "old", F.least("label", "_l").alias("label"))
        new = materialize(jump)
        changed = not new.where("old <> label").isEmpty()
        labels = new.select("v", "label")
        if not changed:
            break
    else:
        raise RuntimeError("object labels did not settle")
    return labels.groupBy(F.col("label").alias("object")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object")
