"""Sensitivities, inverse solution and parcels over long tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sensitivity(fluence: DataFrame, at_optodes: DataFrame, voxel_to_vertex: DataFrame, channels: DataFrame, unit_mm: float = 1.0) -> DataFrame:
    """(channel, wavelength, vertex, value): product of both optodes' fluence, summed by vertex, over their mean fluence at each other.

    fluence: label, wavelength, voxel, value. at_optodes: label, other, wavelength, value.
    """
    f = lambda role: fluence.select(F.col("label").alias(role), "wavelength", "voxel", F.col("value").alias(f"f_{role}"))
    pair = channels.select("channel", "source", "detector")
    product = f("source").join(pair, "source").join(f("detector"), ["detector", "wavelength", "voxel"])
    by = product.join(voxel_to_vertex.select("voxel", "vertex"), "voxel").groupBy("channel", "source", "detector", "wavelength", "vertex").agg(F.sum(F.col("f_source") * F.col("f_detector")).alias("s"))
    one = at_optodes.select(F.col("label").alias("source"), F.col("other").alias("detector"), "wavelength", F.col("value").alias("n1"))
    two = at_optodes.select(F.col("label").alias("detector"), F.col("other").alias("source"), "wavelength", F.col("value").alias("n2"))
    keys = ["source", "detector", "wavelength"]
    return by.join(one, keys).join(two, keys).select("channel", "wavelength", "vertex", (F.col("s") / ((F.col("n1") + F.col("n2")) / 2) * unit_mm**3).alias("value"))


def stacked_sensitivity(adot: DataFrame, coef: DataFrame) -> DataFrame:
    """(channel, wavelength, chromo, vertex, value): extinction times sensitivity."""
    return adot.join(F.broadcast(coef), "wavelength").select("channel", "wavelength", "chromo", "vertex", (F.col("value") * F.col("coef")).alias("value"))


def pseudo_inverse(stacked: DataFrame, alpha: float = 0.01, alpha_spatial: float | None = None, noise: DataFrame | None = None) -> DataFrame:
    """(chromo, vertex, channel, wavelength, value): Tikhonov inverse, B = L^-2 A'(A_hat A_hat' + lambda C)^-1.

    Only the measurement-sized Gram matrix comes to the driver; the product with A' is a join.
    noise: channel, wavelength, variance (identity if None).
    """
    a = stacked
    if alpha_spatial is not None:
        col = Window.partitionBy("chromo", "vertex")
        energy = a.withColumn("_e", F.sum(F.col("value") ** 2).over(col))
        top = energy.agg(F.max("_e").alias("_t"))
        a = energy.join(F.broadcast(top)).withColumn("_l2", F.col("_e") + alpha_spatial * F.col("_t")).drop("_e", "_t")
    else:
        a = a.withColumn("_l2", F.lit(1.0))
    left = a.select("chromo", "vertex", F.struct("channel", "wavelength").alias("p"), F.col("value").alias("vp"), "_l2")
    right = a.select("chromo", "vertex", F.struct("channel", "wavelength").alias("q"), F.col("value").alias("vq"))
    g = left.join(right, ["chromo", "vertex"]).groupBy("p", "q").agg(F.sum(F.col("vp") * F.col("vq") / F.col("_l2")).alias("g")).collect()
    names = sorted({tuple(r["p"]) for r in g})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in g:
        m[at[tuple(r["p"])], at[tuple(r["q"])]] = r["g"]
    c = np.ones(len(names))
    if noise is not None:
        for r in noise.collect():
            if (r["channel"], r["wavelength"]) in at:
                c[at[r["channel"], r["wavelength"]]] = r["variance"]
    inv = np.linalg.inv(m + alpha * np.linalg.eigvalsh(m).max() * np.diag(c))
    table = a.sparkSession.createDataFrame([(*names[i], *names[j], float(inv[i, j])) for i in range(len(names)) for j in range(len(names))], "channel string, wavelength double, out_channel string, out_wavelength double, inv double")
    return a.join(F.broadcast(table), ["channel", "wavelength"]).groupBy("chromo", "vertex", F.col("out_channel").alias("channel"), F.col("out_wavelength").alias("wavelength")).agg(F.sum(F.col("value") / F.col("_l2") * F.col("inv")).alias("value"))


def apply_inverse(od: DataFrame, inverse: DataFrame) -> DataFrame:
    """(chromo, vertex, sample, value)."""
    w = inverse.select("chromo", "vertex", "channel", "wavelength", F.col("value").alias("b"))
    return od.join(w, ["channel", "wavelength"]).groupBy("chromo", "vertex", "sample").agg(F.sum(F.col("value") * F.col("b")).alias("value"))


def parcel_sensitivity(adot: DataFrame, coef: DataFrame, drop: list[str] | None = None, threshold: float = 0.001, min_channels: int = 1, d_hbo: float = 10.0, d_hbr: float = -3.0) -> DataFrame:
    """(parcel, n_channels, mask): channels in which an assumed change (micromolar) exceeds the threshold at some wavelength."""
    change = coef.groupBy("wavelength").agg(F.sum(F.col("coef") * F.when(F.col("chromo") == "HbO", d_hbo * 1e-6).otherwise(d_hbr * 1e-6)).alias("d"))
    each = adot.where(~F.col("channel").isin(drop or [])).groupBy("channel", "wavelength", "parcel").agg(F.sum("value").alias("s")).join(F.broadcast(change), "wavelength")
    hit = each.groupBy("channel", "parcel").agg(F.bool_or(F.abs(F.col("s") * F.col("d")) > threshold).alias("hit"))
    return hit.groupBy("parcel").agg(F.count_if("hit").alias("n_channels")).withColumn("mask", F.col("n_channels") >= min_channels)


def by_parcel(image: DataFrame, parcels: DataFrame, how: str = "sum") -> DataFrame:
    keys = [c for c in image.columns if c not in ("vertex", "value")]
    return image.join(parcels.select("vertex", "parcel"), "vertex").groupBy(*keys, "parcel").agg((F.sum if how == "sum" else F.avg)("value").alias("value"))


def map_voxels(voxels: DataFrame, vertices: DataFrame, cell: float) -> DataFrame:
    """(voxel, vertex): the nearest vertex of each voxel (voxel, x, y, z), searched in cells."""
    from .geometry import snap

    return snap(voxels.withColumnRenamed("voxel", "label"), vertices, cell).select(F.col("label").alias("voxel"), "vertex")


def mock_activation(vertices: DataFrame, point: tuple[float, float, float], times: DataFrame, size: float, t_peak: float, t_std: float, vmax: float) -> DataFrame:
    """(vertex, sample, value): Gaussian in space around a point, Gaussian in time."""
    d2 = sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip("xyz", point, strict=True)), F.lit(0.0))
    blob = vertices.select("vertex", F.exp(-d2 / (2 * size * size)).alias("g"))
    hrf = F.broadcast(times.select("sample", (F.exp(-0.5 * ((F.col("time") - t_peak) / t_std) ** 2) * vmax).alias("h")))
    return blob.join(hrf).select("vertex", "sample", (F.col("g") * F.col("h")).alias("value"))


#: tissue: absorption 1/mm, scattering 1/mm, anisotropy, refraction (fixed values)
TISSUES = {
    "skin": (0.0191, 0.66, 0.001, 1.0),
    "skull": (0.0136, 0.86, 0.001, 1.0),
    "dura mater": (0.0191, 0.66, 0.001, 1.0),
    "csf": (0.0026, 0.01, 0.001, 1.0),
    "gray matter": (0.0186, 1.1, 0.001, 1.0),
    "white matter": (0.0186, 1.1, 0.001, 1.0),
}
#: other names of the same tissues (fixed values)
TISSUE_NAMES = {"scalp": "skin", "bone": "skull", "dura": "dura mater", "dm": "dura mater", "cerebral spinal fluid": "csf", "gm": "gray matter", "brain": "gray matter", "wm": "white matter"}


def tissue_properties(volume: DataFrame, table: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Optical constants by segmentation label; a label without any raises when the job runs."""
    table = table or TISSUES | {k: TISSUES[v] for k, v in TISSUE_NAMES.items()}
    rows = [(k, *v) for k, v in table.items()]
    props = volume.sparkSession.createDataFrame(rows, "seg_type string, absorption double, scattering double, anisotropy double, refraction double")
    out = volume.select("seg_type").distinct().join(F.broadcast(props), "seg_type", "left")
    return out.withColumn("absorption", F.coalesce(F.assert_true(F.col("absorption").isNotNull(), "unknown tissue").cast("double"), F.col("absorption")))


def spatial_activation(distances: DataFrame, scale: float, intensity: float, hbr_scale: float | None = None) -> DataFrame:
    """(vertex, chromo, value): Gaussian of the geodesic distance (vertex, distance); HbR as a share of HbO if asked."""
    blob = distances.select("vertex", (F.exp(-((F.col("distance") / scale) ** 2) / 2) * intensity).alias("value"))
    out = blob.withColumn("chromo", F.lit("HbO"))
    return out if hbr_scale is None else out.unionByName(blob.select("vertex", (F.col("value") * hbr_scale).alias("value"), F.lit("HbR").alias("chromo")))
