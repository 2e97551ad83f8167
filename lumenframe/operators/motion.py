"""Motion correction over all channels: principal components of artefact samples, stitched to the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import trace_keys
from . import decomposition, quality, windows


def motion_correct_pca(ts: DataFrame, mask: DataFrame, share: float = 0.97) -> DataFrame:
    """ts with the leading components of the masked-out samples removed there, and runs levelled on each other.

    mask: (sample, mask), false where any channel moves. share below 1: as few components as reach
    that share of the variance; otherwise their number. Spark sums the Gram matrix of the z-scored
    artefact samples over the channels or, where these are fewer, over the samples; its decomposition is a small matrix
    on the driver. Both give the same components; ValueError if channels and artefact samples are both too many.
    """
    keys = trace_keys(ts)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    named = ts.withColumn("_c", name)
    bad = named.join(mask.where(~F.col("mask")).select("sample"), "sample")
    w = Window.partitionBy("_c")
    sd = F.stddev_pop("value").over(w)
    z = bad.withColumn("_mean", F.avg("value").over(w)).withColumn("_sd", F.when(sd == 0, 1.0).otherwise(sd)).withColumn("_z", (F.col("value") - F.col("_mean")) / F.col("_sd"))
    flat = z.select(F.col("_c").alias("channel"), "sample", F.col("_z").alias("value"))
    few = lambda c: [r[0] for r in flat.select(c).distinct().orderBy(c).limit(decomposition.MAX_CHANNELS + 1).collect()]
    labels, samples = few("channel"), few("sample")
    if not labels:
        return ts
    if len(samples) < len(labels):
        parts = _leading_by_samples(flat, samples, share)
    else:
        lam, v = np.linalg.eigh(decomposition.dense(decomposition.cross_gram(flat, flat), labels, labels))
        weights = decomposition.weights_table(ts.sparkSession, labels, v[:, ::-1][:, : _count(lam[::-1], share)])
        parts = decomposition.project(flat, weights).join(F.broadcast(weights), "component").groupBy(F.col("channel").alias("_c"), "sample").agg(F.sum(F.col("value") * F.col("weight")).alias("_p"))
    fixed = z.join(parts, ["_c", "sample"]).select("_c", "sample", ((F.col("_z") - F.col("_p")) * F.col("_sd") + F.col("_mean")).alias("_new"))
    out = named.join(fixed, ["_c", "sample"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
    return _stitch(out.join(mask.select("sample", "mask"), "sample"), keys)


def _count(lam: np.ndarray, share: float) -> int:
    return int(share) if share >= 1 else int(np.searchsorted(np.cumsum(lam) / max(lam.sum(), 1e-300), share)) + 1


def _leading_by_samples(flat: DataFrame, samples: list[int], share: float) -> DataFrame:
    """(_c, sample, _p): the part of each cell in the leading components, from the Gram matrix of the samples.

    With the leading eigenvectors U of that matrix, the part is U U' times the channel's samples, so each channel
    is projected by itself.
    """
    swapped = flat.select(F.col("sample").alias("channel"), F.col("channel").alias("sample"), "value")
    lam, v = np.linalg.eigh(decomposition.dense(decomposition.cross_gram(swapped, swapped), samples, samples))
    u = v[:, ::-1][:, : _count(lam[::-1], share)]
    # of channels side by side, as many as make a matrix of bounded size
    step = max(1, 1_000_000 // len(samples))

    def run(batches):
        known = pa.array(samples)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cells = part.column("cells").flatten()
                at = cells.field("sample")
                i = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("cells")).to_numpy())
                k = pc.index_in(at, value_set=known).to_numpy()
                z = np.zeros((part.num_rows, len(samples)))
                value = cells.field("value").to_numpy(zero_copy_only=False)
                some = ~np.isnan(value)
                np.add.at(z, (i[some], k[some]), value[some])
                yield pa.RecordBatch.from_arrays([part.column("_c").take(pa.array(i)), at, pa.array((z @ u @ u.T)[i, k])], names=["_c", "sample", "_p"])

    rows = flat.groupBy(F.col("channel").alias("_c")).agg(F.collect_list(F.struct("sample", "value")).alias("cells"))
    return rows.mapInArrow(run, "_c string, sample long, _p double")


def _stitch(ts: DataFrame, keys: list[str]) -> DataFrame:
    """Each run starts where the one before ended: offsets of the jumps between runs, summed."""
    w = Window.partitionBy("_c").orderBy("sample")
    new = F.coalesce(F.col("mask") != F.lag("mask").over(w), F.lit(False))
    jump = F.when(new, F.col("value") - F.lag("value").over(w)).otherwise(0.0)
    return ts.withColumn("_j", jump).withColumn("value", F.col("value") - F.sum("_j").over(w)).select(*keys, "sample", "time", "value")


def motion_correct_pca_recurse(ts: DataFrame, fs: float, rounds: int = 5, share: float = 0.97, materialize=None, **how) -> DataFrame:
    """Correct until no motion is found or the rounds are over; materialize cuts the lineage between rounds."""
    for _ in range(rounds):
        mask = quality.id_motion_refine(quality.id_motion(ts, fs, **how), "all")[0].select("sample", "mask")
        if mask.where(~F.col("mask")).isEmpty():
            break
        ts = motion_correct_pca(ts, mask, share)
        ts = materialize(ts) if materialize else ts
    return ts


def baseline_shifts(ts: DataFrame, outlier_mask: DataFrame, fs: float, snr_least: float = 3.0) -> DataFrame:
    """(channel, sample, mask): artefact runs of plausible length whose change exceeds the channel's median change.

    The mask of the channel's wavelength with the best signal-to-noise ratio counts; a channel in
    which none reaches snr_least is tainted throughout.
    """
    keys = trace_keys(ts)
    segs = windows.segments(outlier_mask)
    snr = windows.segment_snr(ts, segs, fs)
    limit = windows.delta_threshold(ts, outlier_mask, max(1, round(0.5 * fs)))
    cand = windows.baseline_shift_lengths(segs, fs).join(limit, keys)
    ends = ts.join(cand, keys).where((F.col("sample") == F.col("start") - 1) | (F.col("sample") == F.col("stop")))
    hit = ends.groupBy(*keys, "start", "stop").agg((F.abs(F.max_by("value", "sample") - F.min_by("value", "sample")) > F.first("threshold")).alias("shift")).where("shift")
    inside = ts.select(*keys, "sample").join(hit.select(*keys, "start", "stop"), keys).where((F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("stop"))).select(*keys, "sample").distinct().withColumn("_bad", F.lit(True))
    per = ts.select(*keys, "sample").join(inside, [*keys, "sample"], "left").join(snr, keys).withColumn("mask", F.col("_bad").isNull())
    best = per.groupBy("channel", "sample").agg(F.max_by("mask", "snr").alias("mask"), F.max("snr").alias("_top"))
    return best.select("channel", "sample", (F.col("mask") & (F.col("_top") >= snr_least)).alias("mask"))
