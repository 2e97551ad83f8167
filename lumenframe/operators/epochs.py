"""Epochs around events, interpolation by as-of joins, and block statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import along_time, trace_keys


def to_epochs(ts: DataFrame, stim: DataFrame, before: float, after: float, fs: float, trial_types: list[str] | None = None) -> DataFrame:
    """Values on a grid of 1/fs around each onset, linear between samples.

    stim: event_id, onset, trial_type. An event whose window leaves a recording is skipped. The
    samples of a trace are found by a bucket of time, so the join is an equi-join.
    """
    keys = [c for c in trace_keys(ts)]
    nb, na, dt = _up(before * fs), _up(after * fs), round(1 / fs, 3)
    ev = stim if trial_types is None else stim.where(F.col("trial_type").isin(trial_types))
    ev = ev.select(F.col("event_id").alias("epoch"), "onset", "trial_type")
    w = along_time(ts)
    cells = ts.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    cells = cells.withColumn("_t1", F.lead("time").over(w)).withColumn("_v1", F.lead("value").over(w)).withColumn("_t_", F.lag("time").over(w))
    lo = F.coalesce((F.col("_t_") + F.col("time")) / 2, F.col("time") - (F.col("_t1") - F.col("time")) / 2)
    hi = F.coalesce((F.col("_t1") + F.col("time")) / 2, F.col("time") + (F.col("time") - F.col("_t_")) / 2)
    cells = cells.withColumn("_lo", lo).withColumn("_hi", hi)
    near = ev.select("*", F.explode(F.array(*[F.floor(F.col("onset") * fs) + j for j in (-1, 0, 1)])).alias("_b"))
    mid = cells.withColumn("_b", F.floor(F.col("time") * fs)).join(F.broadcast(near), "_b").where((F.col("onset") >= F.col("_lo")) & (F.col("onset") < F.col("_hi")))
    mid = mid.where((F.col("_i") - nb >= 0) & (F.col("_i") + na < F.col("_n"))).select(*keys, "epoch", "onset", "trial_type").distinct()
    grid = mid.select("*", F.explode(F.sequence(F.lit(-nb), F.lit(na))).alias("rel_idx"))
    grid = grid.withColumn("reltime", F.round(F.col("rel_idx") * dt, 3)).withColumn("_q", F.col("onset") + F.col("reltime"))
    grid = grid.select("*", F.explode(F.array(*[F.floor(F.col("_q") * fs) + j for j in (-1, 0, 1)])).alias("_b"))
    left = cells.select(*keys, F.col("time").alias("_t"), F.col("value").alias("_v"), "_t1", "_v1", F.floor(F.col("time") * fs).alias("_b"), (F.col("_i") == 0).alias("_first"))
    hit = grid.join(left, [*keys, "_b"]).where(F.col("_t1").isNotNull() & ((F.col("_q") >= F.col("_t")) | F.col("_first")))
    best = hit.groupBy(*keys, "epoch", "trial_type", "rel_idx", "reltime").agg(F.max_by(F.struct("_t", "_v", "_t1", "_v1", "_q"), F.col("_t")).alias("c"))
    value = F.col("c._v") + (F.col("c._q") - F.col("c._t")) * (F.col("c._v1") - F.col("c._v")) / (F.col("c._t1") - F.col("c._t"))
    return best.select(*keys, "epoch", "trial_type", "rel_idx", "reltime", value.alias("value"))


def _up(x: float) -> int:
    return math.ceil(round(x, 9))


def baseline_correct(epochs: DataFrame) -> DataFrame:
    """Less the mean before the event, per epoch."""
    keys = [c for c in epochs.columns if c not in ("rel_idx", "reltime", "value")]
    w = Window.partitionBy(*keys)
    return epochs.withColumn("value", F.col("value") - F.avg(F.when(F.col("reltime") < 0, F.col("value"))).over(w))


def block_average(epochs: DataFrame) -> DataFrame:
    keys = [c for c in epochs.columns if c not in ("epoch", "value", "rel_idx")]
    return epochs.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def features(epochs: DataFrame, mean_to: float, extremes_to: float) -> DataFrame:
    """Mean over [0, mean_to], minimum and maximum over [0, extremes_to] of each epoch."""
    keys = [c for c in epochs.columns if c not in ("rel_idx", "reltime", "value")]
    inside = lambda top: F.when(F.col("reltime").between(0, top), F.col("value"))
    return epochs.groupBy(*keys).agg(F.avg(inside(mean_to)).alias("mean"), F.min(inside(extremes_to)).alias("min"), F.max(inside(extremes_to)).alias("max"))


def stim_onehot(stim: DataFrame, ts: DataFrame, types: list[str]) -> DataFrame:
    """One row per time with a 0/1 column for each trial type; an onset counts only at its exact time."""
    at = stim.groupBy(F.col("onset").alias("time")).pivot("trial_type", types).agg(F.count("*"))
    out = ts.select("time").distinct().join(at, "time", "left")
    return out.select("time", *[F.least(F.coalesce(F.col(f"`{t}`"), F.lit(0)), F.lit(1)).alias(t) for t in types])


def rename_events(stim: DataFrame, names: dict[str, str]) -> DataFrame:
    return stim.replace(names, subset=["trial_type"])


def conditions(stim: DataFrame) -> DataFrame:
    return stim.select("trial_type").distinct()
