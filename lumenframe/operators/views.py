"""The tables behind plots: what would be drawn, not the drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import scalp_projection


def scalp_view(metric: DataFrame, channels: DataFrame, points: DataFrame, min_distance: float | None = None, distances: DataFrame | None = None) -> DataFrame:
    """(channel, u0, v0, u1, v1, value): each channel as a line of the flattened scalp with its metric."""
    flat = scalp_projection(points)
    at = lambda p, k: flat.select(F.col("label").alias(p), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}"))
    out = channels.join(at("source", 0), "source").join(at("detector", 1), "detector").join(metric, "channel")
    if min_distance is not None:
        out = out.join(distances.where(F.col("distance") >= min_distance).select("channel"), "channel", "left_semi")
    return out.select("channel", "u0", "v0", "u1", "v1", "value")


def nearest_frames(ts: DataFrame, start: float, stop: float, fps: float) -> DataFrame:
    """(frame, trace keys, value): the sample nearest to each frame's time."""
    keys = [c for c in ts.columns if c not in ("sample", "time", "value")]
    frames = ts.sparkSession.range(int((stop - start) * fps) + 1).select(F.col("id").alias("frame"), (F.lit(float(start)) + F.col("id") / fps).alias("_t"))
    return ts.where(F.col("time").between(start - 1, stop + 1)).join(F.broadcast(frames)).groupBy("frame", *keys).agg(F.min_by("value", F.struct(F.abs(F.col("time") - F.col("_t")).alias("d"), F.col("time"))).alias("value"))


def colours(values: DataFrame, log_scale: bool = False, top: float | None = None) -> DataFrame:
    """(..., r, g, b, a): values as bytes from grey to red, on a linear or logarithmic scale.

    A byte that is half way is rounded up, also where the last bit of a mean, which hangs on the order of its sum,
    has put it below.
    """
    peak = values.agg(F.coalesce(F.lit(top), F.max("value")).alias("_top"))
    x = F.col("value") / F.col("_top")
    x = F.log1p(F.greatest(x, F.lit(0.0)) * 9) / F.log(F.lit(10.0)) if log_scale else x
    level = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    byte = lambda c: F.round(F.round(c, 9)).cast("int")
    return values.join(F.broadcast(peak)).withColumns({"r": byte(180 + 75 * level), "g": byte(180 * (1 - level)), "b": byte(180 * (1 - level)), "a": F.lit(255)}).drop("_top")


def channel_counts(mask: DataFrame) -> DataFrame:
    """Clean and tainted channels by time."""
    return mask.groupBy("time").agg(F.count_if("mask").alias("clean"), F.count_if(~F.col("mask")).alias("tainted"))
