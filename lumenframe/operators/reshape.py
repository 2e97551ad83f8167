"""Selection by label, composite keys, gaps, and measurement lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import along_time, trace_keys


def select_nearest(ts: DataFrame, time: float) -> DataFrame:
    """Of each trace the sample nearest to a time; the earlier one of two."""
    keys = trace_keys(ts)
    best = F.min_by(F.struct("time", "value"), F.struct(F.abs(F.col("time") - time).alias("d"), F.col("time").alias("t")))
    return ts.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.time", "c.value")


def select_matching(ts: DataFrame, pattern: str) -> DataFrame:
    """Channels whose whole name matches a regular expression."""
    return ts.where(F.col("channel").rlike(f"^(?:{pattern})"))


def channels_of_optodes(ts: DataFrame, optodes: list[str]) -> DataFrame:
    """Channels whose source or detector is listed, sorted."""
    return ts.where(F.col("source").isin(optodes) | F.col("detector").isin(optodes)).select("channel").distinct().orderBy("channel")


def stack(df: DataFrame, name: str, *dims: str) -> DataFrame:
    """Dimensions as one struct column; unstack takes it apart."""
    return df.withColumn(name, F.struct(*dims)).drop(*dims)


def unstack(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def interpolate_na(ts: DataFrame) -> DataFrame:
    """NULLs between known samples of a trace on the line between them; those outside stay."""
    w = along_time(ts)
    known = F.when(F.col("value").isNotNull(), F.struct("time", "value"))
    lo, hi = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = lo["value"] + (hi["value"] - lo["value"]) * (F.col("time") - lo["time"]) / F.nullif(hi["time"] - lo["time"], F.lit(0.0))
    return ts.withColumn("value", F.coalesce("value", line))


def denormalize_measurements(ml: DataFrame, sources: DataFrame, detectors: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """1-based indices of a measurement list as labels; channel is source and detector. An index below 1 raises when the job runs.

    sources, detectors: (index, label); wavelengths: (index, wavelength).
    """
    name = lambda df, k: df.select(F.col("index").alias(f"{k}_index"), F.col("label").alias(k))
    out = ml.join(name(sources, "source"), "source_index", "left").join(name(detectors, "detector"), "detector_index", "left")
    out = out.join(wavelengths.select(F.col("index").alias("wavelength_index"), "wavelength"), "wavelength_index", "left")
    bad = F.assert_true((F.col("source_index") >= 1) & (F.col("detector_index") >= 1), "indices start at 1")
    return out.withColumn("channel", F.coalesce(bad.cast("string"), F.concat("source", "detector")))


def measurement_list(ts: DataFrame) -> DataFrame:
    """1-based indices of sorted source, detector and wavelength labels of the channels of a series."""
    rank = lambda df, c: df.select(c).distinct().select(c, F.dense_rank().over(Window.orderBy(c)).alias(f"{c}_index"))
    rows = ts.select("channel", "source", "detector", "wavelength").distinct()
    for c in ("source", "detector", "wavelength"):
        rows = rows.join(rank(rows, c), c)
    return rows.select("channel", "source", "detector", "wavelength", "source_index", "detector_index", "wavelength_index")
