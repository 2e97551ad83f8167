"""Segments, lags, embeddings, convolution and resampling-free window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import along_time, trace, trace_keys


def segments(mask: DataFrame) -> DataFrame:
    """Runs of equal mask values: (keys, start, stop, mask), start inclusive and stop exclusive in samples."""
    keys = [c for c in mask.columns if c not in ("sample", "time", "mask")]
    w = Window.partitionBy(*keys).orderBy("sample")
    new = F.coalesce((F.col("mask") != F.lag("mask").over(w)).cast("long"), F.lit(0))
    runs = mask.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("sample").alias("start"), (F.max("sample") + 1).alias("stop"), F.first("mask").alias("mask")).drop("_run")


def segment_snr(ts: DataFrame, segs: DataFrame, fs: float, least_s: float = 3.0) -> DataFrame:
    """Mean over segments longer than least_s of |mean| / (deviation + 1e-16); of the whole trace if there are none."""
    keys = [c for c in segs.columns if c not in ("start", "stop", "mask")]
    ratio = F.abs(F.avg("value")) / (F.stddev_pop("value") + 1e-16)
    whole = ts.groupBy(*keys).agg(ratio.alias("_whole"))
    long = segs.where("mask").where((F.col("stop") - F.col("start")) > least_s * fs)
    per = ts.join(long, keys).where((F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("stop"))).groupBy(*keys, "start").agg(ratio.alias("_r")).groupBy(*keys).agg(F.avg("_r").alias("_snr"))
    return whole.join(per, keys, "left").select(*keys, F.coalesce("_snr", "_whole").alias("snr"))


def delta_threshold(ts: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """Median of |x[t + k] - x[t]| inside clean segments."""
    keys = trace_keys(ts)
    both = ts.join(mask.select(*keys, "sample", "mask"), [*keys, "sample"])
    w = Window.partitionBy(*keys).orderBy("sample")
    new = F.coalesce((F.col("mask") != F.lag("mask").over(w)).cast("long"), F.lit(0))
    runs = both.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where("mask")
    d = runs.withColumn("_d", F.abs(F.lead("value", k).over(Window.partitionBy(*keys, "_run").orderBy("sample")) - F.col("value")))
    return d.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("threshold"))


def diff(ts: DataFrame) -> DataFrame:
    return ts.withColumn("value", F.col("value") - F.lag("value").over(along_time(ts))).where(F.col("value").isNotNull())


def shift(ts: DataFrame, k: int) -> DataFrame:
    return ts.withColumn("value", F.lag("value", k).over(along_time(ts)))


def temporal_embedding(ts: DataFrame, shifts: list[int]) -> DataFrame:
    """Time-lagged copies with a column shift; the head is zero."""
    w = along_time(ts)
    cells = F.array(*[F.struct(F.lit(s).alias("shift"), F.lag("value", s, 0.0).over(w).alias("value")) for s in shifts])
    return ts.withColumn("_c", cells).select(*[c for c in ts.columns if c != "value"], F.explode("_c").alias("_e")).select(*[c for c in ts.columns if c != "value"], "_e.shift", "_e.value")


def convolve(ts: DataFrame, kernel: list[float]) -> DataFrame:
    """Same-size convolution along time, zero beyond the edges."""
    n, w = len(kernel), along_time(ts)
    at = lambda o: F.lag("value", o, 0.0).over(w) if o > 0 else F.lead("value", -o, 0.0).over(w) if o < 0 else F.col("value")
    return ts.withColumn("value", sum((F.lit(float(k)) * at(j - (n - 1) // 2) for j, k in enumerate(kernel)), F.lit(0.0)))


def strided_windows(ts: DataFrame, n: int) -> DataFrame:
    """Adjacent windows of n samples as a column window; the last may be short."""
    return ts.withColumn("window", F.floor(F.col("sample") / n).cast("long"))


def standardize(ts: DataFrame) -> DataFrame:
    """Zero mean and unit deviation (ddof 0) per trace; a constant trace is only centred."""
    sd = F.stddev_pop("value").over(trace(ts))
    return ts.withColumn("value", (F.col("value") - F.avg("value").over(trace(ts))) / F.when(sd == 0, 1.0).otherwise(sd))


def ar_filter(ts: DataFrame, coefs: list[float]) -> DataFrame:
    """Whitening filter [1, -a1, -a2, ...] of the demeaned trace, zero before its start."""
    centred = ts.withColumn("value", F.col("value") - F.avg("value").over(trace(ts)))
    w = along_time(ts)
    return centred.withColumn("value", F.col("value") - sum((F.lit(float(a)) * F.lag("value", i + 1, 0.0).over(w) for i, a in enumerate(coefs)), F.lit(0.0)))


def baseline_shift_lengths(segs: DataFrame, fs: float, short: float = 0.1, long: float = 0.49999) -> DataFrame:
    """Artefact segments whose length lies between the two rules (seconds)."""
    n = F.col("stop") - F.col("start")
    return segs.where(~F.col("mask")).where((n > short * fs) & (n < long * fs))


def edge_pad(ts: DataFrame, n: int) -> DataFrame:
    """n copies of the first and last value before and after each trace; samples go on in both directions."""
    keys, by = trace_keys(ts), trace_keys(ts)
    ends = ts.groupBy(*by).agg(F.min_by("value", "sample").alias("first"), F.max_by("value", "sample").alias("last"), F.min("sample").alias("lo"), F.max("sample").alias("hi"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    dt = (F.col("t1") - F.col("t0")) / (F.col("hi") - F.col("lo"))
    k = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    more = ends.select(*keys, "first", "last", "lo", "hi", "t0", "t1", dt.alias("dt"), k)
    head = more.select(*keys, (F.col("lo") - F.col("k")).alias("sample"), (F.col("t0") - F.col("k") * F.col("dt")).alias("time"), F.col("first").alias("value"))
    tail = more.select(*keys, (F.col("hi") + F.col("k")).alias("sample"), (F.col("t1") + F.col("k") * F.col("dt")).alias("time"), F.col("last").alias("value"))
    return ts.select(*keys, "sample", "time", "value").unionByName(head).unionByName(tail)
