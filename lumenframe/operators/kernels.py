"""Per-trace kernels on Spark: traces are packed to arrays and mapped in Arrow batches of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.schema import pack, trace_keys
from ..functions import signal
from ..functions.linear_models import autoregression
from . import quality


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{n}` {kinds[n]}, " for n in names)


def map_traces(ts: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """ts with the values of each trace replaced by f(times, values)."""
    keys = trace_keys(ts)
    packed = ts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "time", "value"))).alias("c"))
    packed = packed.select(*keys, F.col("c.sample").alias("samples"), F.col("c.time").alias("times"), F.col("c.value").alias("values"))

    def run(batches):
        for pdf in batches:
            pdf["values"] = [f(np.asarray(t, float), np.asarray(v, float)) for t, v in zip(pdf["times"], pdf["values"], strict=True)]
            yield pdf

    out = packed.mapInPandas(run, _types(ts, keys) + "samples array<bigint>, times array<double>, values array<double>")
    cell = F.explode(F.arrays_zip("samples", "times", "values")).alias("c")
    return out.select(*keys, cell).select(*keys, F.col("c.samples").alias("sample"), F.col("c.times").alias("time"), F.col("c.values").alias("value"))


def freq_filter(ts: DataFrame, fs: float, fmin: float, fmax: float, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth filter of each trace; a cutoff of 0 is open. Not causal: streams are refused."""
    if ts.isStreaming:
        raise ValueError("a zero-phase filter needs the whole trace")
    return map_traces(ts, lambda t, x: signal.freq_filter(x, fs, fmin, fmax, order))


def cardiac(ts: DataFrame, fs: float, fmin: float = 0.5, fmax: float = 2.5) -> DataFrame:
    if fs / 2 < fmin:
        raise ValueError("the sampling rate is too low for the cardiac band")
    return freq_filter(ts, fs, fmin, 0 if fs / 2 <= fmax else fmax)


def split_frequency_bands(ts: DataFrame, fs: float) -> DataFrame:
    """Cardiac and respiratory bands as a dimension band."""
    return freq_filter(ts, fs, 0.5, 2.5).withColumn("band", F.lit("cardiac")).unionByName(freq_filter(ts, fs, 0.1, 0.5).withColumn("band", F.lit("respiratory")))


def detect_outliers_std(ts: DataFrame, fs: float, window_s: float, threshold: float = 2.0) -> DataFrame:
    """Clean where the rolling deviation over window_s seconds of the trace below 0.5 Hz stays by its quartiles.

    A window has at least one sample; a trace of one sample is clean.
    """
    return quality.outliers_std(freq_filter(ts, fs, 0, 0.5), max(round(fs * window_s), 1), threshold)


def detect_outliers_grad(ts: DataFrame, fs: float, threshold: float = 1.5) -> DataFrame:
    """Clean where the central difference of the trace below 2 Hz stays by its quartiles; fs must exceed 4 Hz."""
    if fs / 2 <= 2.0:
        raise ValueError("the sampling rate is too low for a cutoff of 2 Hz")
    return quality.outliers_grad(freq_filter(ts, fs, 0, 2.0), threshold)


def detect_outliers(ts: DataFrame, fs: float, window_s: float, threshold_std: float = 2.0, threshold_grad: float = 1.5) -> DataFrame:
    """Clean by both masks."""
    return quality.outliers(detect_outliers_std(ts, fs, window_s, threshold_std), detect_outliers_grad(ts, fs, threshold_grad))


def tddr(ts: DataFrame, fs: float) -> DataFrame:
    return map_traces(ts, lambda t, x: signal.tddr(x, fs))


def motion_correct_wavelet(ts: DataFrame, iqr: float = 1.5, level: int = 4) -> DataFrame:
    return map_traces(ts, lambda t, x: signal.wavelet_repair(x, iqr, level))


def savgol(ts: DataFrame, frame: int, order: int = 3) -> DataFrame:
    return map_traces(ts, lambda t, x: signal.savgol(x, frame | 1, order))


def ampd(ts: DataFrame, chunk: int = 500, step: int = 200) -> DataFrame:
    return map_traces(ts, lambda t, x: signal.ampd(x, chunk, step).astype(float))


def ar_whiten(ts: DataFrame, top: int = 12) -> DataFrame:
    return map_traces(ts, lambda t, x: signal.whiten(x - x.mean(), signal.ar_fit(x, top)))


def fit_ar_coefs(ts: DataFrame, top: int = 12) -> DataFrame:
    """(trace keys, lag, coef): lag 0 is the intercept of the trace less its mean; a trace of white noise has no other."""
    keys = trace_keys(ts)

    def run(batches):
        for pdf in batches:
            fits = [autoregression(np.asarray(v, float), top) for v in pdf["values"]]
            pdf["coefs"] = [np.r_[constant, lags] for constant, lags in fits]
            yield pdf[[*keys, "coefs"]]

    out = pack(ts).select(*keys, "values").mapInPandas(run, _types(ts, keys) + "coefs array<double>")
    return out.select(*keys, F.posexplode("coefs").alias("lag", "coef"))


def resample(ts: DataFrame, fs: float = 4.0) -> DataFrame:
    keys = trace_keys(ts)

    def run(batches):
        for pdf in batches:
            both = [signal.resample(np.asarray(t, float), np.asarray(v, float), fs) for t, v in zip(pdf["times"], pdf["values"], strict=True)]
            pdf["times"], pdf["values"] = [b[0] for b in both], [b[1] for b in both]
            yield pdf

    long = ts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    out = pack(ts.join(long, keys, "left_semi")).mapInPandas(run, _types(ts, keys) + "times array<double>, values array<double>")
    cell = F.posexplode(F.arrays_zip("times", "values")).alias("sample", "c")
    return out.select(*keys, cell).select(*keys, F.col("sample").cast("long").alias("sample"), F.col("c.times").alias("time"), F.col("c.values").alias("value"))


def motion_correct_spline(ts: DataFrame, mask: DataFrame, fs: float, p: float) -> DataFrame:
    """Spline correction of the samples that the mask (same keys and sample) calls tainted."""
    keys = trace_keys(ts)
    both = ts.join(mask.select(*[c for c in mask.columns if c in keys], "sample", "mask"), [*[c for c in mask.columns if c in keys], "sample"])
    packed = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "time", "value", "mask"))).alias("c"))
    packed = packed.select(*keys, F.col("c.sample").alias("samples"), F.col("c.time").alias("times"), F.col("c.value").alias("values"), F.col("c.mask").alias("masks"))

    def run(batches):
        for pdf in batches:
            pdf["values"] = [signal.spline_repair(np.asarray(v, float), np.asarray(m, bool), fs, p) for v, m in zip(pdf["values"], pdf["masks"], strict=True)]
            yield pdf.drop(columns="masks")

    out = packed.mapInPandas(run, _types(ts, keys) + "samples array<bigint>, times array<double>, values array<double>")
    return out.select(*keys, F.explode(F.arrays_zip("samples", "times", "values")).alias("c")).select(*keys, F.col("c.samples").alias("sample"), F.col("c.times").alias("time"), F.col("c.values").alias("value"))


def motion_correct_spline_sg(ts: DataFrame, mask: DataFrame, fs: float, p: float, frame_s: float = 10.0) -> DataFrame:
    return savgol(motion_correct_spline(ts, mask, fs, p), int(round(frame_s * fs)))


def two_wavelengths(ts: DataFrame, fs: float, window_s: float, kernel: Callable, name: str, threshold: float) -> DataFrame:
    """(channel, window, <name>, mask) of a kernel over the two wavelengths of each channel, at the samples that both have.

    Window k ends at the k * n-th of those samples (n: samples of a window), so there is one for each n begun.
    """
    n = int(np.ceil(window_s * fs))
    both = ts.groupBy("channel", "sample").agg(F.array_sort(F.collect_list(F.struct("wavelength", "value"))).alias("w")).where(F.size("w") == 2)
    pairs = both.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("sample", F.col("w")[0]["value"].alias("a"), F.col("w")[1]["value"].alias("b")))).alias("c"))
    pairs = pairs.select("channel", F.col("c.a").alias("a"), F.col("c.b").alias("b"))

    def run(batches):
        for pdf in batches:
            values = [kernel(np.asarray(a, float), np.asarray(b, float), n) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame({"channel": pdf["channel"], "v": values})

    out = pairs.mapInPandas(run, f"channel {dict(ts.dtypes)['channel']}, v array<double>").select("channel", F.posexplode("v").alias("window", name))
    return out.withColumn("mask", F.coalesce(F.col(name) > threshold, F.lit(False)))


def sci(ts: DataFrame, fs: float, window_s: float, threshold: float) -> DataFrame:
    """Scalp coupling index; ts is band-passed by cardiac()."""
    return two_wavelengths(ts, fs, window_s, signal.scalp_coupling, "sci", threshold)


def psp(ts: DataFrame, fs: float, window_s: float, threshold: float) -> DataFrame:
    """Peak spectral power; ts is band-passed by cardiac()."""
    return two_wavelengths(ts, fs, window_s, signal.peak_power, "psp", threshold)
