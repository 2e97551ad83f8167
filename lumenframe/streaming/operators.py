"""Streaming forms of the causal operators: window aggregates and finite impulse response filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(stream: DataFrame, length: str, late: str, keys: list[str]) -> DataFrame:
    """Mean, deviation and signal-to-noise of each key in tumbling event-time windows; later rows are dropped.

    stream: a timestamp ts, the keys and value.
    """
    agg = stream.withWatermark("ts", late).groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return agg.select(F.col("window.start").alias("start"), *keys, "n", "mean", "std", F.try_divide("mean", "std").alias("snr"))


def join_events(samples: DataFrame, events: DataFrame, late: str, before_s: float, after_s: float) -> DataFrame:
    """Samples within a span around events of the same key, both streams with a timestamp ts and a channel."""
    s = samples.withWatermark("ts", late).alias("s")
    e = events.withWatermark("ts", late).alias("e")
    span = (F.col("s.ts") >= F.col("e.ts") - F.make_dt_interval(secs=F.lit(before_s))) & (F.col("s.ts") <= F.col("e.ts") + F.make_dt_interval(secs=F.lit(after_s)))
    return s.join(e, (F.col("s.channel") == F.col("e.channel")) & span).select(F.col("s.channel").alias("channel"), F.col("s.ts").alias("ts"), F.col("s.value").alias("value"), F.col("e.event_id").alias("epoch"))


def fir_filter(stream: DataFrame, taps: list[float], key: str = "channel") -> DataFrame:
    """y[n] = sum of taps[k] * x[n - k] per key; the state is the last len(taps) - 1 values.

    stream: key, sample, value, in order of sample within a key. The taps may be [1, -a1, -a2, ...]
    for whitening.
    """
    kind, keep = dict(stream.dtypes)[key], len(taps) - 1

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else [0.0] * keep
        rows = pd.concat(list(batches)).sort_values("sample")
        x = np.r_[past, rows["value"].to_numpy(float)]
        y = np.convolve(x, taps)[keep : keep + len(rows)] if keep else x * taps[0]
        state.update((x[len(x) - keep :].tolist() if keep else [],))
        yield pd.DataFrame({key: rows[key].to_numpy(), "sample": rows["sample"].to_numpy(), "value": y})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, sample long, value double", "past array<double>", "append", "NoTimeout")
