"""General linear model: regressors, solvers on Spark, and result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import spectral
from ..functions.linear_models import recursive, solve_many, student_quantile, student_two_sided
from .geometry import nearest


def drift_regressors(times: DataFrame, order: int) -> DataFrame:
    """(sample, regressor, value): ((i + 1) / n)^k for k up to order. times: one column sample, from 0."""
    n = times.agg(F.count("*").alias("n"))
    rows = times.join(F.broadcast(n)).select("sample", "n", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    return rows.select("sample", F.concat(F.lit("Drift "), F.col("k").cast("string")).alias("regressor"), F.pow((F.col("sample") + 1) / F.col("n"), F.col("k")).alias("value"))


def stim_array(times: DataFrame, stim: DataFrame, bucket: float = 10.0) -> DataFrame:
    """(sample, trial_type, value): the value of the latest event that covers a sample, else 0.

    An event starts at the first sample not before its onset and lasts at least one sample.
    times: sample, time. Samples and events meet by buckets of so many seconds.
    """
    number = lambda c: F.floor(F.col(c) / bucket).cast("long")
    at = times.select("sample", "time", number("time").alias("_b"))
    e = stim.select("event_id", "trial_type", F.col("value").alias("v"), "onset", "duration", number("onset").alias("_b"))
    same = at.join(e, "_b").where(F.col("time") >= F.col("onset")).groupBy("event_id").agg(F.min("sample").alias("s0"))
    # an event after its bucket's last sample starts at the first sample of the next bucket that has any
    firsts = at.groupBy(F.col("_b").alias("_next")).agg(F.min("sample").alias("s0"))
    late = e.join(same, "event_id", "left_anti").join(firsts, F.col("_next") > F.col("_b")).groupBy("event_id").agg(F.min("s0").alias("s0"))
    span = e.join(same.unionByName(late), "event_id")
    first = span.select("event_id", "trial_type", "v", F.col("s0").alias("sample")).join(times.select("sample"), "sample")
    end = F.greatest(F.floor((F.col("onset") + F.col("duration")) / bucket).cast("long"), F.col("_b"))
    wide = span.withColumn("_b", F.explode(F.sequence("_b", end)))
    later = at.join(wide, "_b").where((F.col("sample") > F.col("s0")) & (F.col("time") < F.col("onset") + F.col("duration")))
    hit = first.select("sample", "trial_type", "event_id", "v").unionByName(later.select("sample", "trial_type", "event_id", "v"))
    on = hit.groupBy("sample", "trial_type").agg(F.max_by("v", "event_id").alias("value"))
    return times.select("sample").join(stim.select("trial_type").distinct()).join(on, ["sample", "trial_type"], "left").select("sample", "trial_type", F.coalesce("value", F.lit(0.0)).alias("value"))


def hrf_regressors(times: DataFrame, stim: DataFrame, basis, fs: float) -> DataFrame:
    """(sample, regressor, value): events convolved with each component, scaled to a maximum of 1.

    The convolution is an equi-join of event samples with the basis's few offsets.
    """
    t, parts = basis(fs)
    shift = int(round(t[0] * fs))
    many = len(parts) > 1
    taps = times.sparkSession.createDataFrame([(name, int(i) + shift, float(v)) for name, vs in parts.items() for i, v in enumerate(vs) if v], "component string, lag int, tap double")
    on = stim_array(times, stim).where("value <> 0")
    name = F.concat(F.lit("HRF "), F.col("trial_type"), F.concat(F.lit(" "), F.col("component")) if many else F.lit(""))
    spread = on.join(F.broadcast(taps)).groupBy((F.col("sample") + F.col("lag")).alias("sample"), name.alias("regressor")).agg(F.sum(F.col("value") * F.col("tap")).alias("v"))
    full = times.select("sample").join(spread.select("regressor").distinct()).join(spread, ["sample", "regressor"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    top = F.max("v").over(Window.partitionBy("regressor"))
    return full.select("sample", "regressor", F.when(top == 0, F.col("v")).otherwise(F.col("v") / top).alias("value"))


def join_designs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both designs' regressors; a name in both raises ValueError."""
    twice = a.select("regressor").distinct().intersect(b.select("regressor").distinct()).limit(1).collect()
    if twice:
        raise ValueError(f"regressor {twice[0][0]!r} is in both designs")
    return a.unionByName(b, allowMissingColumns=True)


def average_short_channels(ts_short: DataFrame) -> DataFrame:
    """Mean over channels by time and spectral label."""
    return ts_short.groupBy(*spectral(ts_short), "sample").agg(F.avg("value").alias("value")).withColumn("regressor", F.lit("short"))


def closest_short_channel(long: DataFrame, short: DataFrame) -> DataFrame:
    """(channel, short_channel) by distance of midpoints (channel, x, y, z); ties go to the smaller name."""
    found = nearest(long, short.withColumnRenamed("channel", "short_channel"), "channel", "short_channel")
    return found.select("channel", "short_channel")


def max_corr_short_channel(ts_long: DataFrame, ts_short: DataFrame) -> DataFrame:
    """(channel, short_channel, corr): the short channel of largest correlation over any spectral label."""
    dims = [*spectral(ts_long), "sample"]
    s = ts_short.select(*dims, F.col("channel").alias("short_channel"), F.col("value").alias("s"))
    c = ts_long.join(s, dims).groupBy("channel", "short_channel", *spectral(ts_long)).agg(F.corr("value", "s").alias("corr"))
    best = c.groupBy("channel", "short_channel").agg(F.max("corr").alias("corr"))
    return best.groupBy("channel").agg(F.max_by(F.struct("short_channel", "corr"), F.struct("corr", "short_channel")).alias("m")).select("channel", "m.short_channel", "m.corr")


RESULT = "regressors array<string>, params array<double>, bse array<double>, cov array<double>, df_resid double, sigma2 double"


def packed(ts: DataFrame, design: DataFrame) -> DataFrame:
    """(channel, spectral label, y, x, regressors, samples): each trace with its rows of the design, in order of the sample."""
    keys = ["channel", *spectral(ts)]
    shared = [k for k in keys if k in design.columns]
    row = design.groupBy("sample", *shared).agg(F.array_sort(F.collect_list(F.struct("regressor", F.col("value").alias("x")))).alias("xs"))
    both = ts.select(*keys, "sample", "value").join(row, ["sample", *shared])
    cells = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "value", "xs"))).alias("c"))
    return cells.select(*keys, F.col("c.value").alias("y"), F.transform("c", lambda c: c["xs"]["x"]).alias("x"), F.col("c")[0]["xs"]["regressor"].alias("regressors"), F.col("c.sample").alias("samples"))


def fit(ts: DataFrame, design: DataFrame, noise: str = "ols", ar_order: int = 30) -> DataFrame:
    """One row per channel and spectral label: regressors, params, bse, cov, df_resid, sigma2.

    noise: ols, wls (equal weights), rls (recursive), gls (correlation falling with the distance), glsar
    (autoregression of ar_order) or ar_irls (robust, autoregression of up to ar_order); see functions.linear_models.
    design: (sample, regressor, value), with channel or the spectral label where regressors differ.
    Each trace is one group, so a task holds one trace and its regressors.
    """
    keys, traces = ["channel", *spectral(ts)], packed(ts, design).drop("samples")
    kinds = dict(ts.dtypes)

    def run(batches):
        for batch in batches:
            ys, xs = [], []
            for y, x in zip(batch.column("y"), batch.column("x"), strict=True):
                # straight from the batch's buffers, a trace at a time
                y, x = y.values.to_numpy(zero_copy_only=False), x.values
                ys.append(y.astype(float))
                xs.append(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float))
            rows = [(b, np.sqrt(np.maximum(np.diag(cov), 0)), cov.reshape(-1), float(df), float(s2)) for b, cov, df, s2 in solve_many(ys, xs, noise, ar_order)]
            kept = batch.select([*keys, "regressors"])
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists, *[pa.array([r[i] for r in rows], pa.float64()) for i in (3, 4)]], names=[*kept.schema.names, "params", "bse", "cov", "df_resid", "sigma2"])

    return traces.mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + RESULT)


def recursive_coefficients(ts: DataFrame, design: DataFrame) -> DataFrame:
    """(channel, spectral label, sample, regressor, param, residual): the parameters after each sample, and its recursive residual.

    Samples that do not determine all parameters yet are left out; the first that do have a null residual.
    """
    keys, kinds = ["channel", *spectral(ts)], dict(ts.dtypes)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y, x = np.asarray(row.y, float), np.vstack([np.asarray(r, float) for r in row.x])
                ok = np.isfinite(y)
                _, paths, residuals = recursive(y[ok], x[ok])
                known = np.isfinite(paths).all(1)
                n, k = int(known.sum()), x.shape[1]
                e = residuals[known]
                out = {c: [getattr(row, c)] * (n * k) for c in keys}
                out |= {"sample": np.repeat(np.asarray(row.samples)[ok][known], k), "regressor": list(row.regressors) * n, "param": paths[known].reshape(-1), "residual": np.repeat(np.where(np.isnan(e), None, e), k)}
                yield pd.DataFrame(out)

    return packed(ts, design).mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "sample long, regressor string, param double, residual double")


def fit_line(ts: DataFrame) -> DataFrame:
    """Ordinary least squares on a constant and (sample + 1) / n, by aggregates alone."""
    keys = ["channel", *spectral(ts)]
    x = ts.withColumn("_x", (F.col("sample") + 1) / F.count("*").over(Window.partitionBy(*keys)))
    return x.groupBy(*keys).agg(F.regr_intercept("value", "_x").alias("intercept"), F.regr_slope("value", "_x").alias("slope"))


def coefficients(results: DataFrame) -> DataFrame:
    """(keys, regressor, param, bse, t, p): p by Student's distribution."""
    keys = [c for c in results.columns if c not in ("regressors", "params", "bse", "cov", "df_resid", "sigma2")]
    rows = results.select(*keys, "df_resid", F.explode(F.arrays_zip(F.col("regressors").alias("regressor"), F.col("params").alias("param"), F.col("bse").alias("se"))).alias("c"))
    flat = rows.select(*keys, "df_resid", "c.regressor", "c.param", F.col("c.se").alias("bse")).withColumn("t", F.try_divide("param", "bse"))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        p = student_two_sided(t.to_numpy(float), df.to_numpy(float))
        return pd.Series(np.where(np.isnan(p), None, p), dtype=object)

    return flat.withColumn("p", p_value("t", "df_resid")).drop("df_resid")


def predict(design: DataFrame, params: DataFrame) -> DataFrame:
    """(keys, sample, value): sum over regressors of design times param. params: keys, regressor, param."""
    keys = [c for c in params.columns if c not in ("regressor", "param")]
    shared = [k for k in keys if k in design.columns]
    return design.join(params, ["regressor", *shared]).groupBy(*keys, "sample").agg(F.sum(F.col("value") * F.col("param")).alias("value"))


def design_groups(design: DataFrame) -> DataFrame:
    """(channel, group): channels with the same regressors share a group number's hash."""
    cells = design.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("regressor", "sample", "value"))).alias("c"))
    return cells.select("channel", F.xxhash64("c").alias("group"))


def confidence_intervals(results: DataFrame, level: float = 0.95) -> DataFrame:
    """(keys, regressor, low, high)."""
    keys = [c for c in results.columns if c not in ("regressors", "params", "bse", "cov", "df_resid", "sigma2")]

    @F.pandas_udf("double")
    def width(df: pd.Series) -> pd.Series:
        values, at = np.unique(df.to_numpy(float), return_inverse=True)
        return pd.Series(student_quantile(level, values)[at])

    rows = results.select(*keys, width("df_resid").alias("_q"), F.explode(F.arrays_zip(F.col("regressors").alias("regressor"), F.col("params").alias("param"), F.col("bse").alias("se"))).alias("c"))
    return rows.select(*keys, "c.regressor", (F.col("c.param") - F.col("_q") * F.col("c.se")).alias("low"), (F.col("c.param") + F.col("_q") * F.col("c.se")).alias("high"))


def contrast(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(keys, effect, sd, t, p) of a weighted sum of parameters."""
    keys = [c for c in results.columns if c not in ("regressors", "params", "bse", "cov", "df_resid", "sigma2")]
    kinds = dict(results.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for names, b, cov, df in zip(pdf["regressors"], pdf["params"], pdf["cov"], pdf["df_resid"], strict=True):
                c = np.array([weights.get(n, 0.0) for n in names])
                effect, sd = float(c @ np.asarray(b)), math.sqrt(max(float(c @ np.asarray(cov).reshape(len(c), -1) @ c), 0.0))
                rows.append((effect, sd, effect / sd if sd else math.nan, df))
            effect, sd, t, df = np.array(rows, float).reshape(-1, 4).T
            yield pdf[keys].assign(effect=effect, sd=sd, t=t, p=student_two_sided(t, df))

    return results.mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "effect double, sd double, t double, p double")


def regressor_variances(results: DataFrame) -> DataFrame:
    """(keys, regressor, variance): the diagonal of the covariance."""
    keys = [c for c in results.columns if c not in ("regressors", "params", "bse", "cov", "df_resid", "sigma2")]
    n = F.size("regressors")
    return results.select(*keys, F.posexplode("regressors").alias("_i", "regressor"), n.alias("_n"), "cov").select(*keys, "regressor", F.get("cov", F.col("_i") * (F.col("_n") + 1)).alias("variance"))
