"""False discovery rate, robust spread, quantiles and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import spectral, trace_keys
from ..core.scratch import stored


#: Ranges of p that are ranked in tasks of their own.
P_RANGES = 64


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """df with q: p times n over rank, made monotone from the right and clipped at 1. by: families of tests.

    Equal p share a q; a null p has none and does not count. Distinct p are ranked within ranges of p,
    whose counts and least values (at most P_RANGES a family) make the ranks and minima whole. df is stored first: its q
    is joined on p, and a p that is summed again over tasks may have another last bit. So are the distinct p and their ranks.
    """
    by, df = by or [], stored(df)
    seen = stored(df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n")))
    cuts = sorted(set(seen.approxQuantile(p, [i / P_RANGES for i in range(1, P_RANGES)], 0.5 / P_RANGES)))
    part = seen.withColumn("_r", sum((F.when(F.col(p) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    families, inner = Window.partitionBy(*by), Window.partitionBy(*by, "_r").orderBy(p)
    ranges = part.groupBy(*by, "_r").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(families.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*by, "_r", before.alias("_before"), F.sum("_m").over(families).alias("_all"))
    both = _beside(part, ranges, [*by, "_r"])
    rank = F.col("_before") + F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    raw = stored(both.withColumn("_q", F.col(p) * F.col("_all") / rank))
    least = raw.groupBy(*by, "_r").agg(F.min("_q").alias("_l"))
    least = least.select(*by, "_r", F.min("_l").over(families.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    q = F.least(F.min("_q").over(inner.rowsBetween(0, Window.unboundedFollowing)), "_after", F.lit(1.0))
    own = _beside(raw, least, [*by, "_r"]).select(*by, p, q.alias("q"))
    return _beside(df, own, [*by, p]).select(*df.columns, "q")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, of which nulls match nulls too."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(other, cond, "left").drop(*[f"_of_{k}" for k in keys])


def mad(ts: DataFrame) -> DataFrame:
    """Median absolute deviation per trace."""
    keys = trace_keys(ts)
    centre = ts.groupBy(*keys).agg(F.percentile("value", 0.5).alias("_m"))
    return ts.join(centre, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("value") - F.col("_m")), 0.5).alias("mad"))


def quantiles(ts: DataFrame, q: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    keys = trace_keys(ts)
    return ts.groupBy(*keys).agg(*[F.percentile("value", x).alias(f"q{round(100 * x)}") for x in q])


def norm(df: DataFrame, dim: str) -> DataFrame:
    """Euclidean norm along one dimension."""
    keys = [c for c in df.columns if c not in (dim, "value")]
    return df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))


def global_component(ts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """ts less its regression on the weighted mean over channels, per channel and spectral label."""
    dims = spectral(ts)
    x = ts if weights is None else ts.join(weights, [c for c in weights.columns if c != "weight"])
    wt = F.lit(1.0) if weights is None else F.col("weight")
    g = x.groupBy(*dims, "time").agg((F.sum(wt * F.col("value")) / F.sum(wt)).alias("_g"))
    both = ts.join(g, [*dims, "time"])
    own = Window.partitionBy("channel", *dims)
    beta = F.try_divide(F.sum(F.col("value") * F.col("_g")).over(own), F.sum(F.col("_g") * F.col("_g")).over(own))
    return both.withColumn("value", F.col("value") - beta * F.col("_g")).select(*ts.columns)


def binned(ts: DataFrame, n: int) -> DataFrame:
    """Variance and mean in n equal time bins of each trace."""
    keys = trace_keys(ts)
    span = ts.groupBy(*keys).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    at = F.least(F.floor((F.col("time") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * n), F.lit(n - 1))
    return ts.join(span, keys).withColumn("bin", F.coalesce(at, F.lit(0)).cast("long")).groupBy(*keys, "bin").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
