"""Queries over motion correction, lags, views and designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decomposition, glm, motion, quality, simulation, views, windows
from .common import query, r
from .signals import CELL, KEYS, MOTION, OD, design, od, times
from .signals import motion as motion_mask
from .spatial import features
from .tables import CHANNELS, FS, GEO, TS, WO, channels, geo, stim, ts


@query()
def motion_correct_pca(spark, d):
    x = ts(spark, d)
    mask = quality.id_motion_refine(quality.id_motion(x, FS, stdev_thresh=2.0, amp_thresh=150.0), "all")[0].select("sample", "mask")
    return motion.motion_correct_pca(x, mask, 0.9)


@query()
def baseline_shifts(spark, d):
    return motion.baseline_shifts(ts(spark, d), quality.outliers_grad(ts(spark, d)), FS)


@query(f"WITH {TS}, {OD}, {MOTION} SELECT time, count(*) FILTER (WHERE mask) AS clean, count(*) FILTER (WHERE NOT mask) AS tainted FROM mo GROUP BY 1")
def clean_channels_by_time(spark, d):
    return views.channel_counts(motion_mask(spark, d))


@query(f"""WITH {TS}, f AS (SELECT range AS frame, 0.5::DOUBLE + range / 4.0::DOUBLE AS t FROM range(9)), c AS (SELECT frame, {KEYS}, value, row_number() OVER (PARTITION BY frame, {KEYS} ORDER BY abs(time - t), time) AS k FROM ts, f WHERE time BETWEEN -0.5 AND 3.5)
SELECT frame, {KEYS}, {r('value')} FROM c WHERE k = 1""")
def nearest_frames(spark, d):
    return views.nearest_frames(ts(spark, d), 0.5, 2.5, 4.0)


@query(f"WITH {TS}, v AS (SELECT {KEYS}, avg(value) AS value FROM ts GROUP BY ALL), x AS (SELECT *, least(greatest(value / max(value) OVER (), 0), 1) AS l FROM v) SELECT {KEYS}, {r('value')}, round(180 + 75 * l)::INT AS r, round(180 * (1 - l))::INT AS g, round(180 * (1 - l))::INT AS b, 255 AS a FROM x")
def metric_colours(spark, d):
    return views.colours(ts(spark, d).groupBy("channel", "wavelength").agg(F.avg("value").alias("value")))


@query(f"WITH {TS} SELECT {CELL}, {r(f'lag(value, 3) OVER ({WO})', 'value')} FROM ts")
def time_shift(spark, d):
    return windows.shift(ts(spark, d), 3)


@query(f"""WITH {TS}, e AS (SELECT {KEYS}, sample, time, value FROM ts), b AS (SELECT {KEYS}, min(sample) AS lo, max(sample) AS hi, min(time) AS t0, max(time) AS t1, arg_min(value, sample) AS f, arg_max(value, sample) AS l FROM ts GROUP BY ALL), k AS (SELECT unnest(range(1, 4)) AS k)
SELECT {KEYS}, sample, {r('time')}, {r('value')} FROM e UNION ALL SELECT {KEYS}, lo - k, {r('t0 - k * (t1 - t0) / (hi - lo)', 'time')}, {r('f', 'value')} FROM b, k UNION ALL SELECT {KEYS}, hi + k, {r('t1 + k * (t1 - t0) / (hi - lo)', 'time')}, {r('l', 'value')} FROM b, k""")
def edge_pad(spark, d):
    return windows.edge_pad(ts(spark, d), 3)


@query(f"WITH {TS} SELECT {KEYS}, sample // 8 AS window, {r('avg(value)', 'mean')} FROM ts GROUP BY {KEYS}, sample // 8")
def strided_windows(spark, d):
    return windows.strided_windows(ts(spark, d), 8).groupBy("channel", "wavelength", "window").agg(F.avg("value").alias("mean"))


MIDPOINTS = "mp AS (SELECT channel, (s.x + t.x) / 2 AS x, (s.y + t.y) / 2 AS y, (s.z + t.z) / 2 AS z, d.distance FROM dist d JOIN geo s ON s.label = d.source JOIN geo t ON t.label = d.detector)"
DIST = "dist AS (SELECT channel, source, detector, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z)) AS distance FROM channels JOIN geo s ON s.label = source JOIN geo t ON t.label = detector)"


@query(f"WITH {GEO}, {CHANNELS}, {DIST}, {MIDPOINTS} SELECT a.channel, arg_min(b.channel, ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.channel)) AS short_channel FROM mp a, mp b WHERE a.distance >= 0.2 AND b.distance < 0.2 GROUP BY 1")
def closest_short(spark, d):
    from ..operators.optics import channel_distances

    g = geo(spark, d)
    dist = channel_distances(channels(spark, d), g)
    at = lambda p: g.select(F.col("label").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    mid = dist.join(at("source"), "source").join(at("detector"), "detector").select("channel", "distance", *[((F.col(f"source{c}") + F.col(f"detector{c}")) / 2).alias(c) for c in "xyz"])
    return glm.closest_short_channel(mid.where("distance >= 0.2"), mid.where("distance < 0.2"))


@query()
def design_groups(spark, d):
    x = ts(spark, d).select("channel").distinct()
    return glm.design_groups(design(spark, d).join(F.broadcast(x))).groupBy("group").agg(F.count("*").alias("n_channels")).select("n_channels")


@query()
def temporally_embedded_cca(spark, d):
    f = features(spark, d)
    return decomposition.temporally_embedded_cca(f.where(F.col("channel").endswith("760")), f.where(F.col("channel").endswith("850")), [0, 1, 2], l2=(0.1, 0.1))[0]


@query()
def mspoc(spark, d):
    f = features(spark, d)
    y = spark.range(10).select(F.lit("y0").alias("channel"), F.col("id").alias("sample"), F.sin("id").alias("value")).unionByName(spark.range(10).select(F.lit("y1").alias("channel"), F.col("id").alias("sample"), F.cos("id").alias("value")))
    return decomposition.mspoc(f, y, 10, (0, 1))[0]


@query()
def mspoc_two(spark, d):
    """Two components: powers of the embeddings against mean price and discount of the same bins of lineitem."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.pmod("l_orderkey", F.lit(10)).alias("sample"), "l_extendedprice", "l_discount")
    means = rows.groupBy("sample").agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    return decomposition.mspoc_components(features(spark, d), means.unpivot("sample", ["price", "discount"], "channel", "value"), 10, 2, (0, 1))[0]


@query()
def random_events(spark, d):
    return simulation.random_events(spark, 600.0, 20, ["spike", "bl_shift"], ["S1", "S2"], seed=3)


@query()
def optimal_shift(spark, d):
    each = ts(spark, d).select(F.concat_ws("_", "channel", F.col("wavelength").cast("int").cast("string")).alias("component"), "sample", "value")
    lagged = windows.temporal_embedding(each.withColumn("time", F.col("sample") / FS), [0, 2, 5]).select("component", "shift", "sample", "value")
    return decomposition.shift_by_optimal(each, decomposition.optimal_shift(lagged, each))


@query()
def synthetic_events(spark, d):
    return simulation.stimulus_schedule(spark, 120.0, ["A", "B"], 2.0, 4.0, 3.0, 6.0)


@query()
def synthetic_hrf(spark, d):
    from ..functions.basis import Gamma

    s = stim(spark, d)
    pattern = ts(spark, d).groupBy("channel").agg(F.avg("value").alias("value"))
    return simulation.synthetic_hrf(pattern, glm.hrf_regressors(times(spark, d), s, Gamma(0.0, 1.0), FS), s)


@query()
def scalp_view(spark, d):
    from .spatial import landmarks

    g = landmarks(spark, d)
    name = F.when(F.col("source") == "P0", "Nz").when(F.col("source") == "P1", "LPA").when(F.col("source") == "P2", "RPA").otherwise(F.col("source"))
    metric = ts(spark, d).groupBy("channel").agg(F.avg("value").alias("value"))
    return views.scalp_view(metric, channels(spark, d).withColumn("source", name), g)


@query(f"WITH {TS}, {OD} SELECT {CELL}, {r('value')} FROM od WHERE abs(value) > 0.5")
def select_by_value(spark, d):
    return od(spark, d).where(F.abs("value") > 0.5)
