"""Queries over selections, measurement lists, head models and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glm, head_model, imaging, reshape
from .common import query, r
from .signals import design
from .tables import CHANNELS, GEO, TS, WO, channels, geo, read, ts

KEYS = "channel, wavelength"


def sensors(spark, d):
    return ts(spark, d).join(channels(spark, d), "channel")


@query(f"WITH {TS}, n AS (SELECT {KEYS}, time, value, row_number() OVER (PARTITION BY {KEYS} ORDER BY abs(time - 1.23), time) AS k FROM ts) SELECT {KEYS}, {r('time')}, {r('value')} FROM n WHERE k = 1")
def select_nearest(spark, d):
    return reshape.select_nearest(ts(spark, d), 1.23)


@query(f"WITH {TS} SELECT {KEYS}, sample, time, {r('value')} FROM ts WHERE regexp_matches(channel, '^C1[0-3]')")
def select_matching(spark, d):
    return reshape.select_matching(ts(spark, d), "C1[0-3]")


@query(f"WITH {CHANNELS} SELECT DISTINCT channel FROM channels WHERE source IN ('P1', 'P4') OR detector IN ('P1', 'P4')")
def channels_of_optodes(spark, d):
    return reshape.channels_of_optodes(sensors(spark, d), ["P1", "P4"])


@query(f"WITH {TS} SELECT {KEYS}, sample, time, {r('value')} FROM ts")
def stack_unstack(spark, d):
    return reshape.unstack(reshape.stack(ts(spark, d), "flat", "wavelength", "channel"), "flat")


GAPS = f"gap AS (SELECT {KEYS}, sample, time, CASE WHEN value < 20 THEN NULL ELSE value END AS value FROM ts)"


@query(f"""WITH {TS}, {GAPS}, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) OVER a AS t0, last_value(value IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) OVER b AS t1, first_value(value IGNORE NULLS) OVER b AS v1 FROM gap
  WINDOW a AS ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({WO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {KEYS}, sample, time, {r('coalesce(value, v0 + (v1 - v0) * (time - t0) / nullif(t1 - t0, 0))', 'value')} FROM k""")
def interpolate_na(spark, d):
    return reshape.interpolate_na(ts(spark, d).withColumn("value", F.when(F.col("value") >= 20, F.col("value"))))


@query(f"WITH {CHANNELS}, c AS (SELECT channel, source, detector, wavelength FROM channels, (VALUES (760.0::DOUBLE), (850.0)) AS w(wavelength)) SELECT channel, source, detector, wavelength, dense_rank() OVER (ORDER BY source)::INT AS source_index, dense_rank() OVER (ORDER BY detector)::INT AS detector_index, dense_rank() OVER (ORDER BY wavelength)::INT AS wavelength_index FROM c")
def measurement_list(spark, d):
    return reshape.measurement_list(sensors(spark, d))


@query("SELECT event_id, event_id % 5 + 1 AS source_index, event_id % 7 + 1 AS detector_index, event_id % 2 + 1 AS wavelength_index, 'S' || (event_id % 5 + 1) AS source, 'D' || (event_id % 7 + 1) AS detector, CASE WHEN event_id % 2 = 0 THEN 760.0::DOUBLE ELSE 850.0::DOUBLE END AS wavelength, 'S' || (event_id % 5 + 1) || 'D' || (event_id % 7 + 1) AS channel FROM events")
def denormalize_measurements(spark, d):
    e = read(spark, d, "events").select("event_id", *[(F.col("event_id") % n + 1).alias(f"{k}_index") for k, n in (("source", 5), ("detector", 7), ("wavelength", 2))])
    label = lambda p, n: spark.range(1, n + 1).select(F.col("id").alias("index"), F.concat(F.lit(p), F.col("id").cast("string")).alias("label"))
    wl = spark.createDataFrame([(1, 760.0), (2, 850.0)], "index long, wavelength double")
    return reshape.denormalize_measurements(e, label("S", 5), label("D", 7), wl)


@query(f"WITH {GEO}, d AS (SELECT vertex, sqrt(x*x+y*y+z*z) AS distance FROM geo), b AS (SELECT vertex, exp(-(distance/0.2)*(distance/0.2)/2) * 3 AS value FROM d) SELECT vertex, {r('value')}, 'HbO' AS chromo FROM b UNION ALL SELECT vertex, {r('value * -0.4', 'value')}, 'HbR' FROM b")
def spatial_activation(spark, d):
    dist = geo(spark, d).select("vertex", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("distance"))
    return imaging.spatial_activation(dist, 0.2, 3.0, -0.4)


@query(f"""WITH {GEO}, s AS (SELECT unnest(range(0, 11)) AS k), c AS (SELECT label AS other, k AS step, round((x + 0.5) * 20 - k * 0.0)::BIGINT AS i, round((y + 0.5) * 20 - k * 0.0)::BIGINT AS j, round((z + 0.5) * 20 - k * 0.5)::BIGINT AS l FROM geo, s)
SELECT other, step::INT AS step, (i * 21 + j) * 21 + l AS voxel FROM c WHERE least(i, j, l) >= 0 AND greatest(i, j, l) < 21""")
def inward_rays(spark, d):
    g = geo(spark, d)
    points = g.select("label", *[((F.col(c) + 0.5) * 20).alias(c) for c in "xyz"])
    normals = g.select("label", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return head_model.inward_rays(points, normals, 5.0, 0.5, 21)


@query()
def glm_confidence(spark, d):
    return glm.confidence_intervals(glm.fit(ts(spark, d), design(spark, d)))


@query()
def glm_contrast(spark, d):
    return glm.contrast(glm.fit(ts(spark, d), design(spark, d)), {"HRF T0": 1.0, "HRF T1": -1.0})


@query()
def glm_regressor_variances(spark, d):
    return glm.regressor_variances(glm.fit(ts(spark, d), design(spark, d)))
