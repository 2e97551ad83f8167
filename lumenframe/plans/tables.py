"""Recordings made of the driver's tables, with the SQL of the same tables.

ts: one trace per user and wavelength from events, sampled at 10 Hz in order of time,
lifted by 1 as amplitudes are positive. geo: a point
per embedding. faces: a strip of triangles over the points. adot: the embedding as a sensitivity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS = 10.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    odd = F.pmod("event_id", F.lit(2))
    i = F.row_number().over(Window.partitionBy("user_id", odd).orderBy("ts", "event_id")).cast("long") - 1
    cells = e.select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("channel"), F.when(odd == 0, 760.0).otherwise(850.0).alias("wavelength"), i.alias("sample"), (F.col("value").cast("double") + 1.0).alias("value"))
    return cells.select("channel", "wavelength", "sample", (F.col("sample") / FS).alias("time"), "value")


TS = """ts AS (SELECT channel, wavelength, sample, sample / 10.0::DOUBLE AS time, value FROM (
  SELECT 'C' || user_id AS channel, CASE WHEN event_id % 2 = 0 THEN 760.0::DOUBLE ELSE 850.0::DOUBLE END AS wavelength,
         row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS sample, value::DOUBLE + 1.0::DOUBLE AS value FROM events))"""
W = "PARTITION BY channel, wavelength"
WO = "PARTITION BY channel, wavelength ORDER BY sample"


def stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine events within the first five seconds, of three types in turn."""
    return spark.range(9).select(F.col("id").alias("event_id"), (F.lit(1.03) + 0.37 * F.col("id")).alias("onset"), F.lit(0.5).alias("duration"), F.lit(1.0).alias("value"), F.concat(F.lit("T"), F.pmod("id", F.lit(3)).cast("string")).alias("trial_type"))


STIM = "stim AS (SELECT range AS event_id, 1.03::DOUBLE + 0.37::DOUBLE * range AS onset, 0.5::DOUBLE AS duration, 1.0::DOUBLE AS value, 'T' || (range % 3) AS trial_type FROM range(9))"


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("vertex"), F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


GEO = "geo AS (SELECT vec_id::BIGINT AS vertex, 'P' || vec_id AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and detector of each user's channel."""
    u = read(spark, sf_dir, "events").select("user_id").distinct()
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    return u.select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("channel"), name(F.pmod("user_id", F.lit(50))).alias("source"), name(F.pmod(F.col("user_id") * 7 + 3, F.lit(50))).alias("detector"))


CHANNELS = "channels AS (SELECT DISTINCT 'C' || user_id AS channel, 'P' || (user_id % 50) AS source, 'P' || ((user_id * 7 + 3) % 50) AS detector FROM events)"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo(spark, sf_dir).select("vertex")
    return g.select(F.col("vertex").alias("face"), F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"), (F.col("vertex") + 2).alias("c")).join(g.select((F.col("vertex") - 2).alias("face")), "face", "left_semi")


FACES = "faces AS (SELECT g.vertex AS face, g.vertex AS a, g.vertex + 1 AS b, g.vertex + 2 AS c FROM geo g WHERE g.vertex + 2 IN (SELECT vertex FROM geo))"


def adot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vertex"), F.col("label").cast("string").alias("parcel"), F.posexplode("embedding").alias("pos", "v"))
    return e.select(F.concat(F.lit("A"), F.floor(F.col("pos") / 2).cast("string")).alias("channel"), F.when(F.pmod("pos", F.lit(2)) == 0, 760.0).otherwise(850.0).alias("wavelength"), "vertex", "parcel", F.col("v").cast("double").alias("value"))


ADOT = """adot AS (SELECT 'A' || ((p - 1) // 2) AS channel, CASE WHEN (p - 1) % 2 = 0 THEN 760.0::DOUBLE ELSE 850.0::DOUBLE END AS wavelength, vertex, parcel, v::DOUBLE AS value
  FROM (SELECT vec_id::BIGINT AS vertex, label::VARCHAR AS parcel, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"""


def spectrum(spark: SparkSession) -> DataFrame:
    """A small absorption table for the queries (1/(cm M)); a user passes a published one."""
    return spark.createDataFrame([(750.0, 518.0, 1405.0), (770.0, 650.0, 1312.0), (840.0, 1022.0, 692.0), (860.0, 1095.0, 694.0)], "wavelength double, HbO double, HbR double")


COEF = """coef AS (SELECT chromo, wavelength, c * ln(10) / 10 AS coef FROM (VALUES ('HbO', 760.0::DOUBLE, 584.0::DOUBLE), ('HbR', 760.0, 1358.5), ('HbO', 850.0, 1058.5), ('HbR', 850.0, 693.0)) AS t(chromo, wavelength, c))"""
DPF = {760.0: 6.5, 850.0: 5.75}
