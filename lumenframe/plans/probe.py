"""Queries of the file-shaped parts: probes, labels, stimuli, auxiliary series and data types of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..operators import kernels
from ..sources import probe
from .common import query, r
from .tables import FS, TS, read, ts

LABELS = "SELECT c_nationkey AS \"index\", 'N' || c_nationkey || '-' || c_mktsegment AS label FROM customer"


@query(f"""WITH l AS ({LABELS}), e AS (SELECT "index", min(label) AS a, max(label) AS b FROM l GROUP BY 1),
p AS (SELECT "index", a, (SELECT max(k) FROM range(0, 40) t(k) WHERE k <= length(a) AND a[1:k] = b[1:k]) AS n FROM e)
SELECT "index", a[1:n] AS label FROM p""")
def source_label_prefixes(spark, d):
    c = read(spark, d, "customer")
    return probe.common_prefixes(c.select(F.col("c_nationkey").alias("index"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment").alias("label")))


@query(f"""SELECT 'S' || (vec_id + 1) AS label, 'source' AS type, 'digitized' AS crs, 'mm' AS unit, {r('embedding[1]::DOUBLE', 'x')}, {r('embedding[2]::DOUBLE', 'y')}, {r('embedding[3]::DOUBLE', 'z')} FROM embeddings
UNION ALL SELECT 'N' || vec_id, 'landmark', 'digitized', 'mm', {r('embedding[4]::DOUBLE', 'x')}, {r('embedding[5]::DOUBLE', 'y')}, {r('embedding[6]::DOUBLE', 'z')} FROM embeddings""")
def probe_geometry(spark, d):
    e = read(spark, d, "embeddings")
    at = lambda kind, k: e.select(F.lit(kind).alias("type"), F.col("vec_id").alias("index"), *[F.col("embedding")[k + i].cast("double").alias(c) for i, c in enumerate("xyz")])
    labels = e.select(F.lit("landmark").alias("type"), F.col("vec_id").alias("index"), F.concat(F.lit("N"), F.col("vec_id").cast("string")).alias("label"))
    return probe.geometry(at("source", 0).unionByName(at("landmark", 3)), labels, 3, "digitized", "mm")


@query("""SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'CW_AMPLITUDE' WHEN 1 THEN 'PROCESSED' WHEN 2 THEN 'FD_PHASE' WHEN 3 THEN 'DCS_BFI' END AS data_type,
CASE o_custkey % 3 WHEN 0 THEN 'HbO' WHEN 1 THEN 'HRF dOD' END AS label FROM orders""")
def data_types(spark, d):
    k = F.col("o_custkey") % 5
    code = F.when(k == 0, 1).when(k == 1, 99999).when(k == 2, 102).when(k == 3, 410).otherwise(7)
    name = F.when(F.col("o_custkey") % 3 == 0, "HbO").when(F.col("o_custkey") % 3 == 1, "HRF dOD").otherwise("unheard of")
    return read(spark, d, "orders").select("o_orderkey", probe.data_type(code).alias("data_type"), probe.data_type_label(name).alias("label"))


@query(f"WITH {TS} SELECT DISTINCT channel || '-' || wavelength::INT AS channel, channel || '-' AS source, (wavelength::INT)::VARCHAR AS detector FROM ts")
def channel_coords(spark, d):
    w = F.col("wavelength").cast("int").cast("string")
    return probe.channel_coords(ts(spark, d).select(F.concat("channel", F.lit("-")).alias("source"), w.alias("detector")))


@query("SELECT event_id AS sample, event_id / 10.0::DOUBLE AS time, 's' AS unit FROM events")
def time_coords(spark, d):
    e = read(spark, d, "events")
    return probe.time_coords(e.select(F.col("event_id").alias("index"), (F.col("event_id") / 10.0).alias("time")), e.select(F.col("event_id").alias("index"), "value"))


@query(f"SELECT event_id / 10.0::DOUBLE AS onset, 0.5::DOUBLE AS duration, {r('value::DOUBLE', 'value')}, user_id::DOUBLE AS col3, event_type AS trial_type FROM events")
def stim_table(spark, d):
    e = read(spark, d, "events")
    row = F.array(F.col("event_id") / 10.0, F.lit(0.5), F.col("value").cast("double"), F.col("user_id").cast("double"))
    return probe.stim_table(e.select(F.col("event_type").alias("name"), row.alias("data")))


@query(f"WITH {TS} SELECT channel AS name, sample, {r('time + 2.5', 'time')}, {r('value')} FROM ts WHERE wavelength = 760.0")
def aux_series(spark, d):
    packed = ts(spark, d).where("wavelength = 760.0").groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("sample", "time", "value"))).alias("c"))
    return probe.aux_series(packed.select(F.col("channel").alias("name"), F.lit(2.5).alias("time_offset"), F.col("c.time").alias("times"), F.col("c.value").alias("values")))


@query("SELECT string_agg(n_name || '=' || n_regionkey, ';' ORDER BY n_name) AS tags FROM nation")
def meta_tags(spark, d):
    tags = probe.meta_tags(read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value")))
    return tags.select(F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"))


@query(f"""WITH {TS}, two AS (SELECT channel, sample, min(value) FILTER (WHERE wavelength = 760.0) AS a, min(value) FILTER (WHERE wavelength = 850.0) AS b FROM ts GROUP BY ALL HAVING count(*) = 2),
z AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY sample) - 1 AS i,
             (a - avg(a) OVER c) / coalesce(nullif(stddev_pop(a) OVER c, 0), 1) AS a, (b - avg(b) OVER c) / coalesce(nullif(stddev_pop(b) OVER c, 0), 1) AS b FROM two WINDOW c AS (PARTITION BY channel)),
w AS (SELECT channel, (i + 7) // 8 AS "window", a, b FROM z UNION ALL SELECT channel, 0, {signal.BEFORE}, {signal.BEFORE} FROM (SELECT DISTINCT channel FROM z), range(7)),
s AS (SELECT channel, "window", avg(a * b) - avg(a) * avg(b) AS c, stddev_pop(a) * stddev_pop(b) AS d FROM w GROUP BY ALL HAVING count(*) = 8)
SELECT channel, "window"::INT AS "window", round(c / d + 1.3e-8, 4) + 0.0 AS sci FROM s WHERE d > 1e-9""")
def sci_windows(spark, d):
    """The index over traces as they are (no band-pass), which SQL can state; windows with a flat trace left out."""
    out = kernels.sci(ts(spark, d), FS, 0.8, 0.5).where(~F.isnan("sci") & F.col("sci").isNotNull())
    return out.select("channel", "window", (F.round(F.col("sci") + 1.3e-8, 4) + 0.0).alias("sci"))
