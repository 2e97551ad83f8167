"""Queries that write recordings of the driver's tables to binary containers and read them back."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..core.scratch import scratch_dir
from ..operators import geometry, surfaces
from ..sources import nifti, nirs, snirf
from .common import query, r
from .tables import TS, read, ts

FILE = "'r' || (user_id // 8)"
SERIES = f"""{TS}, se AS (SELECT 'r' || (u // 8) AS file, 'S' || u || 'D' || (u % 5) AS channel, 'S' || u AS source, 'D' || (u % 5) AS detector, wavelength, sample, time, value
  FROM (SELECT *, channel[2:]::BIGINT AS u FROM ts))"""


def file_of(user):
    return F.concat(F.lit("r"), F.floor(user / 8).cast("string"))


def series(spark, d):
    u = F.substring("channel", 2, 20).cast("long")
    name = lambda k, n: F.concat(F.lit(k), n.cast("string"))
    cells = ts(spark, d).withColumns({"file": file_of(u), "nirs": F.lit(1), "name": F.lit("amp"), "source": name("S", u), "detector": name("D", u % 5), "unit": F.lit("V")})
    return cells.withColumn("channel", F.concat("source", "detector"))


def recordings(spark, d):
    """The tables of SNIRF files of all traces, points, stimuli and auxiliary series, eight users a file."""
    e = read(spark, d, "events").withColumns({"file": file_of(F.col("user_id")), "nirs": F.lit(1)})
    stim = e.select("file", "nirs", F.col("event_type").alias("trial_type"), (F.col("event_id") / 10.0).alias("onset"), F.lit(0.5).alias("duration"), F.col("value").cast("double").alias("value"))
    aux = e.select("file", "nirs", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.pmod("event_id", F.lit(2)).cast("int").alias("aux_channel"), "event_id", F.col("value").cast("double").alias("value"))
    aux = aux.withColumn("sample", F.floor(F.col("event_id") / 2)).withColumns({"time": F.col("sample") / 5.0, "unit": F.lit("mm"), "time_offset": F.lit(2.5)})
    s = series(spark, d)
    optodes = s.select("file", "nirs", F.explode(F.array(*[F.struct(F.col(k).alias("label"), F.lit(k).alias("type")) for k in ("source", "detector")])).alias("p")).distinct()
    number = F.regexp_replace("p.label", "[SD]", "").cast("double")
    points = optodes.select("file", "nirs", "p.label", "p.type", number.alias("x"), (number / 4).alias("y"), F.when(F.col("p.type") == "source", 1.0).otherwise(-1.0).alias("z"))
    tags = e.groupBy("file", "nirs").agg(F.count("*").cast("string").alias("value")).withColumn("name", F.lit("MeasurementCount"))
    path = scratch_dir(spark)
    snirf.write_snirf(path, s, points, stim, aux.drop("event_id"), tags.unionByName(tags.select("file", "nirs", F.lit("LengthUnit").alias("name"), F.lit("mm").alias("value"))))
    name = F.regexp_extract("file", r"([^/]+)\.snirf$", 1)
    return {t: df.withColumn("file", name) for t, df in snirf.read_snirf(spark, path).items()}


@query(f"WITH {SERIES} SELECT file, channel, source, detector, wavelength, sample, {r('time')}, {r('value')}, 'V' AS unit FROM se")
def snirf_timeseries(spark, d):
    """Cells that no trace has are NaN in a file's matrix."""
    cells = recordings(spark, d)["timeseries"].where(~F.isnan("value"))
    return cells.select("file", "channel", "source", "detector", "wavelength", "sample", "time", "value", "unit")


@query(f"""WITH {SERIES}, c AS (SELECT DISTINCT file, channel, source, detector, wavelength FROM se)
SELECT file, channel, wavelength, (row_number() OVER (PARTITION BY file ORDER BY channel, source, detector, wavelength))::INTEGER AS "column",
  (SELECT count(DISTINCT o.source) FROM c o WHERE o.file = c.file AND o.source <= c.source)::INTEGER AS source_index, (SELECT count(DISTINCT o.detector) FROM c o WHERE o.file = c.file AND o.detector <= c.detector)::INTEGER AS detector_index,
  (SELECT count(DISTINCT o.wavelength) FROM c o WHERE o.file = c.file AND o.wavelength <= c.wavelength)::INTEGER AS wavelength_index, 1 AS data_type, 'amp' AS name FROM c""")
def snirf_measurements(spark, d):
    m = recordings(spark, d)["measurements"]
    return m.select("file", "channel", "wavelength", "column", F.col("sourceIndex").alias("source_index"), F.col("detectorIndex").alias("detector_index"), F.col("wavelengthIndex").alias("wavelength_index"), F.col("dataType").alias("data_type"), "name")


@query(f"WITH {SERIES}, p AS (SELECT DISTINCT file, unnest([source, detector]) AS label FROM se) SELECT file, 3 AS dim, label, CASE label[1] WHEN 'S' THEN 'source' ELSE 'detector' END AS type, {r('label[2:]::DOUBLE', 'x')}, {r('label[2:]::DOUBLE / 4', 'y')}, CASE label[1] WHEN 'S' THEN 1.0::DOUBLE ELSE -1.0 END AS z, 'mm' AS unit FROM p")
def snirf_geometry(spark, d):
    return recordings(spark, d)["geometry"].select("file", "dim", "label", "type", "x", "y", "z", "unit")


@query(f"SELECT {FILE} AS file, event_type AS trial_type, {r('event_id / 10.0::DOUBLE', 'onset')}, 0.5::DOUBLE AS duration, {r('value::DOUBLE', 'value')} FROM events")
def snirf_stim(spark, d):
    return recordings(spark, d)["stim"].select("file", "trial_type", "onset", "duration", "value")


@query(f"SELECT {FILE} AS file, 'u' || user_id AS name, (event_id % 2)::INTEGER AS aux_channel, {r('(event_id // 2) / 5.0::DOUBLE', 'time')}, {r('value::DOUBLE', 'value')}, 'mm' AS unit, 2.5::DOUBLE AS time_offset FROM events")
def snirf_aux(spark, d):
    a = recordings(spark, d)["aux"].where(~F.isnan("value"))
    return a.select("file", "name", "aux_channel", "time", "value", "unit", "time_offset")


@query(f"SELECT {FILE} AS file, 'MeasurementCount' AS name, count(*)::VARCHAR AS value FROM events GROUP BY 1 UNION ALL SELECT DISTINCT {FILE}, 'LengthUnit', 'mm' FROM events")
def snirf_tags(spark, d):
    return recordings(spark, d)["tags"].select("file", "name", "value")


AFFINE = np.array([[2.0, 0, 0, -20], [0, 0, 1.5, 4], [0, -1.0, 0, 30], [0, 0, 0, 1]])
SHAPE = (40, 30, 50)
CELLS = "SELECT event_type AS seg_type, user_id % 40 AS i, event_id % 30 AS j, (event_id // 30) % 50 AS k FROM events"


def volumes(spark, d, compressed: bool = False):
    """Where NIfTI masks of events lie: one for each event type, over user and event numbers."""
    e = read(spark, d, "events")
    cells = e.select(F.col("event_type").alias("file"), F.pmod("user_id", F.lit(40)).alias("i"), F.pmod("event_id", F.lit(30)).alias("j"), F.pmod(F.floor(F.col("event_id") / 30), F.lit(50)).alias("k"), F.lit(1.0).alias("value"))
    path = scratch_dir(spark)
    nifti.write_nifti(path, cells.distinct(), SHAPE, AFFINE, "u1", "aligned", compressed)
    spark.dataSource.register(nifti.NiftiSource)
    return path


def tissue():
    return F.regexp_extract("file", r"([^/]+)\.nii(\.gz)?$", 1).alias("seg_type")


@query(f"SELECT DISTINCT seg_type, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, 1.0::DOUBLE AS value FROM ({CELLS})")
def nifti_voxels(spark, d):
    return spark.read.format("nifti").load(volumes(spark, d)).select(tissue(), "i", "j", "k", "value")


@query(f"SELECT DISTINCT seg_type, 40 AS ni, 30 AS nj, 50 AS nk, 'uint8' AS datatype, 'aligned' AS space, '2.0,0.0,0.0,-20.0,0.0,0.0,1.5,4.0,0.0,-1.0,0.0,30.0,0.0,0.0,0.0,1.0' AS affine FROM ({CELLS})")
def nifti_headers(spark, d):
    h = spark.read.format("nifti").option("table", "header").load(volumes(spark, d, True))
    return h.select(tissue(), "ni", "nj", "nk", "datatype", "space", F.array_join(F.col("affine").cast("array<string>"), ",").alias("affine"))


@query(f"SELECT DISTINCT seg_type, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, {r('2.0 * i - 20', 'x')}, {r('1.5 * k + 4', 'y')}, {r('30.0 - j', 'z')} FROM ({CELLS})")
def cell_coordinates(spark, d):
    """World coordinates of the voxels of compressed volumes, by the affine in their headers."""
    path = volumes(spark, d, True)
    h = spark.read.format("nifti").option("table", "header").load(path).first()
    cells = spark.read.format("nifti").load(path).select(tissue(), "i", "j", "k")
    return geometry.cell_coordinates(cells, np.reshape(h["affine"], (4, 4))).select("seg_type", "i", "j", "k", "x", "y", "z")


def nirs_tables(spark, d):
    """The tables of .nirs files of all traces and events, eight users a file."""
    u = F.substring("channel", 2, 20).cast("long")
    s = ts(spark, d).select(file_of(u).alias("file"), (u % 8 + 1).cast("int").alias("source_index"), (u % 3 + 1).cast("int").alias("detector_index"), "wavelength", "sample", "time", "value", u.alias("u"))
    events = s.where("sample % 7 = 0 AND wavelength = 760").select("file", "sample", F.concat(F.lit("T"), (F.col("u") % 3).cast("string")).alias("trial_type")).distinct()
    index = F.explode(F.sequence(F.lit(1), F.when(F.col("type") == "source", 8).otherwise(3)))
    points = s.select("file").distinct().select("file", F.explode(F.array(F.lit("source"), F.lit("detector"))).alias("type")).select("file", "type", index.alias("index"))
    points = points.withColumns({"x": F.col("index") * 1.5, "y": F.length("type") / 2, "z": F.lit(0.25)})
    path = scratch_dir(spark)
    nirs.write_nirs(path, s.drop("u"), events, points)
    name = F.regexp_extract("file", r"([^/]+)\.nirs$", 1)
    return {t: df.withColumn("file", name) for t, df in nirs.read_nirs(spark, path).items()}


NIRS = f"""{TS}, ns AS (SELECT 'r' || (u // 8) AS file, 'S' || (u % 8 + 1) AS source, 'D' || (u % 3 + 1) AS detector, u % 8 AS si, u % 3 AS di, u, wavelength, sample, time, value FROM (SELECT *, channel[2:]::BIGINT AS u FROM ts))"""


@query(f"WITH {NIRS} SELECT file, source || detector AS channel, source, detector, wavelength, sample, {r('time')}, {r('value')} FROM ns")
def nirs_timeseries(spark, d):
    return nirs_tables(spark, d)["timeseries"].where(~F.isnan("value"))


@query(f"WITH {NIRS} SELECT DISTINCT file, si::INTEGER AS \"sourceIndex\", di::INTEGER AS \"detectorIndex\", (wavelength > 800)::INTEGER AS \"wavelengthIndex\", wavelength, source || detector AS channel FROM ns")
def nirs_measurements(spark, d):
    return nirs_tables(spark, d)["measurements"].select("file", "sourceIndex", "detectorIndex", "wavelengthIndex", "wavelength", "channel")


@query(f"WITH {NIRS} SELECT DISTINCT file, {r('time', 'onset')}, 0.0::DOUBLE AS duration, 1.0::DOUBLE AS value, 'T' || (u % 3) AS trial_type FROM ns WHERE sample % 7 = 0 AND wavelength = 760")
def nirs_stim(spark, d):
    return nirs_tables(spark, d)["stim"]


@query(f"WITH {NIRS}, f AS (SELECT DISTINCT file FROM ns) SELECT file, 'S' || i AS label, 'source' AS type, i * 1.5::DOUBLE AS x, 3.0::DOUBLE AS y, 0.25::DOUBLE AS z, 'mm' AS unit FROM f, range(1, 9) t(i) UNION ALL SELECT file, 'D' || i, 'detector', i * 1.5, 4.0, 0.25, 'mm' FROM f, range(1, 4) t(i)")
def nirs_geometry(spark, d):
    return nirs_tables(spark, d)["geometry"].select("file", "label", "type", "x", "y", "z", "unit")


DENSITY = "de AS (SELECT user_id % 12 AS i, event_id % 9 AS j, (event_id // 9) % 7 AS k, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"


def density(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.pmod("user_id", F.lit(12)).alias("i"), F.pmod("event_id", F.lit(9)).alias("j"), F.pmod(F.floor(F.col("event_id") / 9), F.lit(7)).alias("k")).agg(F.count("*").cast("double").alias("value"))


@query(f"""WITH {DENSITY}, g AS (SELECT i, j, k FROM range(-1, 13) a(i), range(-1, 10) b(j), range(-1, 8) c(k)), v AS (SELECT i, j, k, coalesce(value, 0) AS v FROM g LEFT JOIN de USING (i, j, k)),
s AS (SELECT (SELECT avg(value) FROM de) AS level), n AS (SELECT c % 2 AS di, (c // 2) % 2 AS dj, c // 4 AS dk FROM range(1, 8) t(c)),
x AS (SELECT a.i, a.j, a.k, di, dj, dk, a.v AS p, b.v AS q, level FROM v a, n, s JOIN v b ON b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk WHERE (a.v >= level) <> (b.v >= level))
SELECT {r('i + di * (level - p) / (q - p)', 'x')}, {r('j + dj * (level - p) / (q - p)', 'y')}, {r('k + dk * (level - p) / (q - p)', 'z')} FROM x""")
def isosurface_vertices(spark, d):
    """The vertices of the surface at the mean count of events over a small volume."""
    v = density(spark, d)
    return surfaces.isosurface(v, v.agg(F.avg("value")).first()[0])[1].select("x", "y", "z")
