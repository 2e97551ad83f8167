"""Readers and writers of the text formats: events, optodes and landmarks, markups, digitised points, meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "onset double, duration double, value double, trial_type string"
MARKUPS = "markups array<struct<coordinateUnits:string, controlPoints:array<struct<label:string, position:array<double>, orientation:array<double>>>>>"


def read_events_tsv(spark: SparkSession, path: str) -> DataFrame:
    """BIDS events; NaN and n/a become NULL. Columns are taken by their header names."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="n/a", enforceSchema=False)
    kinds = {f.split()[0]: f.split()[1] for f in EVENTS.split(", ")}
    return raw.select(*[F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in raw.columns])


def kind_of(label):
    return F.when(label.startswith("S"), "SOURCE").when(label.startswith("D"), "DETECTOR").otherwise("LANDMARK")


def read_points_tsv(spark: SparkSession, path: str) -> DataFrame:
    """label, type, x, y, z; without a type column the label's first letter decides."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = {c.split("(")[0].strip().lower(): c for c in raw.columns}
    label = F.col(f"`{names.get('label', raw.columns[0])}`")
    return raw.select(label.alias("label"), (F.col(f"`{names['type']}`") if "type" in names else kind_of(label)).alias("type"), *[F.col(f"`{names[c]}`").cast("double").alias(c) for c in "xyz"])


def write_points_tsv(points: DataFrame, path: str) -> None:
    points.select("label", "type", *[F.format_string("%f", F.col(c)).alias(c) for c in "xyz"]).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_markups_json(spark: SparkSession, path: str) -> DataFrame:
    """Landmarks of a markups file: positions times the 3x3 orientation; mixed units raise when the job runs."""
    m = spark.read.schema(MARKUPS).json(path, multiLine=True).select(F.explode("markups").alias("m"))
    p = m.select("m.coordinateUnits", F.explode("m.controlPoints").alias("p"))
    o, v = F.col("p.orientation"), F.col("p.position")
    coord = lambda i: sum((o[3 * i + j] * v[j] for j in range(3)), F.lit(0.0))
    units = p.agg(F.count_distinct("coordinateUnits").alias("n"))
    out = p.join(F.broadcast(units)).select("p.label", F.lit("LANDMARK").alias("type"), *[coord(i).alias(c) for i, c in enumerate("xyz")], F.col("coordinateUnits").alias("unit"), "n")
    return out.withColumn("x", F.coalesce(F.assert_true(F.col("n") <= 1, "mixed units").cast("double"), F.col("x"))).drop("n")


def write_markups_json(points: DataFrame, path: str) -> None:
    """One document with identity orientation in mm; landmarks are few and make one row."""
    cell = F.struct("label", F.array("x", "y", "z").alias("position"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("orientation"))
    doc = points.agg(F.array(F.struct(F.lit("Fiducial").alias("type"), F.lit("mm").alias("coordinateUnits"), F.array_sort(F.collect_list(cell)).alias("controlPoints"))).alias("markups"))
    doc.select(F.to_json(F.struct("markups")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_digpts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the form `label: x y z`."""
    parts = F.split(F.regexp_extract("value", r"^\s*([^:]+):\s*(.*\S)\s*$", 2), r"\s+")
    return spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(F.regexp_extract("value", r"^\s*([^:]+):", 1)).alias("label"), *[parts[i].cast("double").alias(c) for i, c in enumerate("xyz")]).withColumn("type", kind_of(F.upper("label")))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of an OBJ mesh, numbered from 0 in file order. One mesh file is one task's input."""
    rows = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    pick = lambda tag: F.filter(F.transform("lines", lambda s: F.split(F.trim(s), r"\s+")), lambda p: p[0] == tag)
    v = rows.select(F.posexplode(pick("v")).alias("vertex", "p")).select(F.col("vertex").cast("long").alias("vertex"), *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    f = rows.select(F.posexplode(pick("f")).alias("face", "p")).select(F.col("face").cast("long").alias("face"), *[(F.split(F.col("p")[i + 1], "/")[0].cast("long") - 1).alias(c) for i, c in enumerate("abc")])
    return v, f


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, parcel) of a JSON object of vertex lists; spaces of names become underscores."""
    table = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<int>>").alias("m"))
    cells = table.select(F.explode("m").alias("parcel", "vs")).select(F.explode("vs").alias("vertex"), F.translate("parcel", " ", "_").alias("parcel"))
    return cells.orderBy("vertex")


def read_fiducials_csv(spark: SparkSession, path: str) -> DataFrame:
    """A scanner's list (name, x, y, z without header): the first five names are the fiducials, the rest optodes."""
    raw = spark.read.csv(path, schema="label string, x double, y double, z double")
    fid = F.col("label").isin("Nz", "Iz", "Rpa", "Lpa", "Cz")
    return raw.withColumn("type", F.when(fid, "LANDMARK").otherwise(kind_of(F.col("label"))))
