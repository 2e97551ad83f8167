"""The table-shaped parts of an optical recording file: probe, labels, stimuli, auxiliary series and data types.

The file's arrays are given as DataFrames of long rows (one per element, with its 0-based index), as a
Parquet or JSON export of such a file has them; indices inside measurement lists are 1-based.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The data type codes and labels of the public file format.
DATA_TYPES = {
    1: "CW_AMPLITUDE",
    51: "CW_FLUORESCENCE_AMPLITUDE",
    101: "FD_AC_AMPLITUDE",
    102: "FD_PHASE",
    151: "FD_FLUORESCENCE_AMPLITUDE",
    152: "FD_FLUORESCENCE_PHASE",
    201: "TDG_AMPLITUDE",
    251: "TDG_FLUORESCENCE_AMPLITUDE",
    301: "TDM_AMPLITUDE",
    351: "TDM_FLUORESCENCE_AMPLITUDE",
    401: "DCS_G2",
    410: "DCS_BFI",
    99999: "PROCESSED",
}
DATA_TYPE_LABELS = (
    "dOD", "dMean", "dVar", "dSkew", "mua", "musp", "HbO", "HbR", "HbT", "H2O", "Lipid", "BFi",
    "HRF dOD", "HRF dMean", "HRF dVar", "HRF dSkew", "HRF HbO", "HRF HbR", "HRF HbT", "HRF BFi", "RAW", "raw-DC",
)


def data_type(code: Column) -> Column:
    """The name of a data type code; null for a null or unknown one."""
    names = F.create_map(*[F.lit(x) for pair in DATA_TYPES.items() for x in pair])
    return F.try_element_at(names, code.cast("int"))


def data_type_label(label: Column) -> Column:
    """The label itself if the format knows it, else null."""
    return F.when(label.isin(*DATA_TYPE_LABELS), label)


def common_prefixes(labels: DataFrame, key: str = "index", label: str = "label") -> DataFrame:
    """(key, label): the longest common prefix of all labels of a key. Raises when the job runs if two keys share one.

    The prefix of a set of strings is that of its least and greatest one.
    """
    ends = labels.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    n = F.least(F.length("_a"), F.length("_b"))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring("_a", i, F.lit(1)) != F.substring("_b", i, F.lit(1)))
    length = F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))
    out = ends.select(key, F.substring("_a", F.lit(1), length).alias(label))
    again = out.groupBy(label).agg(F.count("*").alias("_n"))
    once = F.assert_true(F.col("_n") == 1, "labels have no unique common prefixes")
    return out.join(again, label).select(key, F.coalesce(once.cast("string"), F.col(label)).alias(label))


def labels_and_positions(positions: DataFrame, labels: DataFrame, dim: int = 3) -> DataFrame:
    """(type, index, label, x, y[, z]) of sources, detectors and landmarks.

    positions: type, index and coordinates; labels: type, index, label. Sources and detectors without
    any label are called S1, D1 and so on; labels without a position are left out; a landmark without
    a label, or an optode without one among labelled ones, raises when the job runs.
    """
    if dim not in (2, 3):
        raise ValueError(f"dim must be 2 or 3 but is {dim}")
    given = labels.groupBy("type").agg(F.count("*").alias("_n"))
    rows = positions.select("type", "index", *"xyz"[:dim]).join(labels.select("type", "index", "label"), ["type", "index"], "left").join(given, "type", "left")
    generic = F.when(F.col("_n").isNull() & F.col("type").isin("source", "detector"), F.concat(F.upper(F.substring("type", 1, 1)), (F.col("index") + 1).cast("string")))
    named = F.coalesce("label", generic)
    return rows.select("type", "index", F.coalesce(F.assert_true(named.isNotNull(), "a position has no label").cast("string"), named).alias("label"), *"xyz"[:dim])


def geometry(positions: DataFrame, labels: DataFrame, dim: int, crs: str, unit: str) -> DataFrame:
    """(label, type, crs, unit, x, y[, z]): labelled points of a probe."""
    points = labels_and_positions(positions, labels, dim)
    return points.select("label", "type", F.lit(crs).alias("crs"), F.lit(unit).alias("unit"), *"xyz"[:dim])


def channel_coords(ml: DataFrame) -> DataFrame:
    """(channel, source, detector), once each, of a measurement list with labels."""
    return ml.select(F.concat("source", "detector").alias("channel"), "source", "detector").distinct()


def time_coords(times: DataFrame, series: DataFrame, unit: str = "s") -> DataFrame:
    """(sample, time, unit): times (index, time) of a series (index, ...); raises when the job runs if their lengths differ."""
    n = series.agg(F.count_distinct("index").alias("_n")).crossJoin(times.agg(F.count("*").alias("_m")))
    fits = F.assert_true(F.col("_n") == F.col("_m"), "lengths of time and series differ")
    return times.crossJoin(n).select(F.coalesce(fits.cast("long"), F.col("index").cast("long")).alias("sample"), "time", F.lit(unit).alias("unit"))


def stim_table(stims: DataFrame, column_names: list[str] | None = None) -> DataFrame:
    """(onset, duration, value, further columns, trial_type) of rows (name, data array<double>).

    Further columns are called by column_names, which name all columns, else col3, col4 and so on; rows
    with fewer columns have nulls there.
    """
    most = max(3, stims.agg(F.coalesce(F.max(F.size("data")), F.lit(0)).alias("n")).first()["n"])
    fits = column_names is not None and len(column_names) == most
    names = ["onset", "duration", "value"] + [column_names[i] if fits else f"col{i}" for i in range(3, most)]
    return stims.select(*[F.get("data", F.lit(i)).alias(c) for i, c in enumerate(names)], F.col("name").alias("trial_type"))


def aux_series(aux: DataFrame) -> DataFrame:
    """(name, sample, time, value) of rows (name, time_offset, times, values); a null offset is none, lengths must agree."""
    fits = F.assert_true(F.size("times") == F.size("values"), "lengths of time and values differ")
    cells = aux.select("name", F.coalesce("time_offset", F.lit(0.0)).alias("_o"), F.posexplode(F.when(fits.isNull(), F.arrays_zip("times", "values"))).alias("sample", "c"))
    return cells.select("name", F.col("sample").cast("long").alias("sample"), (F.col("c.times") + F.col("_o")).alias("time"), F.col("c.values").alias("value"))


def meta_tags(tags: DataFrame) -> DataFrame:
    """One row with a map of all (name, value) tags that have a value; of a name given twice the greatest value."""
    one = tags.where(F.col("value").isNotNull()).groupBy("name").agg(F.max("value").alias("value"))
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    return one.agg(F.map_from_entries(pairs).alias("tags"))


def without_empty(frames: list[DataFrame]) -> DataFrame:
    """All frames one below the other, by name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
