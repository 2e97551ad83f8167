"""Probe tables, labels, stimuli and auxiliary series."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe.sources import probe


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_common_prefixes(spark):
    df = spark.createDataFrame([(0, "S1-760"), (0, "S1-850"), (1, "S2-760"), (1, "S2"), (2, "X")], "index int, label string")
    assert rows(probe.common_prefixes(df)) == [(0, "S1-"), (1, "S2"), (2, "X")]
    with pytest.raises(PySparkException, match="unique"):
        probe.common_prefixes(spark.createDataFrame([(0, "S1"), (0, "S2"), (1, "S3"), (1, "S4")], "index int, label string")).collect()


def test_labels_and_positions(spark):
    pos = spark.createDataFrame([("source", 0, 1.0, 2.0, 3.0), ("source", 1, 4.0, 5.0, 6.0), ("detector", 0, 0.0, 0.0, 1.0)], "type string, index int, x double, y double, z double")
    none = spark.createDataFrame([("landmark", 0, "Nz")], "type string, index int, label string")
    assert [r[2] for r in rows(probe.labels_and_positions(pos, none))] == ["D1", "S1", "S2"]
    assert probe.labels_and_positions(pos, none, 2).columns == ["type", "index", "label", "x", "y"]
    some = spark.createDataFrame([("source", 0, "A")], "type string, index int, label string")
    with pytest.raises(PySparkException, match="no label"):
        probe.labels_and_positions(pos, some).collect()
    with pytest.raises(ValueError, match="2 or 3"):
        probe.labels_and_positions(pos, none, 4)
    assert probe.geometry(pos, none, 3, "digitized", "mm").columns == ["label", "type", "crs", "unit", "x", "y", "z"]


def test_types_times_stimuli_and_aux(spark):
    df = spark.createDataFrame([(1, "HbO"), (99999, "RAW"), (5, "odd"), (None, None)], "c int, l string")
    assert [tuple(r) for r in df.select(probe.data_type(F.col("c")), probe.data_type_label(F.col("l"))).collect()] == [("CW_AMPLITUDE", "HbO"), ("PROCESSED", "RAW"), (None, None), (None, None)]
    t = spark.createDataFrame([(0, 0.0), (1, 0.5)], "index int, time double")
    assert rows(probe.time_coords(t, t)) == [(0, 0.0, "s"), (1, 0.5, "s")]
    with pytest.raises(PySparkException, match="lengths"):
        probe.time_coords(t, t.where("index = 0")).collect()
    stims = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [5.0, 6.0, 7.0])], "name string, data array<double>")
    out = probe.stim_table(stims)
    assert out.columns == ["onset", "duration", "value", "col3", "trial_type"] and out.where("trial_type = 'b'").first().col3 is None
    assert probe.stim_table(stims, ["o", "d", "v", "speed"]).columns[3] == "speed"
    assert probe.stim_table(stims.limit(0)).count() == 0
    aux = spark.createDataFrame([("acc", 1.0, [0.0, 1.0], [7.0, 8.0]), ("n", None, [0.0], [1.0])], "name string, time_offset double, times array<double>, values array<double>")
    assert rows(probe.aux_series(aux)) == [("acc", 0, 1.0, 7.0), ("acc", 1, 2.0, 8.0), ("n", 0, 0.0, 1.0)]
    with pytest.raises(PySparkException, match="lengths"):
        probe.aux_series(aux.withColumn("times", F.array(F.lit(0.0)))).collect()
    tags = spark.createDataFrame([("LengthUnit", "mm"), ("SubjectID", None)], "name string, value string")
    assert probe.meta_tags(tags).first().tags == {"LengthUnit": "mm"}
