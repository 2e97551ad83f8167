"""Recordings in many small files have fewer tasks than files, and all their rows."""

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import files, nirs, snirf


def test_packs_keep_order_and_bounds():
    assert files.packs([], []) == []
    assert files.packs(list("abc"), [1, 1, 1]) == [["a"], ["b"], ["c"]]
    many = files.packs(list(range(1000)), [1] * 1000)
    assert sum(many, []) == list(range(1000)) and max(map(len, many)) <= 1000 // files.TASKS
    big = files.packs(list(range(200)), [files.PACK_BYTES] * 200)
    assert [len(x) for x in big] == [1] * 200


@pytest.mark.parametrize("kind", ["snirf", "nirs"])
def test_small_files_share_tasks(spark, tmp_path, kind):
    cells = spark.range(200).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("file"), F.lit(1).alias("nirs"), F.lit("amp").alias("name"), F.lit("S1D1").alias("channel"), F.lit("S1").alias("source"), F.lit("D1").alias("detector"), F.lit(760.0).alias("wavelength"), F.lit(1).alias("source_index"), F.lit(1).alias("detector_index"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("sample"))
    cells = cells.withColumns({"time": F.col("sample") / 10.0, "value": F.col("sample") + 0.5})
    points = cells.select("file", "nirs", F.explode(F.array(F.lit("source"), F.lit("detector"))).alias("type")).distinct().withColumns({"index": F.lit(1), "label": F.when(F.col("type") == "source", "S1").otherwise("D1"), "x": F.lit(1.0), "y": F.lit(2.0), "z": F.lit(3.0)})
    if kind == "snirf":
        snirf.write_snirf(str(tmp_path), cells.drop("source_index", "detector_index"), points.drop("index"))
        got = snirf.read_snirf(spark, str(tmp_path))["timeseries"]
    else:
        nirs.write_nirs(str(tmp_path), cells, cells.where("sample = 1").select("file", "sample", F.lit("T").alias("trial_type")), points)
        got = nirs.read_nirs(spark, str(tmp_path))["timeseries"]
    assert got.rdd.getNumPartitions() <= 70
    assert got.count() == 600 and got.select("file").distinct().count() == 200
    assert got.agg(F.sum("value")).first()[0] == 200 * 4.5
