"""Covariances by blocks and false discovery rates of values that do not repeat, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import quality, stats

TS = "channel string, wavelength double, sample long, time double, value double"


def test_covariance_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHANNELS", 3)
    rng = np.random.default_rng(1)
    rows = [(f"C{c}", w, i, i / 10.0, float(rng.normal() * 10 + 500)) for c in range(8) for w in (760.0, 850.0) for i in range(3 + 2 * c)]
    # unknown cells, a time that occurs twice, a trace of one sample, one that is no number, times of no other channel
    rows = [r if r[2] != 1 else (*r[:4], None) for r in rows] + [("C3", 760.0, 2, 0.2, 7.0), ("one", 760.0, 0, 0.0, 5.0), ("nan", 760.0, 0, 0.0, float("nan")), ("nan", 760.0, 2, 0.2, 1.0), ("own", 760.0, 0, 99.0, 1.0), ("own", 760.0, 1, None, 1.0)]
    ts = spark.createDataFrame(rows, TS)
    got = {(r.wavelength, r.a, r.b): r.covariance for r in quality.measurement_covariance(ts).collect()}
    x, y = (ts.select("wavelength", "time", F.col("channel").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
    want = {(r.wavelength, r.a, r.b): r.c for r in x.join(y, ["wavelength", "time"]).groupBy("wavelength", "a", "b").agg(F.covar_samp("va", "vb").alias("c")).collect()}
    assert got.keys() == want.keys() and {k for k in got if got[k] is None} == {k for k in want if want[k] is None}
    assert all(got[k] == pytest.approx(want[k], nan_ok=True, rel=1e-9, abs=1e-9) for k in got if got[k] is not None)


def shuffled_rows(spark, group: str) -> int:
    """Rows that the stages of a job group wrote for other stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    ran = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in stages]
    return sum(s.shuffleWriteRecords() for s in ran)


def test_series_are_not_copied_for_each_block_that_they_meet(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHANNELS", 2)
    cells = spark.range(40 * 30).selectExpr("concat('C', id % 40) AS channel", "760.0D AS wavelength", "floor(id / 40) AS sample", "floor(id / 40) / 10 AS time", "cos(id * id) AS value")
    spark.sparkContext.setJobGroup("covariance", "")
    try:
        assert quality.measurement_covariance(cells).count() == 1600
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the cells once, besides blocks and counts
    assert 1200 <= shuffled_rows(spark, "covariance") < 2 * 1200


def test_covariance_of_slabs_unknown_channels_and_no_spectral_label(spark, monkeypatch):
    rows = [(None if c == 5 else f"C{c}", i, i / 10.0, float((7 * c * i * i) % 11 + 100 * c)) for c in range(6) for i in range(40 - c)] + [("inf", 3, 0.3, float("inf")), ("inf", 4, 0.4, 1.0), ("inf", 50, 5.0, 2.0), ("late", 50, 5.0, 1.0), ("late", 51, 5.1, 4.0), ("inf", 51, 5.1, 3.0)]
    ts = spark.createDataFrame(rows, "channel string, sample long, time double, value double")
    x, y = (ts.select("time", F.col("channel").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
    want = {(r.a, r.b): r.c for r in x.join(y, "time").groupBy("a", "b").agg(F.covar_samp("va", "vb").alias("c")).collect()}
    whole = quality._pair_covariances
    for batch, slab in ((1 << 16, 4_000_000), (3, 20)):
        monkeypatch.setattr(quality, "BATCH_PAIRS", batch)
        monkeypatch.setattr(quality, "_pair_covariances", lambda dims, slab=slab: whole(dims, slab))
        found = quality.measurement_covariance(ts).collect()
        got = {(r.a, r.b): r.covariance for r in found}
        assert len(found) == len(got) and got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], nan_ok=True, rel=1e-9, abs=1e-9) for k in got if want[k] is not None)
    assert quality.measurement_covariance(ts.where("value < 0")).count() == 0


def test_rates_of_values_that_are_not_the_same_when_summed_again(spark):
    noisy = F.udf(lambda i: i / 100 + random.random() * 1e-12, "double").asNondeterministic()
    got = stats.benjamini_hochberg(spark.range(1, 50).withColumn("p", noisy("id"))).collect()
    assert len(got) == 49 and all(r.q == pytest.approx(0.49) for r in got)
