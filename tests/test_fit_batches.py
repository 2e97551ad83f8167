"""Fits are taken from Arrow's buffers, a trace at a time."""

import numpy as np
import pytest

from lumenframe.operators import glm


def test_fit_makes_no_objects_of_a_batch(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(3, 9))
    ts = spark.createDataFrame([(f"C{c}", 760.0, i, i / 10, None if (c, i) == (1, 4) else float(y[c, i])) for c in range(3) for i in range(9)], "channel string, wavelength double, sample long, time double, value double")
    design = spark.createDataFrame([(i, n, float(v)) for i in range(9) for n, v in (("a", 1), ("b", i * i))], "sample long, regressor string, value double")
    out = glm.fit(ts, design)
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
    x = np.column_stack([np.ones(9), np.arange(9.0) ** 2])
    for r in out.collect():
        c = int(r.channel[1:])
        ok = np.arange(9) != 4 if c == 1 else np.ones(9, bool)
        assert r.params == pytest.approx(np.linalg.lstsq(x[ok], y[c][ok], rcond=None)[0].tolist()) and r.df_resid == ok.sum() - 2
