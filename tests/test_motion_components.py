"""Components of artefact samples where channels are more than samples."""

import numpy as np
import pytest

from lumenframe.operators import decomposition, motion


@pytest.mark.parametrize(("channels", "share"), [(40, 0.8), (40, 3), (4, 0.8)])
def test_components_of_more_channels_than_a_gram_matrix_may_have(spark, monkeypatch, channels, share):
    monkeypatch.setattr(decomposition, "MAX_CHANNELS", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(channels, 12)) + 5 * rng.normal(size=(channels, 1)) * rng.normal(size=12)
    ts = spark.createDataFrame([(f"C{c:02}", 760.0, i, i / 10, float(x[c, i])) for c in range(channels) for i in range(12)], "channel string, wavelength double, sample long, time double, value double")
    mask = spark.createDataFrame([(i, not 3 <= i < 11) for i in range(12)], "sample long, mask boolean")
    got = {(r.channel, r.sample): r.value for r in motion.motion_correct_pca(ts, mask, share).collect()}
    bad = x[:, 3:11]
    mean, sd = bad.mean(1, keepdims=True), bad.std(1, keepdims=True)
    z = (bad - mean) / sd
    u, s, v = np.linalg.svd(z, full_matrices=False)
    n = share if share >= 1 else int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), share)) + 1
    y = x.copy()
    y[:, 3:11] = (z - (u[:, :n] * s[:n]) @ v[:n]) * sd + mean
    for i in (3, 11):
        y[:, i:] -= (y[:, i] - y[:, i - 1])[:, None]
    assert all(got[f"C{c:02}", i] == pytest.approx(y[c, i], abs=1e-8) for c in range(channels) for i in range(12))
