"""Outlier masks, random events, checks of options and small helpers, against brute force and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core.schema import SchemaError
from lumenframe.functions import basis, landmarks, signal
from lumenframe.operators import decomposition, kernels, multimodal_checks, quality, simulation

TS = "channel string, wavelength double, sample long, time double, value double"
FS = 10.0


def series(spark, traces):
    return spark.createDataFrame([(c, 760.0, i, i / FS, None if v is None else float(v)) for c, vs in traces.items() for i, v in enumerate(vs)], TS)


def masks(df):
    out = {}
    for r in df.orderBy("channel", "sample").collect():
        out.setdefault(r["channel"], []).append(r["mask"])
    return out


def inside(x, k):
    lo, hi = np.quantile(x, [0.25, 0.75])
    return ((x >= lo - k * (hi - lo)) & (x <= hi + k * (hi - lo))).tolist()


def test_outlier_masks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300).cumsum() * 0.1
    x[150:] += 8
    ts = series(spark, {"S": x})
    n, low = 15, signal.freq_filter(x, FS, 0, 0.5)
    rolled = np.array([low[max(i - n // 2, 0) : i + (n - 1) // 2 + 1].std() for i in range(len(x))])
    std = inside(rolled, 2)
    wide = np.r_[0.0, signal.freq_filter(x, FS, 0, 2.0), 0.0]
    grad = inside(wide[:-2] - wide[2:], 1.5)
    assert masks(kernels.detect_outliers_std(ts, FS, 1.5))["S"] == std and not all(std)
    assert masks(kernels.detect_outliers_grad(ts, FS))["S"] == grad and not all(grad)
    assert masks(kernels.detect_outliers(ts, FS, 1.5))["S"] == [a and b for a, b in zip(std, grad, strict=True)]


def test_outlier_masks_of_constant_short_and_null_traces(spark):
    ts = series(spark, {"flat": [0.0] * 40, "one": [3.0], "two": [1.0, 2.0], "none": [None] * 3})
    for df in (quality.outliers_std(ts, 5), quality.outliers_grad(ts), kernels.detect_outliers(ts, FS, 1.0)):
        got = masks(df)
        assert {c: len(m) for c, m in got.items()} == {"flat": 40, "one": 1, "two": 2, "none": 3}
        assert all(all(m) for m in got.values())
    assert kernels.detect_outliers(ts.limit(0), FS, 1.0).count() == 0
    with pytest.raises(ValueError):
        kernels.detect_outliers_grad(ts, 4.0)


def test_random_events(spark):
    e = simulation.random_events(spark, 100.0, 400, ["a", "b"], seed=1).collect()
    assert len(e) == 400 and {r.trial_type for r in e} == {"a", "b"} and {r.channel for r in e} == {None}
    assert all(0 <= r.onset <= 100 and r.onset + r.duration <= 100.1 for r in e)
    assert max(r.duration for r in e) > 20
    assert [r.trial_type for r in e[:8]] != ["a", "b"] * 4
    share = simulation.random_events_share(spark, 60.0, 0.5, ["a"], ["S1", "S2"], seed=2)
    one = share.where("channel = 'S1'").collect()
    total = sum(r.duration for r in one)
    assert 30 <= total < 30.4 and all(r.onset + r.duration < 60 for r in one)
    assert share.count() == 2 * len(one)
    with pytest.raises(ValueError):
        simulation.random_events_share(spark, 0.3, 0.5, ["a"])


def test_add_event_timing(spark):
    first = simulation.add_event_timing(None, [(1, 2), (3, 4, 5)], "a", spark=spark)
    both = simulation.add_event_timing(first, [(6.5, 1)], "b", ["S1", "S2"])
    got = sorted((r.onset, r.duration, r.value, r.trial_type, r.channel or "") for r in both.collect())
    assert got == [(1, 2, 1, "a", ""), (3, 4, 5, "a", ""), (6.5, 1, 1, "b", "S1"), (6.5, 1, 1, "b", "S2")]
    with pytest.raises(ValueError):
        simulation.add_event_timing(first, [(1,)], "a")


def test_checks_of_options(spark):
    assert multimodal_checks.penalties(2) == (2, 2) and multimodal_checks.penalties([1, 0.5]) == (1, 0.5)
    assert multimodal_checks.time_shifts(10, [4, 2]) == [0, 2, 4] and multimodal_checks.time_shifts(10, (0, 3)) == [0, 3]
    assert multimodal_checks.n_components(9, 9, 3, None) == 3 and multimodal_checks.n_components(9, 9, 3, 2) == 2
    multimodal_checks.same_features(["a", "b"], ["b", "a"])
    for bad in (lambda: multimodal_checks.penalties("x"), lambda: multimodal_checks.penalties([1, 2, 3]), lambda: multimodal_checks.time_shifts(4, [4]),
                lambda: multimodal_checks.time_shifts(4, [-1]), lambda: multimodal_checks.n_components(9, 8, 3, 1), lambda: multimodal_checks.n_components(2, 2, 3, 1),
                lambda: multimodal_checks.n_components(9, 9, 3, 4), lambda: multimodal_checks.same_features(["a"], ["b"])):
        with pytest.raises(ValueError):
            bad()
    x = spark.createDataFrame([("a", i, float(i * i % 7)) for i in range(9)], "channel string, sample long, value double")
    with pytest.raises(ValueError):
        decomposition.cca(x, x, 2)
    with pytest.raises(SchemaError):
        decomposition.cca(x.drop("value"), x)
    one, _, s = decomposition.cca(x, x, 1, l2=0.0)
    assert one.count() == 1 and s[0] == pytest.approx(1.0)


def test_random_gaussian_sum():
    make = basis.RandomGaussianSum(0, 20, 1, 1.5, seed=5)
    t, h = make(10.0)
    again = make(10.0)[1]["random_gaussian_sum"]
    h = h["random_gaussian_sum"]
    assert h.max() == 1 and h[0] == 0 and abs(h[-1]) < 1e-12 and (h == again).all()
    assert t[0] == pytest.approx(-1.5) and t[-1] == pytest.approx(21.5) and np.diff(t) == pytest.approx(0.1)
    assert basis.tapered(11, 0.4).tolist() == pytest.approx([0, 0.5, *[1] * 7, 0.5, 0])


def test_landmark_order():
    line = np.array([[3.0, 0, 0], [1, 0, 0], [4, 0, 0]])
    points, way = landmarks.along_line(np.zeros(3), line)
    assert points[:, 0].tolist() == [1, 3, 4] and way.tolist() == pytest.approx([0.25, 0.75, 1])
    head = {"Nz": (0, 10, 0), "Nz2": (0, 9.5, 1), "Iz": (0, -10, 0), "Cz": (0, 0, 9), "R": (8, 0, 0), "L": (-8, 0, 0)}
    got = landmarks.order_six(np.array(list(head.values()), float), "Nz")
    names = list(head)
    assert {names[got["Nz"]], names[got["Iz"]], names[got["Cz"]]} <= {"Nz", "Nz2", "Iz", "Cz"} and {names[got["RPA"]], names[got["LPA"]]} == {"R", "L"}
    flipped = landmarks.order_six(np.array(list(head.values()), float), "Iz")
    assert flipped["Nz"] == got["Iz"] and flipped["RPA"] == got["LPA"]
    with pytest.raises(ValueError):
        landmarks.order_six(np.zeros((5, 3)), "Nz")
