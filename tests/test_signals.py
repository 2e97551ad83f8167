"""Golden values, closed forms and identities of the time-series operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core import recording, schema, units
from lumenframe.functions import basis, signal, smoothing
from lumenframe.operators import decomposition, epochs, glm, kernels, masks, optics, quality, simulation, stats, windows

TS = "channel string, wavelength double, sample long, time double, value double"


def series(spark, traces, fs=10.0):
    rows = [(c, float(w), i, i / fs, None if v is None else float(v)) for (c, w), vs in traces.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, TS)


def values(df, *keys):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["time"] if "time" in r else 0)):
        out.setdefault(tuple(r[k] for k in keys), []).append(r["value"])
    return out


def test_int2od_golden(spark):
    a = series(spark, {("S1D1", 760): [10, 20, 30], ("S1D1", 850): [30, 20, 10]})
    got = values(optics.int2od(a), "wavelength")
    assert got[(760.0,)] == pytest.approx([-math.log(0.5), 0, -math.log(1.5)])
    assert got[(850.0,)] == pytest.approx([-math.log(1.5), 0, -math.log(0.5)])
    back = optics.od2int(optics.int2od(a), optics.baseline(a))
    assert values(back, "wavelength")[(760.0,)] == pytest.approx([10, 20, 30], rel=1e-6)


def test_int2od_rejects_nonpositive(spark):
    with pytest.raises(Exception, match="positive"):
        optics.int2od(series(spark, {("a", 760): [1, 0, 2]})).collect()


def waveform(spark):
    one = [0.0] * 5 + list(range(10)) + [0.0] * 5
    return series(spark, {("S1D1", 760): one * 3})


@pytest.mark.parametrize("onset, want", [(0.5, [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]), (0.55, [0, 0, 0, 0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 4.5, 0])])
def test_epochs_golden(spark, onset, want):
    stim = spark.createDataFrame([(0, onset, "A")], "event_id long, onset double, trial_type string")
    got = epochs.to_epochs(waveform(spark), stim, 0.3, 1.0, 10.0).orderBy("rel_idx").collect()
    assert [r.reltime for r in got] == pytest.approx([-0.3 + 0.1 * i for i in range(14)])
    assert [r.value for r in got] == pytest.approx(want)


def test_epochs_selection_and_range(spark):
    stim = spark.createDataFrame([(0, 0.5, "A"), (1, 2.5, "A"), (2, 4.5, "B"), (3, 0.0, "A"), (4, 10.0, "B")], "event_id long, onset double, trial_type string")
    n = lambda types: epochs.to_epochs(waveform(spark), stim, 0.3, 1.0, 10.0, types).select("epoch").distinct().count()
    assert (n(None), n(["A"]), n(["B"])) == (3, 2, 1)


def test_stimulus_mask_golden(spark):
    rows = [(c, i, float(i), not (c == "S1D2" and i == 1 or c == "S1D3" and i == 6)) for c in ("S1D1", "S1D2", "S1D3") for i in range(10)]
    mask = spark.createDataFrame(rows, "channel string, sample long, time double, mask boolean")
    stim = spark.createDataFrame([(0, 1.0, 3.0), (1, 5.0, 3.0)], "event_id long, onset double, duration double")
    got = {(r.event, r.channel): r.mask for r in quality.stimulus_mask(stim, mask).collect()}
    assert [got[0, c] for c in ("S1D1", "S1D2", "S1D3")] == [True, False, True]
    assert [got[1, c] for c in ("S1D1", "S1D2", "S1D3")] == [True, True, False]


def test_masks(spark):
    a = series(spark, {("a", 760): [1, 2], ("b", 760): [3, 4], ("c", 760): [5, 6]})
    m = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "channel string, mask boolean")
    k = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "channel string, mask boolean")
    names = lambda df: {r.channel for r in df.collect()}
    assert names(masks.prune(a, [m, k], "all")) == {"a"} and names(masks.prune(a, [m, k], "any")) == {"a", "b", "c"}
    assert values(masks.apply(a, m, "nan"), "channel")[("b",)] == [None, None]
    assert [r.channel for r in masks.masked(m, "channel").collect()] == ["b"]
    with pytest.raises(ValueError):
        masks.apply(a, m, "other")


def test_optics_roundtrip(spark):
    spectrum = spark.createDataFrame([(750.0, 518.0, 1405.0), (870.0, 1102.0, 700.0)], "wavelength double, HbO double, HbR double")
    coef = optics.extinction_coefficients(spectrum, [760.0, 850.0])
    got = {(r.chromo, r.wavelength): r.coef for r in coef.collect()}
    assert got["HbO", 760.0] == pytest.approx((518 + (1102 - 518) / 12) * math.log(10) / 10)
    od = series(spark, {("a", 760): [0.1, 0.2], ("a", 850): [0.3, -0.1]})
    dist = spark.createDataFrame([("a", 30.0)], "channel string, distance double")
    conc = optics.od2conc(od, dist, {760.0: 6.0, 850.0: 5.0}, coef)
    back = optics.conc2od(conc, dist, {760.0: 6.0, 850.0: 5.0}, coef)
    assert {k: v for k, v in values(back, "wavelength").items()}[(760.0,)] == pytest.approx([0.1, 0.2])
    with pytest.raises(Exception, match="outside"):
        optics.extinction_coefficients(spectrum, [700.0]).collect()


def test_repair_amp(spark):
    a = series(spark, {("a", 760): [1, None, 3, -5, 5, 9]})
    got = values(quality.repair_amp(a), "channel")[("a",)]
    x = np.array([1, 2, 3, 1e-18, 5, 9])
    pad = np.r_[x[0], x, x[-1]]
    assert got == pytest.approx([np.median(pad[i : i + 3]) for i in range(6)])


def test_segments_and_motion(spark):
    x = np.zeros(100)
    x[50:] = 20.0
    mask = quality.id_motion(series(spark, {("a", 760): x}), 10.0)
    runs = {(r.start, r.stop): r.mask for r in windows.segments(mask).collect()}
    bad = [k for k, v in runs.items() if not v]
    assert len(bad) == 1 and bad[0][0] <= 45 and bad[0][1] >= 55
    refined, info = quality.id_motion_refine(mask, "all")
    assert info.first()["n_artifacts"] == 1 and refined.where("NOT mask").count() == bad[0][1] - bad[0][0]


def test_windows(spark):
    a = series(spark, {("a", 760): [1, 2, 4, 8]})
    assert values(windows.convolve(a, [1, 2, 3]), "channel")[("a",)] == pytest.approx(np.convolve([1, 2, 4, 8], [1, 2, 3], "same"))
    assert values(windows.diff(a), "channel")[("a",)] == [1, 2, 4]
    assert values(windows.shift(a, 1), "channel")[("a",)] == [None, 1, 2, 4]
    assert values(windows.edge_pad(a, 2), "channel")[("a",)] == [1, 1, 1, 2, 4, 8, 8, 8]
    z = values(windows.standardize(a), "channel")[("a",)]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    w = values(windows.ar_filter(a, [0.5]), "channel")[("a",)]
    assert w == pytest.approx(signal.whiten(np.array([1, 2, 4, 8]) - 3.75, np.array([0.5])))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df).collect()}
    order, n = np.argsort(p), len(p)
    q = np.minimum.accumulate((np.array(p)[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    assert [got[i] for i in order] == pytest.approx(np.minimum(q, 1))


def test_benjamini_hochberg_ties_nulls_and_families(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400) ** 3, 2)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(p)] + [(900, "a", None), (901, None, 0.5)]
    df = spark.createDataFrame(rows, "i int, f string, p double")
    for by in (None, ["f"]):
        got = {r.i: r.q for r in stats.benjamini_hochberg(df, by=by).collect()}
        assert len(got) == 402 and got[900] is None and got[901] == (0.5 if by else got[901])
        for family in ("ab",) if by is None else ("a", "b"):
            own = [(i, v) for i, f, v in rows if v is not None and (by is None or f == family)]
            v = np.array([x for _, x in own])
            order, n = np.argsort(v), len(v)
            q = np.minimum(np.minimum.accumulate((v[order] * n / np.arange(1, n + 1))[::-1])[::-1], 1)
            assert [got[own[k][0]] for k in order] == pytest.approx(q)


def test_cross_gram_by_brute_force(spark):
    rows = [(c, s, float(hash((c, s)) % 7)) for c in ("a", "b", "c") for s in range(20) if (c, s) != ("b", 3)] + [("a", 2, 1.5), ("b", 5, None), ("z", 99, 2.0)]
    df = spark.createDataFrame(rows, "channel string, sample long, value double")
    got = {(r.a, r.b): r.g for r in decomposition.cross_gram(df, df).collect()}
    want = {}
    for c, s, v in rows:
        for d, t, w in rows:
            if s == t and v is not None and w is not None:
                want[c, d] = want.get((c, d), 0.0) + v * w
    assert got == pytest.approx(want)


def test_global_component(spark):
    rng = np.random.default_rng(0)
    g = rng.normal(size=50)
    a = series(spark, {(f"c{k}", 760): g * (k + 1) for k in range(3)})
    assert np.abs([v for vs in values(stats.global_component(a), "channel").values() for v in vs]).max() < 1e-9


@pytest.mark.parametrize("low, high", [(0, 0.5), (0.5, 0), (0.3, 1.0)])
def test_filter_passes_and_stops(low, high):
    fs, t = 10.0, np.arange(2000) / 10.0
    gain = lambda f: np.std(signal.freq_filter(np.sin(2 * np.pi * f * t), fs, low, high)[300:-300]) * math.sqrt(2)
    for f in (0.05, 0.6, 3.0):
        inside = (not low or f > 1.3 * low) and (not high or f < high / 1.3)
        outside = (low and f < low / 2) or (high and f > 2 * high)
        assert not inside or gain(f) == pytest.approx(1, abs=0.1)
        assert not outside or gain(f) < 0.05


def test_filter_is_a_projection_of_constants():
    assert signal.freq_filter(np.full(300, 3.0), 10.0, 0, 1.0) == pytest.approx(np.full(300, 3.0))
    sos = signal.butter_sections(4, 0, 1.0, 10.0)
    w = np.exp(-1j * 2 * np.pi * 1.0 / 10.0 * np.arange(3))
    assert abs(np.prod([(s[:3] @ w) / (s[3:] @ w) for s in sos])) == pytest.approx(math.sqrt(0.5))
    with pytest.raises(ValueError):
        signal.butter_sections(4, 0, 6.0, 10.0)


def test_wavelet_reconstructs():
    x = np.random.default_rng(1).normal(size=64)
    a, d = signal.swt(x, 3)
    assert signal.iswt(a, d) == pytest.approx(x)
    y = x.copy()
    y[30] += 40
    assert abs(signal.wavelet_repair(y)[30]) < 25 and signal.wavelet_repair(y, -1) == pytest.approx(y)


def test_motion_kernels():
    fs, t = 10.0, np.arange(600) / 10.0
    clean = np.sin(2 * np.pi * 0.05 * t)
    shifted = clean + 5.0 * (t > 30)
    fixed = signal.tddr(shifted, fs)
    assert abs(np.mean(fixed[-200:]) - np.mean(fixed[:200])) < 2.0
    assert signal.tddr(np.full(50, 2.0), fs) == pytest.approx(np.full(50, 2.0))
    mask = np.ones(600, bool)
    mask[290:310] = False
    assert abs(signal.spline_repair(shifted, mask, fs, 0.01)[-100:].mean() - clean[-100:].mean()) < 2.5
    cubic = (t - 30) ** 3
    assert signal.savgol(cubic, 21) == pytest.approx(cubic, abs=1e-6)
    assert smoothing.smooth_spline(t[:50], t[:50], 1e-6) == pytest.approx(t[:50], abs=0.01)


def test_peaks_ar_and_resample():
    t = np.arange(400) / 10.0
    peaks = np.flatnonzero(signal.ampd(np.sin(2 * np.pi * 0.5 * t)))
    assert len(peaks) >= 18 and np.abs(np.diff(peaks) - 20).max() <= 1
    long = np.arange(1150) / 10.0
    last = np.flatnonzero(signal.ampd(np.sin(2 * np.pi * 0.2 * long)))[-1]
    assert last >= 1100 and signal.ampd(np.arange(2.0)).tolist() == [0, 0]
    rng = np.random.default_rng(3)
    x = np.zeros(4000)
    for i in range(2, 4000):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    assert signal.ar_fit(x, 10)[:2] == pytest.approx([0.6, -0.3], abs=0.06)
    grid, y = signal.resample(t, np.sin(2 * np.pi * 0.2 * t), 4.0)
    assert y[20:-20] == pytest.approx(np.sin(2 * np.pi * 0.2 * grid)[20:-20], abs=0.03)


def test_sci_of_equal_traces_is_one(spark):
    x = np.sin(np.arange(100.0))
    ts = series(spark, {("a", 760): x, ("a", 850): 3 * x + 1, ("b", 760): x, ("b", 850): -x})
    got = {(r.channel, r.window): r.sci for r in kernels.sci(ts, 10.0, 2.0, 0.5).collect()}
    assert all(v == pytest.approx(1 if c == "a" else -1) for (c, _), v in got.items()) and len(got) == 10
    assert kernels.psp(ts, 10.0, 2.0, 0.1).count() == 10


def test_windows_end_at_every_nth_sample():
    w = signal.trailing_windows(np.arange(1.0, 12.0), 5)
    assert w.tolist() == [[1e-6] * 4 + [1.0], [2.0, 3.0, 4.0, 5.0, 6.0], [7.0, 8.0, 9.0, 10.0, 11.0]]
    assert len(signal.trailing_windows(np.zeros(1150), 100)) == 12 and len(signal.trailing_windows(np.zeros(3), 5)) == 1


def test_two_wavelengths_meet_by_sample(spark):
    """A sample that one wavelength lacks moves nothing."""
    x = np.sin(np.arange(60.0))
    ts = series(spark, {("a", 760): x, ("a", 850): x}).where("NOT (sample = 7 AND wavelength = 850)")
    assert [r.sci for r in kernels.sci(ts, 10.0, 2.0, 0.5).orderBy("window").collect()] == pytest.approx([1, 1, 1])


def test_kernels_keep_cells_and_refuse_streams(spark):
    ts = series(spark, {("a", 760): np.arange(40.0), ("b", 850): np.ones(40)})
    assert {r.channel for r in kernels.freq_filter(ts, 10.0, 0, 1.0).collect()} == {"a", "b"}
    assert kernels.freq_filter(ts, 10.0, 0, 1.0).count() == 80
    with pytest.raises(ValueError):
        kernels.freq_filter(spark.readStream.format("rate").load().selectExpr("'a' channel", "value sample", "1.0D time", "1.0D value"), 10.0, 0, 1.0)


def test_glm_fit_and_predict(spark):
    n = 50
    ts = series(spark, {("a", 760): [1 + 2 * (i + 1) / n for i in range(n)]})
    design = glm.drift_regressors(ts.select("sample"), 1)
    rows = {r.regressor: r for r in glm.coefficients(glm.fit(ts, design)).collect()}
    assert (rows["Drift 0"].param, rows["Drift 1"].param) == (pytest.approx(1), pytest.approx(2))
    params = glm.coefficients(glm.fit(ts, design)).select("channel", "wavelength", "regressor", "param")
    got = {r.sample: r.value for r in glm.predict(design, params).collect()}
    assert [got[i] for i in range(n)] == pytest.approx([1 + 2 * (i + 1) / n for i in range(n)])
    with pytest.raises(ValueError):
        glm.join_designs(design, design)


def test_basis_and_regressors(spark):
    t, g = basis.Gamma(0.0, 1.0)(10.0)
    assert g["gamma"].max() == pytest.approx(1) and t[g["gamma"].argmax()] == pytest.approx(1.0)
    t, k = basis.GaussianKernels(2, 10, 2, 1)(10.0)
    assert len(k) == 6 and all(v.max() == pytest.approx(1) for v in k.values())
    times = series(spark, {("a", 760): np.zeros(100)}).select("sample", "time")
    stim = spark.createDataFrame([(0, 2.0, 1.0, 1.0, "A")], "event_id long, onset double, duration double, value double, trial_type string")
    on = {r.sample: r.value for r in glm.stim_array(times, stim).collect()}
    assert [i for i in range(100) if on[i]] == list(range(20, 30))
    reg = {r.sample: r.value for r in glm.hrf_regressors(times, stim, basis.Gamma(0.0, 1.0), 10.0).collect()}
    want = np.convolve([on[i] for i in range(100)], basis.Gamma(0.0, 1.0)(10.0)[1]["gamma"])[:100]
    assert [reg[i] for i in range(100)] == pytest.approx(want / want.max())


def test_simulation(spark):
    ts = series(spark, {("a", 760): np.arange(300.0), ("b", 760): np.arange(300.0)})
    events = spark.createDataFrame([(10.0, 0.5, "spike", "a"), (20.0, 0.0, "bl_shift", None), (99.0, 5.0, "spike", None)], "onset double, duration double, trial_type string, channel string")
    got = values(simulation.add_artifacts(ts, events, 2.0, auto=False), "channel")
    assert got[("b",)][100] == 100 and got[("a",)][100] == pytest.approx(102) and got[("b",)][200:] == pytest.approx(np.arange(200.0, 300.0) + 2)
    with pytest.raises(ValueError):
        simulation.add_artifacts(ts, events.withColumn("trial_type", F.lit("nothing")))
    s = simulation.stimulus_schedule(spark, 200.0, ["A", "B"], 5, 5, 3, 6).orderBy("onset").collect()
    assert all(b.onset - (a.onset + a.duration) >= 3 for a, b in zip(s, s[1:], strict=False)) and s[-1].onset + s[-1].duration <= 200


def test_recording_and_units(spark):
    ts = series(spark, {("a", 850): [1], ("a", 760): [2]})
    rec = recording.Recording()
    with pytest.raises(ValueError):
        rec.get_timeseries()
    rec.set_timeseries("amp", ts)
    rec["od"] = ts
    with pytest.raises(ValueError):
        rec.set_timeseries("amp", ts)
    assert rec.get_timeseries() is ts and rec.wavelengths() == [760.0, 850.0] and rec.get_timeseries_type("amp") == "amplitude"
    assert recording.next_name("x", {"x", "x_02"}) == "x_03"
    d = units.with_unit(ts, "value", "cm")
    assert units.to_unit(d, "value", "mm").agg(F.max("value")).first()[0] == 20
    with pytest.raises(ValueError):
        units.factor("cm", "s")
    with pytest.raises(schema.SchemaError):
        schema.has_channel(ts)
    assert schema.build_timeseries(schema.pack(ts)).count() == 2


def test_gvtd_thresholds(spark):
    rng = np.random.default_rng(12)
    x = np.exp(rng.normal(0, 0.3, 400))
    g = spark.createDataFrame([(i / 10, float(v)) for i, v in enumerate(x)], "time double, gvtd double")
    got = {k: quality.gvtd_threshold(g, k).first()["threshold"] for k in ("default", "histogram_mode", "kdensity_mode", "parabolic_mode", "median", "mean", "MAD")}
    left = lambda c: c + 10 * math.sqrt(((x[x < c] - c) ** 2).mean())
    assert got["median"] == pytest.approx(left(np.median(x))) and got["mean"] == pytest.approx(left(x.mean()))
    assert got["MAD"] == pytest.approx(10 * np.median(np.abs(x - np.median(x))))
    count, edge = np.histogram(x, 80, (0, x.max()))
    mode = edge[count.argmax()] + x.max() / 160
    assert got["default"] == pytest.approx(2 * mode - x.min()) and got["histogram_mode"] == pytest.approx(left(mode))
    assert 0.7 < quality.density_mode(g) < 1.3
    assert abs(got["parabolic_mode"] - got["histogram_mode"]) < 2


def test_artifact_scale_by_centred_windows(spark):
    """Against windows built by hand; gaps and ends do not count, and a short trace has no scale."""
    rng = np.random.default_rng(5)
    v = {"a": rng.normal(size=47), "b": rng.normal(size=30), "c": rng.normal(size=6)}
    rows = [(c, 760.0, i, i / 10, None if (c, i) == ("b", 11) else float(x)) for c, xs in v.items() for i, x in enumerate(xs)]
    ts = spark.createDataFrame(rows, "channel string, wavelength double, sample long, time double, value double")
    for window in (8, 9):
        want = {}
        for c, xs in v.items():
            xs = np.where((np.arange(len(xs)) == 11) & (c == "b"), np.nan, xs)
            parts = [xs[i - window // 2 : i - window // 2 + window] for i in range(0, len(xs), window // 2) if i >= window // 2]
            whole = [p.max() - p.min() for p in parts if len(p) == window and not np.isnan(p).any()]
            if whole:
                want[c] = np.median(whole)
        got = {r.channel: r.scale for r in simulation.artifact_scale(ts, window).collect()}
        assert got == pytest.approx(want) and set(got) == {"a", "b"}
    events = spark.createDataFrame([(0.1, 0.2, "bl_shift", None)], "onset double, duration double, trial_type string, channel string")
    out = simulation.add_artifacts(ts, events, window=8)
    assert out.count() == 83 and out.where("channel = 'c' AND value IS NOT NULL").count() == 0


def test_stim_array_by_buckets(spark):
    """Against every event and sample, with gaps in time, events between samples, over buckets and after the end."""
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.choice([0.1, 0.7, 3.0, 40.0], 300, p=[0.5, 0.4, 0.08, 0.02]))
    events = [(i, float(o), float(d), float(i % 5 + 1), f"T{i % 3}") for i, (o, d) in enumerate(zip(rng.uniform(-5, t[-1] + 20, 40), rng.choice([0.0, 0.3, 12.0, 60.0], 40), strict=True))]
    times = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "sample long, time double")
    stim = spark.createDataFrame(events, "event_id long, onset double, duration double, value double, trial_type string")
    want = {(i, k): 0.0 for i in range(300) for k in ("T0", "T1", "T2")}
    for _, o, d, v, k in events:
        begun = np.flatnonzero(t >= o)
        for i in begun:
            if i == begun[0] or t[i] < o + d:
                want[int(i), k] = v
    got = {(r.sample, r.trial_type): r.value for r in glm.stim_array(times, stim).collect()}
    assert got == want
