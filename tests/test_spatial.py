"""Closed forms and identities of geometry, imaging, decompositions, sources and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core.recording import Recording
from lumenframe.core.schema import CRSMismatchError
from lumenframe.functions import transforms
from lumenframe.operators import decomposition, geometry, imaging
from lumenframe.sources import store, text
from lumenframe.streaming import operators as streaming

POINTS = "label string, type string, x double, y double, z double"


def cloud(spark, xyz, prefix="P"):
    return spark.createDataFrame([(f"{prefix}{i}", "UNKNOWN", *map(float, p)) for i, p in enumerate(xyz)], POINTS)


def sphere(spark, n=12):
    """Vertices and faces of a unit sphere."""
    v, f, at = [], [], {}
    for i in range(n + 1):
        for j in range(2 * n):
            key = (i, j if 0 < i < n else 0)
            if key not in at:
                at[key] = len(v)
                th, ph = math.pi * i / n, math.pi * key[1] / n
                v.append((math.sin(th) * math.cos(ph), math.sin(th) * math.sin(ph), math.cos(th)))
    idx = lambda i, j: at[(i, j % (2 * n) if 0 < i < n else 0)]
    for i in range(n):
        for j in range(2 * n):
            a, b, c, d = idx(i, j), idx(i + 1, j), idx(i + 1, j + 1), idx(i, j + 1)
            f += [t for t in ((a, b, c), (a, c, d)) if len(set(t)) == 3]
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vertex long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "face long, a long, b long, c long")
    return vertices, faces, np.array(v)


def test_transforms():
    assert transforms.m_rot([0, 0, math.pi / 2]) @ [1, 0, 0, 1] == pytest.approx([0, 1, 0, 1])
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 3))
    for mode, m in (("none", transforms.m_scale1(1)), ("iso", transforms.m_scale1(2.5)), ("axes", transforms.m_scale3([1.5, 0.7, 2.0]))):
        t = transforms.m_trans([1, 2, 3]) @ transforms.m_rot([0.3, -0.2, 1.0]) @ m
        b = a @ t[:3, :3].T + t[:3, 3]
        assert transforms.rigid(a, b, mode) == pytest.approx(t, abs=1e-5), mode
        assert transforms.affine(a, b) == pytest.approx(t)
    with pytest.raises(ValueError):
        transforms.rigid(a[:2], a[:2])


def test_assignment_is_least():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(20):
        c = rng.random((4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert c[np.arange(4), transforms.assignment(c)].sum() == pytest.approx(best)
    a = rng.normal(size=(15, 3))
    t = transforms.m_trans([0.05, 0, 0]) @ transforms.m_rot([0, 0, 0.05])
    b = (a @ t[:3, :3].T + t[:3, 3])[::-1]
    found, pick = transforms.icp(a, b)
    assert (pick == np.arange(15)[::-1]).all() and found == pytest.approx(t, abs=1e-6)


def test_points(spark):
    p = geometry.set_crs(cloud(spark, [(1, 0, 0), (0, 2, 0)]), "pos")
    moved = geometry.affine(p, transforms.m_trans([1, 1, 1]), "pos", "ras")
    assert geometry.crs_of(moved) == "ras" and {(r.x, r.y, r.z) for r in moved.collect()} == {(2, 1, 1), (1, 3, 1)}
    with pytest.raises(CRSMismatchError):
        geometry.affine(moved, np.eye(4), "pos", "ras")
    with pytest.raises(KeyError):
        geometry.add_points(p, p)
    kinds = spark.createDataFrame([("S1", None, 0.0, 0.0, 0.0), ("D1", "UNKNOWN", 0.0, 0.0, 0.0), ("x", "LANDMARK", 0.0, 0.0, 0.0)], POINTS)
    assert [r.type for r in geometry.inferred_types(kinds).orderBy("label").collect()] == ["DETECTOR", "SOURCE", "LANDMARK"]


@pytest.mark.parametrize("cell", [None, 0.2, 5.0])
def test_snap(spark, cell):
    rng = np.random.default_rng(2)
    v, p = rng.random((200, 3)), rng.random((15, 3)) * 2
    vertices = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "vertex long, x double, y double, z double")
    got = {r.label: (r.vertex, r.distance) for r in geometry.snap(cloud(spark, p), vertices, cell).collect()}
    d = np.linalg.norm(p[:, None] - v[None], axis=2)
    assert {k: x[0] for k, x in got.items()} == {f"P{i}": int(d[i].argmin()) for i in range(15)}
    assert [got[f"P{i}"][1] for i in range(15)] == pytest.approx(d.min(1))


def test_sphere(spark):
    vertices, faces, v = sphere(spark)
    area = geometry.face_normals(faces, vertices).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(4 * math.pi, rel=0.03)
    n = {r.vertex: np.array([r.nx, r.ny, r.nz]) for r in geometry.vertex_normals(faces, vertices).collect()}
    assert all(abs(n[i] @ v[i]) > 0.95 for i in n)
    e, nf, nv = geometry.edges(faces).count(), faces.count(), vertices.count()
    assert nv - e + nf == 2
    lap = geometry.laplacian(faces, vertices)
    assert abs(lap.groupBy("i").agg(F.sum("weight").alias("s")).agg(F.max(F.abs("s"))).first()[0]) < 1e-9
    smooth = geometry.smooth(faces, vertices, 1)
    assert smooth.count() == nv


@pytest.mark.parametrize("mode", ["trans_rot", "trans_rot_isoscale", "trans_rot_scale", "general"])
def test_register_fits_all_common_labels(spark, mode):
    """Over 10,000 labels, of which the later ones lie elsewhere."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(12_000, 3)) * [1.0, 2.0, 3.0]
    b = a @ np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]).T * 1.5 + rng.normal(size=a.shape) * 0.1
    b[10_000:] += 5.0
    df = lambda p: spark.createDataFrame([(f"{i:05d}", *map(float, r)) for i, r in enumerate(p)], "label string, x double, y double, z double")
    want = transforms.affine(a, b) if mode == "general" else transforms.rigid(a, b, {"trans_rot": "none", "trans_rot_isoscale": "iso", "trans_rot_scale": "axes"}[mode])
    assert geometry.register(df(a), df(b), mode) == pytest.approx(want, abs=1e-5)


def test_gradient(spark):
    vertices, faces, v = sphere(spark, 10)
    g = geometry.surface_gradient(faces, vertices, vertices.select("vertex", F.col("z").alias("value")))
    f = geometry.face_normals(faces, vertices).join(g, "face")
    dot = f.select((F.col("gx") * F.col("nx") + F.col("gy") * F.col("ny") + F.col("gz") * F.col("nz")).alias("d"), (F.col("gz") - (1 - F.col("nz") ** 2)).alias("e")).agg(F.max(F.abs("d")), F.max(F.abs("e"))).first()
    assert dot[0] < 1e-9 and dot[1] < 1e-6


def test_projection_and_spread(spark):
    p = spark.createDataFrame([("Nz", "L", 0.0, 1.0, 0.0), ("LPA", "L", -1.0, 0.0, 0.0), ("RPA", "L", 1.0, 0.0, 0.0), ("Cz", "L", 0.0, 0.0, 1.0)], POINTS)
    got = {r.label: (r.u, r.v) for r in geometry.scalp_projection(p).collect()}
    assert got["Cz"] == pytest.approx((0, 0), abs=1e-9) and got["Nz"] == pytest.approx((0, 1)) and got["RPA"] == pytest.approx((1, 0))
    roles = {r.role: r.label for r in geometry.spread_points(cloud(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0), (2, 0, 0)])).collect()}
    assert roles == {"first": "P0", "farthest": "P2", "median": "P3"}


def test_voxels(spark):
    vol = spark.createDataFrame([("gm", 0, 0, 0, 1), ("wm", 0, 0, 0, 1), ("wm", 1, 0, 0, 1), ("csf", 2, 0, 0, 0)], "seg_type string, i int, j int, k int, label int")
    assert geometry.overlapping_voxels(vol).count() == 1
    assert geometry.voxels_from_segmentation(vol, ["gm", "wm", "csf"]).count() == 2
    assert {r.x for r in geometry.cell_coordinates(vol, transforms.m_trans([10, 0, 0])).collect()} == {10, 11, 12}
    assert imaging.tissue_properties(vol.where("seg_type <> 'x'")).count() == 3
    with pytest.raises(Exception, match="unknown tissue"):
        imaging.tissue_properties(vol.withColumn("seg_type", F.lit("cheese"))).collect()


def test_sensitivity_and_inverse(spark):
    rng = np.random.default_rng(4)
    flu = spark.createDataFrame([(lab, 760.0, x, float(v)) for lab, vs in (("S1", [1, 2, 3]), ("D1", [4, 5, 6])) for x, v in enumerate(vs)], "label string, wavelength double, voxel long, value double")
    at = spark.createDataFrame([("S1", "D1", 760.0, 2.0), ("D1", "S1", 760.0, 4.0)], "label string, other string, wavelength double, value double")
    v2v = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "voxel long, vertex int")
    ch = spark.createDataFrame([("S1D1", "S1", "D1")], "channel string, source string, detector string")
    got = {r.vertex: r.value for r in imaging.sensitivity(flu, at, v2v, ch, 2.0).collect()}
    assert got == {0: pytest.approx((4 + 10) / 3 * 8), 1: pytest.approx(18 / 3 * 8)}
    a = rng.normal(size=(4, 6))
    adot = spark.createDataFrame([(f"c{i // 2}", 760.0 + 90 * (i % 2), j, float(a[i, j])) for i in range(4) for j in range(6)], "channel string, wavelength double, vertex int, value double").withColumn("chromo", F.lit("HbO"))
    inv = imaging.pseudo_inverse(adot, 1e-9)
    b = np.zeros((6, 4))
    for r in inv.collect():
        b[r.vertex, 2 * int(r.channel[1]) + int(r.wavelength > 800)] = r.value
    assert b == pytest.approx(np.linalg.pinv(a), abs=1e-5)


def test_decompositions(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=(200, 2))
    x = s @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(200, 4))
    y = s[:, :1] @ rng.normal(size=(1, 3)) + 0.05 * rng.normal(size=(200, 3))
    long = lambda m, p: spark.createDataFrame([(f"{p}{j}", i, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "channel string, sample long, value double")
    w, share = decomposition.pca(long(x, "x"), 4)
    c = np.cov(x.T)
    assert share == pytest.approx(np.sort(np.linalg.eigvalsh(c))[::-1] / np.trace(c), abs=1e-6)
    wx, wy, sv = decomposition.cca(long(x, "x"), long(y, "y"), 1)
    u = np.array([r.value for r in decomposition.project(long(x, "x"), wx).orderBy("sample").collect()])
    v = np.array([r.value for r in decomposition.project(long(y, "y"), wy).orderBy("sample").collect()])
    assert sv[0] > 0.95 and abs(np.corrcoef(u, s[:, 0])[0, 1]) > 0.95 and abs(np.corrcoef(u, v)[0, 1]) > 0.95
    sparse, _, _ = decomposition.cca(long(x, "x"), long(y, "y"), 1, l1=(0.3, 0.3), l2=(0.1, 0.1))
    assert sparse.count() == 4
    rest = decomposition.remove_components(long(x, "x"), 2)
    left = np.array([r.value for r in rest.orderBy("channel", "sample").collect()]).reshape(4, 200)
    assert np.var(left, axis=1).max() < 0.05
    emb, _, _ = decomposition.temporally_embedded_cca(long(x, "x"), long(y, "y"), [0, 1])
    assert emb.select("channel").distinct().count() == 8


def test_spoc_follows_power(spark):
    rng = np.random.default_rng(6)
    power = np.repeat(np.linspace(0.2, 3, 20), 50)
    s = np.column_stack([rng.normal(size=1000) * power, rng.normal(size=(1000, 2))])
    mix = rng.normal(size=(3, 3))
    x = s @ mix
    df = spark.createDataFrame([(f"c{j}", i, float(x[i, j])) for i in range(1000) for j in range(3)], "channel string, sample long, value double")
    z = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.linspace(0.2, 3, 20) ** 2)], "bin int, value double")
    w, lam = decomposition.spoc(df, z, 20)
    first = np.array([r.value for r in decomposition.project(df, w.where("component = 0")).orderBy("sample").collect()])
    assert abs(np.corrcoef(first, s[:, 0])[0, 1]) > 0.9 and lam[0] == max(lam)


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tduration\tvalue\ttrial_type\tnote\n1.5\t2\t1\tA\tx\n3\tn/a\t1\tB\ty\n")
    e = text.read_events_tsv(spark, str(tmp_path / "e.tsv")).orderBy("onset").collect()
    assert e[0].onset == 1.5 and e[1].duration is None and e[1].note == "y"
    p = spark.createDataFrame([("S1", "SOURCE", 1.0, 2.0, 3.0), ("Nz", "LANDMARK", 0.5, 0.0, -1.0)], POINTS)
    text.write_points_tsv(p, str(tmp_path / "p"))
    assert sorted(map(tuple, text.read_points_tsv(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, p.collect()))
    text.write_markups_json(p, str(tmp_path / "m"))
    assert {(r.label, r.x, r.y, r.z) for r in text.read_markups_json(spark, str(tmp_path / "m")).collect()} == {("S1", 1, 2, 3), ("Nz", 0.5, 0, -1)}
    (tmp_path / "d.txt").write_text("nz: 1 2 3\n s1 :  4.5 5 6 \n")
    d = {r.label: (r.type, r.x) for r in text.read_digpts(spark, str(tmp_path / "d.txt")).collect()}
    assert d == {"nz": ("LANDMARK", 1.0), "s1": ("SOURCE", 4.5)}
    (tmp_path / "o.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n")
    v, f = text.read_obj(spark, str(tmp_path / "o.obj"))
    assert v.count() == 3 and tuple(f.first()) == (0, 0, 1, 2)
    (tmp_path / "parcels.json").write_text(json.dumps({"a b": [3, 1], "c": [2]}))
    assert [(r.vertex, r.parcel) for r in text.read_parcels(spark, str(tmp_path / "parcels.json")).collect()] == [(1, "a_b"), (2, "c"), (3, "a_b")]


def test_stores(spark, tmp_path):
    s = store.FluenceStore(spark, str(tmp_path / "f"))
    row = lambda lab, w, v: spark.createDataFrame([(lab, w, 0, v)], "label string, wavelength double, voxel long, value double")
    s.put(row("S1", 760.0, 1.0))
    s.put(row("D1", 760.0, 2.0))
    s.put(row("S1", 760.0, 5.0))
    assert s.get("S1", 760.0).first()["value"] == 5.0 and s.all().count() == 2
    plan = s.get("S1", 760.0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    ts = spark.createDataFrame([("a", 0.0, 1.0)], "channel string, time double, value double")
    store.save_recording(Recording({"amp": ts}, stim=ts), str(tmp_path / "r"))
    back = store.load_recording(spark, str(tmp_path / "r"), ["amp"], parts=("stim",))
    assert back["amp"].count() == 1 and back.stim.count() == 1


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(f"c{i % 2}", i // 2, float(i), f"2024-01-01 00:00:{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "channel string, sample long, value double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for lo, hi in ((0, 10), (10, 20)):
        df.where((F.col("sample") >= lo) & (F.col("sample") < hi)).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streaming.fir_filter(stream.select("channel", "sample", "value"), [1.0, -0.5]).writeStream.format("memory").queryName("fir").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.channel, r.sample): r.value for r in spark.table("fir").collect()}
    x = {c: [float(2 * s + c) for s in range(20)] for c in (0, 1)}
    assert got == {(f"c{c}", s): x[c][s] - 0.5 * (x[c][s - 1] if s else 0) for c in (0, 1) for s in range(20)}
    q = streaming.windowed_quality(stream, "10 seconds", "1 second", ["channel"]).writeStream.format("memory").queryName("wq").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wq").agg(F.sum("n")).first()[0] == 40


def test_head_model(spark, tmp_path):
    from lumenframe.operators.head_model import HeadModel, fluence_at, object_sizes

    vertices, faces, v = sphere(spark, 8)
    vox = spark.createDataFrame([(i, *map(float, 0.9 * p)) for i, p in enumerate(v)], "voxel long, x double, y double, z double")
    v2s = vox.select("voxel", F.col("voxel").alias("vertex")).where("voxel <> 3")
    head = HeadModel(vox, vertices, faces, vertices, faces, cloud(spark, v[:6]), None, v2s)
    assert head.crs is None
    moved = head.apply_transform(transforms.m_trans([1, 0, 0]), "ras")
    assert moved.crs == "ras" and moved.brain_vertices.agg(F.avg("x")).first()[0] == pytest.approx(1 + v[:, 0].mean())
    head.save(str(tmp_path / "h"))
    assert HeadModel.load(spark, str(tmp_path / "h")).scalp_faces.count() == faces.count()
    p = cloud(spark, 1.3 * v[[2, 3, 10]])
    got = {r.label: r.voxel for r in head.snap_to_scalp_voxels(p).collect()}
    assert got["P0"] == 2 and got["P2"] == 10 and got["P1"] != 3
    t = transforms.m_trans([5, 1, 0]) @ transforms.m_scale1(2)
    far = cloud(spark, (v[:6] - [5, 1, 0]) / 2)
    snapped = {r.label: (r.x, r.y, r.z) for r in head.align_and_snap(far).collect()}
    assert all(snapped[f"P{i}"] == pytest.approx(tuple(v[i]), abs=1e-6) for i in range(6)), t
    flu = spark.createDataFrame([("S", 760.0, k, float(k > 1)) for k in range(4)], "label string, wavelength double, voxel long, value double")
    rays = spark.createDataFrame([("D", s, s) for s in range(4)], "other string, step int, voxel long")
    assert fluence_at(flu, rays).first()["value"] == 1.0
    cells = [(x, 0, 0) for x in range(6)] + [(8, 0, 0), (8, 1, 0), (9, 1, 1)]
    step = iter(range(1000))

    def keep(df):
        path = str(tmp_path / f"o{next(step)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    assert [r.n for r in object_sizes(spark.createDataFrame(cells, "i int, j int, k int"), keep).collect()] == [6, 2, 1]


def test_lags_and_power(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=120)
    lagged = [(0, s, i, float(x[i - s]) if i >= s else 0.0) for s in (0, 3, 5) for i in range(120)]
    y = [(0, i, float(x[i - 3]) if i >= 3 else 0.0) for i in range(120)]
    e = spark.createDataFrame(lagged, "component int, shift int, sample long, value double")
    best = decomposition.optimal_shift(e, spark.createDataFrame(y, "component int, sample long, value double"))
    assert best.first()["shift"] == 3
    moved = decomposition.shift_by_optimal(spark.createDataFrame(y, "component int, sample long, value double"), best)
    got = [r.value for r in moved.orderBy("sample").collect()]
    assert got[:117] == pytest.approx(list(x[:117])) and got[117:] == [0, 0, 0]
    power = np.repeat(np.abs(np.sin(np.arange(24))) + 0.1, 60)
    s = np.column_stack([rng.normal(size=1440) * power, rng.normal(size=(1440, 2))]) @ rng.normal(size=(3, 3))
    long = spark.createDataFrame([(f"c{j}", i, float(s[i, j])) for i in range(1440) for j in range(3)], "channel string, sample long, value double")
    target = spark.createDataFrame([(c, i, float(v)) for i in range(24) for c, v in (("y0", power[60 * i] ** 2), ("y1", rng.normal()))], "channel string, sample long, value double")
    wx, wy, wt, corr = decomposition.mspoc(long, target, 24)
    assert corr > 0.8 and wx.count() == 3
    two, ty, wt, corr = decomposition.mspoc_components(long, target, 24, 2)
    filters = lambda df: np.array([[r.weight for r in df.where(F.col("component") == k).orderBy("channel").collect()] for k in (0, 1)])
    for w in (filters(two), filters(ty)):
        assert abs(w[0] @ w[1]) < 1e-6 * np.linalg.norm(w[0]) * np.linalg.norm(w[1])
    assert corr.shape == (2,) and wt.shape == (2, 1) and corr[0] > 0.8
    with pytest.raises(ValueError):
        decomposition.mspoc_components(long, target, 24, 3)


def test_motion_pca_and_baseline(spark):
    from lumenframe.operators import motion

    rng = np.random.default_rng(9)
    n, jump = 200, np.zeros(200)
    jump[80:90] = 50 * np.sin(np.linspace(0, 3.14, 10))
    rows = [(f"c{c}", 760.0, i, i / 10, float(rng.normal() + (c + 1) * jump[i])) for c in range(4) for i in range(n)]
    ts = spark.createDataFrame(rows, "channel string, wavelength double, sample long, time double, value double")
    mask = spark.createDataFrame([(i, not 80 <= i < 90) for i in range(n)], "sample long, mask boolean")
    fixed = motion.motion_correct_pca(ts, mask, 0.9)
    assert fixed.count() == 4 * n
    sd = lambda df: df.where("sample BETWEEN 80 AND 89").groupBy("channel").agg(F.stddev_pop("value").alias("s")).agg(F.max("s")).first()[0]
    assert sd(fixed) < 0.2 * sd(ts)
    assert motion.motion_correct_pca_recurse(ts.where("sample < 70"), 10.0).count() == 280


def test_rounds_that_run_out_raise(spark):
    from lumenframe.operators.head_model import object_sizes

    cells = spark.createDataFrame([(i, 0, 0) for i in range(12)], "i int, j int, k int")
    with pytest.raises(RuntimeError):
        object_sizes(cells, lambda df: df.checkpoint(), rounds=1)
