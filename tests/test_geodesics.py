"""Distances over surfaces against closed forms: flat grids at every vertex, spheres, holes, strips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import eikonal
from lumenframe.operators import geodesics


def surface(spark, xyz, tri):
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "vertex long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(tri)], "face long, a long, b long, c long")
    return faces, vertices


def grid(n, step=1.0, keep=lambda i, j: True):
    at = lambda i, j: i * n + j
    xyz = [(i * step, j * step, 0.0) for i in range(n) for j in range(n)]
    tri = []
    for i in range(n - 1):
        for j in range(n - 1):
            if keep(i, j):
                tri += [(at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1))]
    return np.array(xyz), tri


def ids(spark, *vertices):
    return spark.createDataFrame([(v,) for v in vertices], "vertex long")


def distances(df):
    rows = sorted(df.collect())
    return np.array([np.nan if d is None else d for _, d in rows])


@pytest.mark.parametrize("source", [0, 121 * 60 + 60, 60])
def test_flat_grid_at_every_vertex(spark, source):
    xyz, tri = grid(121)
    faces, vertices = surface(spark, xyz, tri)
    got = distances(geodesics.geodesic_distance(faces, vertices, ids(spark, source), block_faces=4000))
    assert got == pytest.approx(np.linalg.norm(xyz - xyz[source], axis=1), rel=1e-6, abs=1e-9)


def test_sphere_within_three_percent(spark):
    """A hundred edges from pole to pole."""
    rings, around = 100, 120
    xyz = [(0, 0, 1.0)] + [(np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)) for t in np.pi * np.arange(1, rings) / rings for p in 2 * np.pi * np.arange(around) / around] + [(0, 0, -1.0)]
    at = lambda i, j: 1 + (i - 1) * around + j % around
    tri = [(0, at(1, j), at(1, j + 1)) for j in range(around)] + [(len(xyz) - 1, at(rings - 1, j + 1), at(rings - 1, j)) for j in range(around)]
    tri += [t for i in range(1, rings - 1) for j in range(around) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]
    xyz = np.array(xyz, float)
    faces, vertices = surface(spark, xyz, tri)
    for source in (0, at(50, 7)):
        got = distances(geodesics.geodesic_distance(faces, vertices, ids(spark, source)))
        want = np.arccos(np.clip(xyz @ xyz[source], -1, 1))
        far = want > 0
        assert np.abs(got[far] / want[far] - 1).max() < 0.03 and got[source] == 0


def test_several_sources_and_unreached_vertices(spark):
    xyz, tri = grid(11)
    both = np.r_[xyz, xyz + [100, 0, 0], [[500.0, 0, 0]]]
    faces, vertices = surface(spark, both, tri + [tuple(v + 121 for v in t) for t in tri])
    got = distances(geodesics.geodesic_distance(faces, vertices, ids(spark, 0, 120, 0), block_faces=30))
    want = np.minimum(np.linalg.norm(xyz, axis=1), np.linalg.norm(xyz - xyz[120], axis=1))
    assert got[:121] == pytest.approx(want) and np.isnan(got[121:]).all()
    assert np.isnan(distances(geodesics.geodesic_distance(faces, vertices, ids(spark)))).all()


def test_around_a_hole(spark):
    """The way bends at the hole's corner."""
    xyz, tri = grid(21, keep=lambda i, j: not (8 <= i < 12 and j < 12))
    faces, vertices = surface(spark, xyz, tri)
    got = distances(geodesics.geodesic_distance(faces, vertices, ids(spark, 0), block_faces=100))
    corner, turn = np.array([8.0, 12, 0]), np.array([12.0, 12, 0])
    assert got[20 * 21] == pytest.approx(np.linalg.norm(corner) + 4 + np.linalg.norm(xyz[20 * 21] - turn), rel=0.02)


def test_edges_only_is_shortest_path(spark):
    rng = np.random.default_rng(4)
    xyz = rng.normal(size=(60, 3))
    tri = [(i, i + 1, i + 2) for i in range(58)]
    faces, vertices = surface(spark, xyz, tri)
    want = np.full(60, np.inf)
    want[0] = 0
    for _ in range(60):
        for t in tri:
            for p, q in ((0, 1), (1, 2), (0, 2)):
                p, q = t[p], t[q]
                length = np.linalg.norm(xyz[p] - xyz[q])
                want[p], want[q] = min(want[p], want[q] + length), min(want[q], want[p] + length)
    for size, by in ((9, F.col("a")), (20_000, None)):
        got = distances(geodesics.geodesic_distance(faces, vertices, ids(spark, 0), size, by, through_faces=False))
        assert got == pytest.approx(want)


def test_too_few_rounds_raise(spark):
    xyz, tri = grid(15)
    faces, vertices = surface(spark, xyz, tri)
    with pytest.raises(RuntimeError, match="rounds"):
        geodesics.geodesic_distance(faces, vertices, ids(spark, 0), block_faces=20, rounds=2)


def test_update_never_falls_when_a_distance_grows():
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 4000, 2))
    side = lambda p, q: np.linalg.norm(p - q, axis=1)
    ab, ac, bc = side(a, b), side(a, c), side(b, c)
    da, db = rng.uniform(0, 5, 4000), rng.uniform(0, 5, 4000)
    now = eikonal.through_triangle(da, db, ab, ac, bc)
    for more in ((da + rng.uniform(0, 1, 4000), db), (da, db + rng.uniform(0, 1, 4000))):
        one = (np.abs(da - db) <= ab) & (da + db >= ab) & (np.abs(more[0] - more[1]) <= ab)
        assert one.sum() > 300 and (eikonal.through_triangle(*more, ab, ac, bc) >= now - 1e-9)[one].all()


def test_paths(spark):
    strip = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(8)], "face int, a int, b int, c int")
    down = spark.createDataFrame([(i, float(i)) for i in range(10)], "vertex int, distance double")
    starts = spark.createDataFrame([(9,), (4,), (0,)], "vertex int")
    got = {}
    for r in sorted(geodesics.geodesic_path(strip, down, starts, longest=6).collect()):
        got.setdefault(r.start, []).append(r.vertex)
    assert got == {9: [9, 7, 5, 3, 1, 0], 4: [4, 2, 0], 0: [0]}
    with pytest.raises(RuntimeError):
        geodesics.geodesic_path(strip, down, starts, longest=5)
    # of equal neighbours the smallest, and a vertex that nothing reaches stays where it is
    level = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "vertex int, distance double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "face int, a int, b int, c int")
    rows = geodesics.geodesic_path(faces, level, spark.createDataFrame([(3,), (4,)], "vertex int")).collect()
    assert sorted(map(tuple, rows)) == [(3, 0, 3), (3, 1, 1), (3, 2, 0), (4, 0, 4)]


def test_a_long_strip_is_relaxed_nearest_vertex_first():
    """No triangle is left to lower a distance, so a tighter tolerance changes nothing; a wave by wave order left 1e-8 over such a strip."""
    points = np.random.default_rng(3).normal(size=(4002, 3))
    corners = np.arange(4000)[:, None] + np.arange(3)
    lengths = np.stack([np.linalg.norm(points[corners[:, (c + 1) % 3]] - points[corners[:, (c + 2) % 3]], axis=1) for c in range(3)], 1)
    start = np.r_[0.0, np.full(4001, np.inf)]
    for faces in (True, False):
        loose, tight = (eikonal.relax(corners, lengths, start, np.array([0]), faces, t) for t in (1e-12, 1e-15))
        assert np.isfinite(loose).all() and np.abs(loose - tight).max() < 1e-9
        again = eikonal.relax(corners[::-1], lengths[::-1], start, np.array([0]), faces)
        assert np.abs(loose - again).max() < 1e-9
