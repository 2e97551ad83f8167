"""Surfaces from volumes: closed, of the right area and volume, turned outwards, also at borders and touching voxels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import geometry, surfaces


def volume(spark, values):
    return spark.createDataFrame([(*map(int, p), float(values[tuple(p)])) for p in np.argwhere(values != 0)], "i int, j int, k int, value double")


def measures(faces, vertices):
    """(Euler number, area, enclosed volume), and that every edge has two faces that run along it in opposite directions."""
    t, v = faces.collect(), {r.vertex: np.array([r.x, r.y, r.z]) for r in vertices.collect()}
    assert len(v) == vertices.count()
    directed = [(f[p], f[q]) for f in t for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]
    assert len(set(directed)) == len(directed) and set(directed) == {(b, a) for a, b in directed}
    edges = len(directed) // 2
    cross = [np.cross(v[f.b] - v[f.a], v[f.c] - v[f.a]) for f in t]
    return len(v) - edges + len(t), sum(np.linalg.norm(c) for c in cross) / 2, sum(float(v[f.a] @ c) for f, c in zip(t, cross, strict=True)) / 6


def test_sphere(spark):
    """From a field that falls with the distance: area and volume within two percent."""
    n, r = 27, 9.3
    d = np.linalg.norm(np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1) - np.array([13.1, 12.8, 13.4]), axis=-1)
    faces, vertices = surfaces.isosurface(volume(spark, np.clip((r + 3 - d) / 6, 0, 1)))
    euler, area, inside = measures(faces, vertices)
    assert euler == 2 and area == pytest.approx(4 * np.pi * r**2, rel=0.02) and inside == pytest.approx(4 / 3 * np.pi * r**3, rel=0.02)
    far = vertices.select(F.sqrt((F.col("x") - 13.1) ** 2 + (F.col("y") - 12.8) ** 2 + (F.col("z") - 13.4) ** 2).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert far[0] > r - 0.1 and far[1] < r + 0.1


@pytest.mark.parametrize("shape, euler", [("voxel", 2), ("corner", 2), ("ring", 0), ("two", 4), ("hollow", 4)])
def test_topology(spark, shape, euler):
    a = np.zeros((7, 7, 7))
    if shape == "voxel":
        a[3, 3, 3] = 1
    elif shape == "corner":
        a[0, 0, 0] = a[0, 0, 1] = 1  # where the volume ends
    elif shape == "ring":
        a[1:6, 1:6, 3] = 1
        a[2:5, 2:5, 3] = 0
    elif shape == "two":
        a[1, 1, 1] = a[5, 5, 5] = 1
    else:
        a[1:6, 1:6, 1:6] = 1
        a[3, 3, 3] = 0
    got, _, inside = measures(*surfaces.isosurface(volume(spark, a)))
    assert got == euler and inside > 0


def test_random_volumes_are_closed(spark):
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5):
        a = (rng.random((6, 6, 6)) < share) * rng.uniform(0.3, 1, (6, 6, 6))
        faces, vertices = surfaces.isosurface(volume(spark, a), 0.5)
        e = geometry.edges(faces)
        assert e.where("n % 2 = 1").count() == 0 and vertices.count() == faces.select(F.explode(F.array("a", "b", "c"))).distinct().count()


def test_segments_and_empty_volumes(spark):
    cells = spark.createDataFrame([(1, 1, 1, "gm", 1), (1, 1, 2, "wm", 2), (4, 4, 4, "csf", 3)], "i int, j int, k int, seg_type string, label int")
    faces, vertices = surfaces.surface_of_segments(cells, ["gm", "wm"], 2)
    assert measures(faces, vertices)[0] == 2 and vertices.agg(F.max("x")).first()[0] < 2
    faces, vertices = surfaces.isosurface(cells.where("i > 9").select("i", "j", "k", F.lit(1.0).alias("value")))
    assert faces.count() == vertices.count() == 0
