"""Nearest targets over blocks, against brute force."""

import numpy as np

from lumenframe.operators import geometry, glm


def test_nearest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK_POINTS", 16)
    monkeypatch.setattr(geometry, "CHUNK_POINTS", 20)
    rng = np.random.default_rng(6)
    # on a coarse grid, so that ties and copies abound; points inside and far off
    v = np.r_[rng.integers(0, 6, (400, 3)), rng.normal(size=(300, 3))].astype(float)
    p = np.r_[rng.integers(0, 6, (60, 3)), 4 * rng.normal(size=(60, 3)) + 5].astype(float)
    vertices = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)] + [(-1, None, 0.0, 0.0)], "vertex long, x double, y double, z double")
    points = spark.createDataFrame([(f"P{i}", *map(float, x)) for i, x in enumerate(p)] + [("lost", None, 0.0, 0.0)], "label string, x double, y double, z double")
    got = {r.label: (r.vertex, r.distance) for r in geometry.snap(points, vertices, 0.05).collect()}
    d2 = ((p[:, None] - v[None]) ** 2).sum(2)
    assert got.pop("lost") == (None, None)
    assert got == {f"P{i}": (int(d.argmin()), float(np.sqrt(d.min()))) for i, d in enumerate(d2)}
    assert geometry.snap(points, vertices.where("vertex < 0")).count() == 0


def test_closest_short_channel_makes_no_pairs(spark):
    rows = [(f"C{i}", float(i % 7), float(i % 3), 0.0) for i in range(100)]
    mid = spark.createDataFrame(rows, "channel string, x double, y double, z double")
    found = glm.closest_short_channel(mid.where("channel < 'C5'"), mid.where("channel >= 'C5'"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    short = [r for r in rows if r[0] >= "C5"]
    want = {a[0]: min((sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)), b[0]) for b in short)[1] for a in rows if a[0] < "C5"}
    assert {r.channel: r.short_channel for r in found.collect()} == want
