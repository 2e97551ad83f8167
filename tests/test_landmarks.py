"""Plane cuts and the 10-10 positions on an ellipsoid, against the curves of the ellipsoid itself."""

import numpy as np
import pytest

from lumenframe.operators import geometry, landmarks

AXES = np.array([75.0, 95.0, 85.0])


def ellipsoid(spark, rings=60, around=80):
    unit = [(0, 0, 1.0)] + [(np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)) for t in np.pi * np.arange(1, rings) / rings for p in 2 * np.pi * np.arange(around) / around] + [(0, 0, -1.0)]
    at = lambda i, j: 1 + (i - 1) * around + j % around
    tri = [(0, at(1, j), at(1, j + 1)) for j in range(around)] + [(len(unit) - 1, at(rings - 1, j + 1), at(rings - 1, j)) for j in range(around)]
    tri += [t for i in range(1, rings - 1) for j in range(around) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]
    xyz = np.array(unit) * AXES
    return spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(tri)], "face long, a long, b long, c long"), spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "vertex long, x double, y double, z double")


def curve(p0, p1, p2, shares):
    """Points at shares of the ellipsoid's own curve from p0 over p1 to p2, of 40,000 points."""
    n = np.cross(p2 - p0, p1 - p0)
    m, d = n * AXES, n @ p0  # the plane in the space where the ellipsoid is a unit sphere
    centre = m * d / (m @ m)
    u = np.linalg.svd(m[None])[2][1:]
    t = np.linspace(0, 2 * np.pi, 40_000)[:-1]
    ring = (centre + np.sqrt(1 - centre @ centre) * (np.cos(t)[:, None] * u[0] + np.sin(t)[:, None] * u[1])) * AXES
    start = np.linalg.norm(ring - p0, axis=1).argmin()
    ring = np.roll(ring, -start, axis=0)
    stop = np.linalg.norm(ring - p2, axis=1).argmin()
    over = np.linalg.norm(ring - p1, axis=1).argmin()
    ring = ring[: stop + 1] if over <= stop else np.vstack([ring[:1], ring[: stop - 1 : -1]])
    length = np.r_[0, np.cumsum(np.linalg.norm(np.diff(ring, axis=0), axis=1))]
    return np.column_stack([np.interp(np.asarray(shares) * length[-1], length, ring[:, k]) for k in range(3)])


def test_all_positions_within_an_edge_length(spark):
    faces, vertices = ellipsoid(spark)
    on = lambda v: np.array(v, float) / np.linalg.norm(np.array(v) / AXES)
    given = {"Nz": on([0, 1, -0.2]), "Iz": on([0, -1, -0.25]), "LPA": on([-1, 0.02, -0.3]), "RPA": on([1, 0.02, -0.3])}
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in given.items()] + [("elsewhere", 1.0, 2.0, 3.0)], "label string, x double, y double, z double")
    built = landmarks.Landmarks1010(faces, vertices, points)
    got = {r.label: np.array([r.x, r.y, r.z]) for r in built.build().collect()}
    want = dict(given, Cz=on([0, 0, 1]))
    for _ in range(8):
        want["Cz"] = curve(want["LPA"], want["Cz"], want["RPA"], [0.5])[0]
        want["Cz"] = curve(want["Nz"], want["Cz"], want["Iz"], [0.5])[0]
    rows = {k: {f"{p}{n}": s for n, s in landmarks.EIGHTHS.items()} for k, p in landmarks.ROWS.items()}
    for step in (landmarks.MIDLINES, landmarks.RINGS, rows):
        for (a, b, c), places in step.items():
            want |= dict(zip(places, curve(want[a], want[b], want[c], list(places.values())), strict=True))
    edge = geometry.average_edge_length(faces, vertices).first()[0]
    assert set(got) == set(want) and len(got) == 73
    assert max(np.linalg.norm(got[k] - want[k]) for k in want) < edge
    assert all(abs(np.linalg.norm(p / AXES) - 1) < 0.01 for p in got.values())
    assert got["C3"][0] < 0 < got["C4"][0] and got["Fz"][1] > 0 > got["Pz"][1]


def test_missing_landmarks_and_planes_raise(spark):
    faces, vertices = ellipsoid(spark, 6, 8)
    with pytest.raises(ValueError, match="Iz, RPA"):
        landmarks.Landmarks1010(faces, vertices, spark.createDataFrame([("Nz", 0.0, 1.0, 0.0), ("LPA", 1.0, 0.0, 0.0)], "label string, x double, y double, z double"))
    far = np.array([500.0, 0, 0])
    with pytest.raises(ValueError, match="does not cut"):
        landmarks.chained(np.empty((0, 2), int), np.empty((0, 2, 3)), (far, far + [0, 1, 1], far + [0, 2, 0]))


def test_cut_is_closed_and_in_the_plane(spark):
    """Every end is shared by two segments, also where the plane runs through vertices."""
    faces, vertices = ellipsoid(spark, 12, 16)
    surface = geometry.corners(faces, vertices)
    for shift in (0.0, 7.0):
        line = tuple(np.array(p, float) for p in ((0, 95, shift), (75, 0, shift), (0, -95, shift)))
        rows = landmarks.plane_cut(surface, {"l": line}).collect()
        ends = [(r[f"i{n}"], r[f"j{n}"]) for r in rows for n in (1, 2)]
        assert len(rows) >= 16 and all(ends.count(e) == 2 for e in ends)
        assert all(abs(r[f"z{n}"] - shift) < 1e-9 for r in rows for n in (1, 2))
