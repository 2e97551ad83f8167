"""Smoothing splines against dense computations and their own definition."""

import time

import numpy as np
import pytest

from lumenframe.functions import smoothing

RNG = np.random.default_rng(3)
X = np.arange(120.0)
Y = np.sin(X / 9) * 5 + RNG.normal(size=120) + (X > 60) * 8


def dense(x, knots):
    first, values = smoothing.basis(x, knots)
    out = np.zeros((len(x), len(knots) - 4))
    for a in range(4):
        out[np.arange(len(x)), first + a] += values[:, a]
    return out


def knots_of(inner, x=X):
    return np.r_[[x[0]] * 4, inner, [x[-1]] * 4]


def test_basis_sums_to_one_and_is_smooth():
    k = knots_of([10.0, 11, 40, 77])
    b = dense(X, k)
    assert b.sum(1) == pytest.approx(np.ones(120)) and (b >= -1e-12).all()
    cubic = X**3 / 1e4 - X
    c = np.linalg.lstsq(b, cubic, rcond=None)[0]
    assert b @ c == pytest.approx(cubic, abs=1e-6)
    first, rows = smoothing.jumps(k)
    assert [rows[i] @ c[f : f + 5] for i, f in enumerate(first)] == pytest.approx(np.zeros(4), abs=1e-8)  # a cubic has no jumps


def test_banded_solution_is_the_dense_one():
    k = knots_of(np.arange(5.0, 115, 7))
    b, n = dense(X, k), len(k) - 4
    first, values = smoothing.basis(X, k)
    j = np.zeros((n - 4, n))
    for i, (f, row) in enumerate(zip(*smoothing.jumps(k), strict=True)):
        j[i, f : f + 5] = row
    for weight in (0.0, 3.0, 1e4):
        want = np.linalg.solve(b.T @ b + weight * j.T @ j, b.T @ Y)
        got = smoothing.solve(smoothing.bands(first, values, n) + weight * smoothing.bands(*smoothing.jumps(k), n), b.T @ Y)
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("target", [1.0, 20.0, 119.0, 300.0])
def test_residual_comes_to_the_target(target):
    fit = smoothing.smooth_spline(X, Y, target)
    assert ((Y - fit) ** 2).sum() == pytest.approx(target, rel=2e-3)


def test_ends_of_the_range():
    cubic = np.polyval(np.polyfit(X, Y, 3), X)
    assert smoothing.smooth_spline(X, Y, 1e6) == pytest.approx(cubic, abs=1e-5)  # no knots
    assert smoothing.smooth_spline(X, Y, 0.0) == pytest.approx(Y, abs=1e-3)  # through all points
    assert list(smoothing.smooth_spline(X[:3], Y[:3], 1.0)) == list(Y[:3])
    assert smoothing.smooth_spline(X[:4], Y[:4], 1e-9) == pytest.approx(Y[:4], abs=1e-4)
    assert smoothing.smooth_spline(X, np.zeros(120), 0.0) == pytest.approx(np.zeros(120))


def test_knots_go_where_the_residual_is():
    squares = np.zeros(120)
    squares[70:80] = 1.0
    more = smoothing._more_knots(X, np.array([60.0, 90.0]), squares, 1)
    assert len(more) == 3 and 60 < more[1] < 90
    assert len(smoothing._more_knots(X[:6], np.zeros(0), np.ones(6), 50)) == 4


def test_long_segments_take_linear_time():
    x = np.arange(10_000.0)
    y = np.sin(x / 50) * 3 + RNG.normal(size=10_000)
    start = time.process_time()
    fit = smoothing.smooth_spline(x, y, 9_900.0)
    assert ((y - fit) ** 2).sum() == pytest.approx(9_900.0, rel=2e-3) and time.process_time() - start < 60
    assert np.abs(fit - np.sin(x / 50) * 3)[100:-100].mean() < 0.3
