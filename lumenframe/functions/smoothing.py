"""Smoothing splines with chosen knots: cubic B-splines by banded least squares, linear in the number of points.

Knots are added where the squared residual is largest until it is at most the target; the jumps of the third
derivative at the knots are then penalised as far as the target allows, so the residual comes to the target.
"""

from __future__ import annotations

import numpy as np

DEGREE = 3


def basis(x: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of four coefficients, the values of their B-splines) at each point."""
    at = np.clip(np.searchsorted(knots, x, "right") - 1, DEGREE, len(knots) - DEGREE - 2)
    values = np.zeros((len(x), DEGREE + 1))
    values[:, 0] = 1.0
    for d in range(1, DEGREE + 1):
        saved = np.zeros(len(x))
        for r in range(d):
            right, left = knots[at + r + 1] - x, x - knots[at + 1 - d + r]
            part = values[:, r] / (right + left)
            values[:, r], saved = saved + right * part, left * part
        values[:, d] = saved
    return at - DEGREE, values


def jumps(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of five coefficients, their weights) of the third derivative's jump at each inner knot."""
    n = len(knots) - DEGREE - 1
    pieces = np.zeros((n - DEGREE, DEGREE + 1))  # the third derivative between knots, by the four coefficients there
    for p in range(n - DEGREE):
        c = np.eye(DEGREE + 1)
        for d in range(DEGREE, 0, -1):
            j = p + np.arange(DEGREE - d + 1, DEGREE + 1)
            c = (c[1:] - c[:-1]) * (d / (knots[j + d] - knots[j]))[:, None]
        pieces[p] = c[0]
    rows = np.zeros((n - DEGREE - 1, DEGREE + 2))
    rows[:, 1:] += pieces[1:]
    rows[:, :-1] -= pieces[:-1]
    return np.arange(len(rows)), rows


def bands(first: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of the product of a banded matrix's transpose with itself the diagonals 0 to DEGREE + 1 below the main one."""
    out = np.zeros((DEGREE + 2, n))
    for a in range(rows.shape[1]):
        for b in range(a, rows.shape[1]):
            out[b - a] += np.bincount(first + a, rows[:, a] * rows[:, b], n)[:n]
    return out


def solve(band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of a symmetric positive system of a few diagonals, by Cholesky."""
    width, n = band.shape
    low = np.vstack([band.T, np.zeros((width, width))])
    low[:n, 0] += 1e-12 * max(float(band[0].max(initial=0.0)), 1e-300)
    x = np.r_[rhs, np.zeros(width)]
    for j in range(n):  # row j holds the column below the diagonal
        low[j] /= np.sqrt(max(low[j, 0], 1e-300))
        x[j] /= low[j, 0]
        column = low[j, 1:]
        x[j + 1 : j + width] -= column * x[j]
        for a in range(1, width):
            low[j + a, : width - a] -= column[a - 1] * low[j, a:]
    for j in range(n - 1, -1, -1):
        x[j] = (x[j] - low[j, 1:] @ x[j + 1 : j + width]) / low[j, 0]
    return x[:n]


def _more_knots(x: np.ndarray, inner: np.ndarray, squares: np.ndarray, count: int) -> np.ndarray:
    """inner with up to count new knots, each at the middle point of the piece with the largest residual left."""
    ends = np.r_[x[0], inner, x[-1]]
    piece = np.clip(np.searchsorted(ends, x, "right") - 1, 0, len(ends) - 2)
    on = np.isin(x, inner)
    residual = np.bincount(piece, np.where(on, squares / 2, squares), len(ends) - 1) + np.bincount(np.maximum(piece - 1, 0), np.where(on, squares / 2, 0.0), len(ends) - 1)
    # points strictly inside each piece
    pieces = [(float(residual[p]), np.flatnonzero((piece == p) & ~on & (x > x[0]) & (x < x[-1]))) for p in range(len(ends) - 1)]
    new = list(inner)
    for _ in range(count):
        best = max((p for p in pieces if len(p[1])), key=lambda p: p[0], default=None)
        if best is None:
            break
        value, points = best
        pieces = [p for p in pieces if p is not best]
        middle = len(points) // 2
        new.append(float(x[points[middle]]))
        share = middle / max(len(points) - 1, 1)
        pieces += [(value * share, points[:middle]), (value * (1 - share), points[middle + 1 :])]
    return np.array(sorted(new))


def smooth_spline(x: np.ndarray, y: np.ndarray, target: float, tolerance: float = 1e-3) -> np.ndarray:
    """Values at x (ascending) of a cubic spline whose squared residual comes to target, or is that of the cubic if that is less.

    Fewer than four points are returned as they are.
    """
    x, y, m = np.asarray(x, float), np.asarray(y, float), len(x)
    if m <= DEGREE:
        return y.copy()
    inner, added, before = np.zeros(0), 1, np.inf
    while True:
        knots = np.r_[[x[0]] * (DEGREE + 1), inner, [x[-1]] * (DEGREE + 1)]
        first, values = basis(x, knots)
        n = len(knots) - DEGREE - 1
        normal = bands(first, values, n)
        rhs = sum(np.bincount(first + a, values[:, a] * y, n)[:n] for a in range(DEGREE + 1))
        curve = lambda c: (values * c[first[:, None] + np.arange(DEGREE + 1)]).sum(1)  # noqa: B023, E731
        fit = curve(solve(normal, rhs))
        residual = float(((y - fit) ** 2).sum())
        if residual <= target * (1 + tolerance) or len(inner) >= m - DEGREE - 1:
            break
        gained = before - residual
        guess = 2 * added if not np.isfinite(before) or gained <= tolerance * target else int(min(added * (residual - target) / gained, 2 * added))
        added = 1 if not len(inner) else max(min(2 * added, max(guess, added // 2, 1)), 1)
        before = residual
        more = _more_knots(x, inner, (y - fit) ** 2, min(added, m - DEGREE - 1 - len(inner)))
        if len(more) == len(inner):
            break
        inner = more if len(more) < m - DEGREE - 1 else x[2:-2]  # as many as that interpolate
    if not len(inner) or residual >= target * (1 - tolerance):
        return fit
    penalty = bands(*jumps(knots), n)
    scale = max(float(normal[0].max()), 1e-300) / max(float(penalty[0].max()), 1e-300)
    low, high = -14.0, 14.0
    for _ in range(60):
        middle = (low + high) / 2
        trial = curve(solve(normal + 10.0**middle * scale * penalty, rhs))
        residual = float(((y - trial) ** 2).sum())
        if residual > target:
            high = middle
        else:
            low, fit = middle, trial
        if abs(residual - target) <= tolerance * target:
            return trial
    return fit
