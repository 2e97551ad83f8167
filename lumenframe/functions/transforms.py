"""Small matrices: homogeneous transforms and closed-form registrations."""

from __future__ import annotations

import math

import numpy as np


def m_trans(t) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = t
    return out


def m_scale3(s) -> np.ndarray:
    return np.diag([*s, 1.0])


def m_scale1(s: float) -> np.ndarray:
    return np.diag([s, s, s, 1.0])


def m_rot(angles) -> np.ndarray:
    """Rotation about x, then y, then z."""
    (ca, cb, cc), (sa, sb, sc) = np.cos(angles), np.sin(angles)
    rx = np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]])
    ry = np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]])
    rz = np.array([[cc, -sc, 0], [sc, cc, 0], [0, 0, 1]])
    out = np.eye(4)
    out[:3, :3] = rz @ ry @ rx
    return out


def _needs(n: int, least: int) -> None:
    if n < least:
        raise ValueError(f"at least {least} common points are needed")


def rigid(source: np.ndarray, target: np.ndarray, scale: str = "none") -> np.ndarray:
    """Least-squares rotation and translation; scale none, iso (one factor) or axes (one each, by alternation)."""
    _needs(len(source), 3)
    s = np.ones(3)
    for _ in range(200 if scale == "axes" else 1):
        moved = source * s
        a, b = moved - moved.mean(0), target - target.mean(0)
        u, d, vt = np.linalg.svd(a.T @ b)
        flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
        r = vt.T @ flip @ u.T
        if scale == "iso":
            s = np.full(3, (d * np.diag(flip)).sum() / (a**2).sum())
        elif scale == "axes":
            c, back = source - source.mean(0), b @ r
            new = (c * back).sum(0) / np.maximum((c**2).sum(0), 1e-300)
            if np.abs(new - s).max() < 1e-12:
                break
            s = new
    out = np.eye(4)
    out[:3, :3] = r @ np.diag(s)
    out[:3, 3] = target.mean(0) - out[:3, :3] @ source.mean(0)
    return out


def affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    _needs(len(source), 4)
    x, *_ = np.linalg.lstsq(np.c_[source, np.ones(len(source))], target, rcond=None)
    out = np.eye(4)
    out[:3] = x.T
    return out


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j = i, m
        dist, prev, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            slack = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (slack < dist[:m])
            dist[:m][better], prev[:m][better] = slack[better], j
            k = int(np.where(done[:m], np.inf, dist[:m]).argmin())
            delta = dist[k]
            for c in np.flatnonzero(done):
                u[row_of[c]] += delta
                v[c] -= delta
            dist[:m][~done[:m]] -= delta
            j = k
        while j != m:
            row_of[j] = row_of[prev[j]]
            j = prev[j]
    out = np.empty(n, int)
    for c in range(m):
        if row_of[c] >= 0:
            out[row_of[c]] = c
    return out


def icp(source: np.ndarray, target: np.ndarray, rounds: int = 50, mode: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """(transform, target index of each source point): assign, fit, repeat until the assignment stays."""
    t, pick = np.eye(4), None
    for _ in range(rounds):
        moved = source @ t[:3, :3].T + t[:3, 3]
        new = assignment(((moved[:, None] - target[None]) ** 2).sum(2))
        if pick is not None and (new == pick).all():
            break
        pick = new
        t = rigid(source, target[pick], mode)
    return t, pick


def angle_of(v) -> float:
    return math.atan2(v[1], v[0])
