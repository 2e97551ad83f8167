"""Order of a handful of landmarks in space."""

from __future__ import annotations

import numpy as np


def along_line(start: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, share of the way): each step goes to the nearest point not yet visited; the way ends at 1."""
    at, left, order, steps = np.asarray(start, float), np.ones(len(points), bool), [], []
    while left.any():
        d = np.where(left, np.linalg.norm(points - at, axis=1), np.inf)
        k = int(d.argmin())
        left[k], at = False, points[k]
        order.append(k)
        steps.append(d[k])
    way = np.cumsum(steps)
    return points[order], way / way[-1] if len(way) and way[-1] > 0 else way


def order_six(points: np.ndarray, close_pair_at: str) -> dict[str, int]:
    """Row of Nz, Iz, RPA, LPA and Cz among six points, of which the two closest lie at Nz or at Iz.

    The point farthest from that pair is the opposite end; Cz is the one nearest to the plane through
    the three; the others are told apart by their side of the plane of Nz, Iz and Cz.
    """
    if np.shape(points) != (6, 3) or close_pair_at not in ("Nz", "Iz"):
        raise ValueError("six points in space and the label Nz or Iz are needed")
    p = np.asarray(points, float)
    d = np.linalg.norm(p[:, None] - p, axis=2)
    i, j = np.triu_indices(6, 1)
    k = int(d[i, j].argmin())
    near, twin = int(i[k]), int(j[k])
    far = int(d[near].argmax())
    normal = np.cross(p[near] - p[far], p[twin] - p[far])
    others = [q for q in range(6) if q not in (near, twin, far)]
    top = min(others, key=lambda q: abs((p[q] - p[near]) @ normal))
    front, back = (near, far) if close_pair_at == "Nz" else (far, near)
    side = np.cross(p[front] - p[top], p[back] - p[top])
    right, left = sorted((q for q in others if q != top), key=lambda q: (p[q] - p[top]) @ side)
    return {"Nz": front, "Iz": back, "RPA": right, "LPA": left, "Cz": top}
