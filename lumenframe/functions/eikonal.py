"""Distances along the triangles of one block of a surface, from those known at its vertices."""

from __future__ import annotations

import heapq
import math

import numpy as np


def through_triangle(da: np.ndarray, db: np.ndarray, ab: np.ndarray, ac: np.ndarray, bc: np.ndarray, faces: bool = True) -> np.ndarray:
    """The distance at c of triangles whose corners a and b have distances da and db.

    The triangle is laid flat; the point that has the two distances and lies beyond ab is the source. If the
    straight way from it to c crosses ab, that is the distance, otherwise the way along a side. This is exact
    on a flat surface. It does not fall when one of two distances that a single source can have grows, so distances
    that are still too long make no other one too short.
    """
    side = np.minimum(da + ac, db + bc)
    if not faces:
        return side
    with np.errstate(invalid="ignore", divide="ignore"):
        xc = (ac * ac + ab * ab - bc * bc) / (2 * ab)
        yc = np.sqrt(np.maximum(ac * ac - xc * xc, 0))
        xs = (da * da + ab * ab - db * db) / (2 * ab)
        below = da * da - xs * xs
        ys = np.sqrt(np.maximum(below, 0))
        crossing = xs + (xc - xs) * ys / (ys + yc)
        inside = (below > 0) & (crossing >= 0) & (crossing <= ab)
        return np.where(inside, np.sqrt((xc - xs) ** 2 + (yc + ys) ** 2), side)


def relax(corners: np.ndarray, lengths: np.ndarray, distance: np.ndarray, changed: np.ndarray, faces: bool = True, tolerance: float = 1e-12) -> np.ndarray:
    """Lower distances until no triangle lowers one.

    corners: three vertex numbers a face. lengths: of the sides opposite to each corner. changed: vertices whose
    triangles are to be looked at first; later only those of vertices that fell are, the nearest vertex first, so that
    a vertex seldom falls twice and a narrow front costs no more a vertex than a broad one. The distances that
    remain do not hang on the order, as no lower distance makes another one longer.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        ab, bc, ac = lengths, np.roll(lengths, -1, 1), np.roll(lengths, -2, 1)
        foot = (ac * ac + ab * ab - bc * bc) / (2 * ab)
        height = np.sqrt(np.maximum(ac * ac - foot * foot, 0))
    # flat lists, by three times the face and the corner; see through_triangle for the names
    order = np.argsort(corners.ravel(), kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(corners.ravel(), minlength=len(distance)))].tolist()
    places, ids, side, xc, yc, out = (v.ravel().tolist() for v in (order, corners, lengths, foot, height, distance))
    least = 1 - tolerance
    heap = [(out[v], v) for v in changed.tolist()]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if d > out[v]:
            continue
        for at in places[start[v] : start[v + 1]]:
            face = at - at % 3
            for turn in (1, 2):
                c = face + (at + turn) % 3
                a, b = face + (c + 1) % 3, face + (c + 2) % 3
                da, db = out[ids[a]], out[ids[b]]
                new = min(da + side[b], db + side[a])
                w = side[c]
                if faces and w and da < math.inf and db < math.inf:
                    xs = (da * da + w * w - db * db) / (2 * w)
                    below = da * da - xs * xs
                    if below > 0:
                        ys = math.sqrt(below)
                        crossing = xs + (xc[c] - xs) * ys / (ys + yc[c])
                        if 0 <= crossing <= w:
                            new = math.hypot(xc[c] - xs, yc[c] + ys)
                if new < out[ids[c]] * least - 1e-300:
                    out[ids[c]] = new
                    heapq.heappush(heap, (new, ids[c]))
    return np.array(out)
