"""The 10-10 positions on a scalp surface, from lines in which planes cut it.

A plane through three points is met by a face whose corners lie on both sides. Spark finds those faces for all
lines of a step at once, and the segment in each, whose ends are named by the edge they lie on; a cut of F
faces has some square root of F segments. They are chained by those names to a way, along which the positions
stand at shares of its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.scratch import stored
from .geometry import corners

#: Segments that one step may bring to the driver.
MOST_SEGMENTS = 1_000_000
Line = tuple[np.ndarray, np.ndarray, np.ndarray]

# The labels of the system, the three that each line runs through, and their shares of its length.
MIDLINES = {("LPA", "Cz", "RPA"): {"T7": 0.1, "T8": 0.9}, ("Nz", "Cz", "Iz"): {"Fpz": 0.1, "AFz": 0.2, "Fz": 0.3, "FCz": 0.4, "CPz": 0.6, "Pz": 0.7, "POz": 0.8, "Oz": 0.9}}
RINGS = {
    ("Fpz", "T7", "Oz"): {"Fp1": 0.1, "AF7": 0.2, "F7": 0.3, "FT7": 0.4, "TP7": 0.6, "P7": 0.7, "PO7": 0.8, "O1": 0.9},
    ("Fpz", "T8", "Oz"): {"Fp2": 0.1, "AF8": 0.2, "F8": 0.3, "FT8": 0.4, "TP8": 0.6, "P8": 0.7, "PO8": 0.8, "O2": 0.9},
}
ROWS = {("T7", "Cz", "T8"): "C", ("FT7", "FCz", "FT8"): "FC", ("F7", "Fz", "F8"): "F", ("AF7", "AFz", "AF8"): "AF", ("TP7", "CPz", "TP8"): "CP", ("P7", "Pz", "P8"): "P", ("PO7", "POz", "PO8"): "PO"}
EIGHTHS = {5: 1 / 8, 3: 2 / 8, 1: 3 / 8, 2: 5 / 8, 4: 6 / 8, 6: 7 / 8}


def _plane(origin: np.ndarray, normal: np.ndarray, p: str) -> Column:
    return sum((F.lit(float(n)) * (F.col(f"{p}{c}") - float(o)) for c, n, o in zip("xyz", normal, origin, strict=True)), F.lit(0.0))


def plane_cut(surface: DataFrame, lines: dict[str, Line]) -> DataFrame:
    """(line, face, i1, j1, x1, y1, z1, i2, j2, x2, y2, z2): where the plane of each line's points crosses faces.

    surface: faces with corner coordinates. An end lies on the edge i < j; a corner in the plane counts as above it.
    """
    out = None
    for name, (p0, p1, p2) in lines.items():
        normal = np.cross(p2 - p0, p1 - p0)
        d = surface.withColumns({f"d{k}": _plane(p0, normal, k) for k in "abc"})
        up = {k: F.col(f"d{k}") >= 0 for k in "abc"}
        # the corner that is alone on its side
        alone = F.when((up["a"] != up["b"]) & (up["a"] != up["c"]), 0).when((up["b"] != up["a"]) & (up["b"] != up["c"]), 1).when((up["c"] != up["a"]) & (up["c"] != up["b"]), 2)
        turned = F.array(*[F.struct(*[F.struct(F.col(k).alias("v"), F.col(f"d{k}").alias("d"), *[F.col(f"{k}{c}").alias(c) for c in "xyz"]).alias(n) for k, n in zip(order, "pqr", strict=True)]) for order in ("abc", "bca", "cab")])
        d = d.withColumn("t", F.get(turned, alone)).where("t IS NOT NULL")
        ends = []
        for n, q in ((1, "q"), (2, "r")):
            share = F.col("t.p.d") / (F.col("t.p.d") - F.col(f"t.{q}.d"))
            ends += [F.least("t.p.v", f"t.{q}.v").alias(f"i{n}"), F.greatest("t.p.v", f"t.{q}.v").alias(f"j{n}")]
            ends += [(F.col(f"t.p.{c}") + share * (F.col(f"t.{q}.{c}") - F.col(f"t.p.{c}"))).alias(f"{c}{n}") for c in "xyz"]
        mine = d.select(F.lit(name).alias("line"), "face", *ends)
        out = mine if out is None else out.unionByName(mine)
    return out


def chained(ends: np.ndarray, points: np.ndarray, line: Line) -> np.ndarray:
    """The way from p0 over the side of p1 to p2: segments with names of their ends, (n, 2) and (n, 2, 3), in order."""
    p0, p1, p2 = line
    clip = np.cross(np.cross(p2 - p0, p1 - p0), p2 - p0)
    side = (points - (p0 + p2) / 2) @ clip
    keep = (side >= 0).any(1)
    ends, points, side = ends[keep].copy(), points[keep].copy(), side[keep]
    fresh = ends.max(initial=0) + 1
    for s, e in zip(*np.nonzero(side < 0), strict=True):  # the part below the line from p0 to p2 goes
        t = side[s, 1 - e] / (side[s, 1 - e] - side[s, e])
        points[s, e] = points[s, 1 - e] + t * (points[s, e] - points[s, 1 - e])
        ends[s, e], fresh = fresh, fresh + 1
    if not len(ends):
        raise ValueError("the plane does not cut the surface on that side")
    near: dict[int, list[tuple[int, int]]] = {}
    for s in range(len(ends)):
        for e in (0, 1):
            near.setdefault(int(ends[s, e]), []).append((s, e))
    loose = [x[0] for x in near.values() if len(x) == 1] or [x[0] for x in near.values()]
    s, e = min(loose, key=lambda x: float(np.linalg.norm(points[x] - p0)))
    way, used = [points[s, e]], set()
    while s not in used:
        used.add(s)
        way.append(points[s, 1 - e])
        s, e = next(((t, f) for t, f in near[int(ends[s, 1 - e])] if t not in used), (s, e))
    return np.array(way)


def at_shares(way: np.ndarray, start: np.ndarray, shares: list[float]) -> np.ndarray:
    """Points at shares of the length of the way from start on."""
    way = np.vstack([start, way])
    length = np.r_[0, np.cumsum(np.linalg.norm(np.diff(way, axis=0), axis=1))]
    return np.column_stack([np.interp(np.asarray(shares) * length[-1], length, way[:, k]) for k in range(3)])


class Landmarks1010:
    """Positions by label; lines: the ways they were found on."""

    def __init__(self, faces: DataFrame, vertices: DataFrame, landmarks: DataFrame):
        """landmarks: label, x, y, z with Nz, Iz, LPA, RPA, and Cz if it is known roughly."""
        known = landmarks.where(F.col("label").isin("Nz", "Iz", "LPA", "RPA", "Cz")).select("label", *"xyz").collect()
        self.at = {r["label"]: np.array([r["x"], r["y"], r["z"]]) for r in known}
        lacking = {"Nz", "Iz", "LPA", "RPA"} - set(self.at)
        if lacking:
            raise ValueError(f"landmarks are missing: {', '.join(sorted(lacking))}")
        self.spark, self.surface, self.vertices = faces.sparkSession, stored(corners(faces, vertices)), vertices
        self.lines: dict[tuple[str, str, str], np.ndarray] = {}

    def ways(self, lines: dict[str, Line]) -> dict[str, np.ndarray]:
        rows = plane_cut(self.surface, lines).limit(MOST_SEGMENTS + 1).collect()
        if len(rows) > MOST_SEGMENTS:
            raise ValueError(f"a cut has more than {MOST_SEGMENTS} segments")
        out = {}
        for name, line in lines.items():
            mine = [r for r in rows if r["line"] == name]
            names: dict[tuple[int, int], int] = {}
            ends = np.array([[names.setdefault((r[f"i{n}"], r[f"j{n}"]), len(names)) for n in (1, 2)] for r in mine], int).reshape(-1, 2)
            points = np.array([[[r[f"{c}{n}"] for c in "xyz"] for n in (1, 2)] for r in mine], float).reshape(-1, 2, 3)
            out[name] = chained(ends, points, line)
        return out

    def vertex(self) -> np.ndarray:
        """The top of the head: where the middle line and the line between the ears come nearest to each other."""
        if "Cz" in self.at:
            top = self.at["Cz"]
        else:
            high = self.vertices.join(F.broadcast(self.vertices.agg(F.max("z").alias("z"))), "z").agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
            top = np.array([high[c] for c in "xyz"])
        at = self.at
        along = self.ways({"a": (at["Nz"], top, at["Iz"])})["a"]
        top = at_shares(along, at["Nz"], [0.5])[0]
        across = self.ways({"r": (at["LPA"], top, at["RPA"])})["r"]
        shares = np.linspace(0.4, 0.6, 401)
        a, r = at_shares(along, at["Nz"], shares), at_shares(across, at["LPA"], shares)
        d = np.linalg.norm(r[:, None] - a[None], axis=2)
        i, j = np.unravel_index(d.argmin(), d.shape)
        return (r[i] + a[j]) / 2

    def add(self, wanted: dict[tuple[str, str, str], dict[str, float]]) -> None:
        """New positions at shares of lines through three known ones; all lines in one job."""
        lines = {",".join(k): tuple(self.at[x] for x in k) for k in wanted}
        for name, way in self.ways(lines).items():
            key = tuple(name.split(","))
            self.lines[key] = way
            self.at |= dict(zip(wanted[key], at_shares(way, lines[name][0], list(wanted[key].values())), strict=True))

    def build(self, rounds: int = 5) -> DataFrame:
        """(label, type, x, y, z) of all positions."""
        self.at["Cz"] = self.vertex()
        for _ in range(rounds):
            self.add({("LPA", "Cz", "RPA"): {"Cz": 0.5}})
            self.add({("Nz", "Cz", "Iz"): {"Cz": 0.5}})
        self.add(MIDLINES)
        self.add(RINGS)
        self.add({k: {f"{prefix}{n}": s for n, s in EIGHTHS.items()} for k, prefix in ROWS.items()})
        return self.spark.createDataFrame([(label, "landmark", *map(float, p)) for label, p in self.at.items()], "label string, type string, x double, y double, z double")
