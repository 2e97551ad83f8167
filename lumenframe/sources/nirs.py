"""Recordings in .nirs files (level 5 MAT) as tables.

    spark.dataSource.register(NirsSource)
    spark.read.format("nirs").option("table", "stim").load("folder or file")

Tables: timeseries (default), measurements (indices from 0), geometry, stim, aux. A file is one task's, as its
variables are compressed whole; small files share a task. SD3D is taken rather than SD; optodes are called S1, D1, L1 and so on with
leading zeros; each nonzero sample of a stimulus column is an event of duration 0 and value 1. Errors raise when the
table is read: positions that do not fit their number, a matrix that does not fit its times or measurements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import mat5
from .files import Ranges, listed, packs, put
from .snirf import Share, Shares

TABLES = {
    "timeseries": "file string, channel string, source string, detector string, wavelength double, sample long, time double, value double",
    "measurements": "file string, column int, sourceIndex int, detectorIndex int, wavelengthIndex int, wavelength double, channel string, source string, detector string",
    "geometry": "file string, label string, type string, x double, y double, z double, unit string",
    "stim": "file string, onset double, duration double, value double, trial_type string",
    "aux": "file string, sample long, time double, aux_channel int, value double",
}


def padded_numbers(n: int, prefix: str) -> list[str]:
    """prefix1 to prefixn, with zeros to the digits of ceil(log10(n))."""
    width = math.ceil(math.log10(n)) if n else 0
    return [f"{prefix}{i:0{width}d}" for i in range(1, n + 1)]


class Nirs:
    def __init__(self, data: bytes):
        self.v = mat5.load(data)
        self.sd = self.v["SD3D" if "SD3D" in self.v else "SD"]
        self.t = np.asarray(self.v["t"], float).reshape(-1)
        number = lambda k: int(np.asarray(self.sd[k]).reshape(-1)[0])
        self.points = {"source": (padded_numbers(number("nSrcs"), "S"), self.sd["SrcPos"]), "detector": (padded_numbers(number("nDets"), "D"), self.sd["DetPos"])}
        if "Landmarks" in self.sd:
            self.points["landmark"] = (padded_numbers(len(self.sd["Landmarks"]), "L"), self.sd["Landmarks"])
        for labels, at in self.points.values():
            if np.shape(at) != (len(labels), 3):
                raise ValueError("positions do not fit the number of optodes")
        self.waves = np.asarray(self.sd["Lambda"], float).reshape(-1)
        ml = np.asarray(self.sd["MeasList"]).astype(int)
        self.d = np.asarray(self.v["d"], float)
        if self.d.shape != (len(self.t), len(ml)):
            raise ValueError("the matrix does not fit its times and measurements")
        self.columns = [(s - 1, d - 1, w - 1, self.points["source"][0][s - 1], self.points["detector"][0][d - 1]) for s, d, _, w in ml.tolist()]

    def trial_types(self, n: int) -> list[str]:
        names = self.v.get("CondNames")
        if names is None:
            return [str(i) for i in range(1, n + 1)]
        names = [names] if isinstance(names, str) else [str(x) for x in names]
        if len(names) != n:
            raise ValueError("names of conditions do not fit the stimuli")
        return names


class NirsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "timeseries")

    def partitions(self) -> list[Shares]:
        files = listed(self.path, ".nirs")
        return [Shares(p) for p in packs([Share(f, 0, 1) for f, _ in files], [size for _, size in files])]

    def read(self, part: Shares) -> Iterator:
        for share in part.shares:
            r = Ranges(share.file)
            yield from getattr(self, self.table)(share.file, Nirs(r.read(0, r.size)))

    def timeseries(self, file: str, n: Nirs) -> Iterator[pa.RecordBatch]:
        last = {(s, d, w): i for i, (s, d, w, _, _) in enumerate(n.columns)}  # of two columns for one cell the later one counts
        m = len(n.t)
        for i in sorted(last.values()):
            _, _, w, source, detector = n.columns[i]
            same = lambda x, t=pa.string(): pa.array([x] * m, t)
            yield pa.RecordBatch.from_arrays([same(file), same(source + detector), same(source), same(detector), same(float(n.waves[w]), pa.float64()), pa.array(np.arange(m)), pa.array(n.t), pa.array(n.d[:, i])], names=["file", "channel", "source", "detector", "wavelength", "sample", "time", "value"])

    def measurements(self, file: str, n: Nirs) -> Iterator[tuple]:
        for i, (s, d, w, source, detector) in enumerate(n.columns):
            yield file, i, s, d, w, float(n.waves[w]), source + detector, source, detector

    def geometry(self, file: str, n: Nirs) -> Iterator[tuple]:
        for kind, (labels, at) in n.points.items():
            for label, p in zip(labels, np.asarray(at, float).tolist(), strict=True):
                yield file, label, kind, *p, n.sd.get("SpatialUnit")

    def stim(self, file: str, n: Nirs) -> Iterator[tuple]:
        s = np.asarray(n.v["s"], float)
        s = s.reshape(len(n.t), -1)
        for name, column in zip(n.trial_types(s.shape[1]), s.T, strict=True):
            for t in n.t[column != 0].tolist():
                yield file, t, 0.0, 1.0, name

    def aux(self, file: str, n: Nirs) -> Iterator[pa.RecordBatch]:
        if "aux" not in n.v:
            return
        a = np.asarray(n.v["aux"], float).reshape(len(n.t), -1)
        m, c = a.shape
        yield pa.RecordBatch.from_arrays([pa.array([file] * (m * c), pa.string()), pa.array(np.tile(np.arange(m), c)), pa.array(np.tile(n.t, c)), pa.array(np.repeat(np.arange(c, dtype=np.int32), m)), pa.array(a.T.reshape(-1))], names=["file", "sample", "time", "aux_channel", "value"])


class NirsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nirs"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "timeseries")]

    def reader(self, schema) -> NirsReader:
        return NirsReader(dict(self.options))


def read_nirs(spark, path: str) -> dict[str, DataFrame]:
    """All tables of the files below path."""
    spark.dataSource.register(NirsSource)
    return {t: spark.read.format("nirs").option("table", t).load(path) for t in TABLES}


def write_nirs(path: str, series: DataFrame, stim: DataFrame, positions: DataFrame, unit: str = "mm") -> int:
    """Write one file for each value of file, below path; how many. Each task packs whole recordings.

    series: file, source_index, detector_index (from 1), wavelength, sample, time, value; positions: file, type, index
    (from 1), x, y, z; stim: file, sample, trial_type. Cells that are missing become NaN.
    """
    cells = series.groupBy("file").agg(F.collect_list(F.struct("source_index", "detector_index", "wavelength", "sample", "time", "value")).alias("cells"))
    events = stim.groupBy("file").agg(F.collect_list(F.struct("sample", "trial_type")).alias("events"))
    points = positions.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("type", "index", *"xyz"))).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                c = pd.DataFrame.from_records(row.column("cells")[0].as_py())
                d = c.pivot_table(index="sample", columns=["source_index", "detector_index", "wavelength"], values="value", aggfunc="first")
                waves = sorted(set(c["wavelength"]))
                t = c.groupby("sample")["time"].min().to_numpy()
                ml = [(s, det, 1, waves.index(w) + 1) for s, det, w in d.columns]
                at = {k: [[p[x] for x in "xyz"] for p in row.column("points")[0].as_py() if p["type"] == k] for k in ("source", "detector")}
                found = row.column("events")[0].as_py() or []
                names = sorted({e["trial_type"] for e in found})
                s = np.zeros((len(t), len(names)))
                for e in found:
                    s[d.index.get_loc(e["sample"]), names.index(e["trial_type"])] = 1
                sd = {"Lambda": [waves], "SrcPos": at["source"], "DetPos": at["detector"], "nSrcs": len(at["source"]), "nDets": len(at["detector"]), "MeasList": ml}
                sd = {k: np.array(v, float) for k, v in sd.items()} | {"SpatialUnit": unit}
                size = put(f"{path}/{row.column('file')[0].as_py()}.nirs", mat5.dump({"t": t[:, None], "d": d.to_numpy(), "s": s, "SD": sd, "CondNames": names}))
                yield pa.RecordBatch.from_arrays([row.column("file"), pa.array([size], pa.int64())], names=["file", "size"])

    return cells.join(events, "file", "left").join(points, "file").mapInArrow(run, "file string, size long").agg(F.count("*")).first()[0]
