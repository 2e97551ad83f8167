"""SNIRF files as tables, and tables as SNIRF files.

    spark.dataSource.register(SnirfSource)
    spark.read.format("snirf").option("table", "stim").load("folder or file")

Tables (option table): timeseries (default), measurements, geometry, stim, aux, tags. Files are read by byte
ranges: a task opens a file's few small groups and its share of the matrix's chunks (option splitBytes), so a
large file is read by many tasks. Labels are resolved where a chunk is read; no join follows.

A data element's columns are split by kind of data; each series has the canonical name of its kind, and
name_02, name_03, ... if the recording has it already. Of two columns for one channel and wavelength (or
chromophore and trial type) the later one counts. Errors raise when the table is read: indices below 1, a
column with neither or both of wavelength and chromophore, several units in one series, times of another
length than the matrix (two times may stand for begin and spacing), unknown data types.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..core.recording import next_name
from .files import Ranges, listed, packs, put, shares
from .hdf5 import File, Writer
from .probe import DATA_TYPE_LABELS, DATA_TYPES

# The kinds of data that may share an element, the name of their series, and the labels of each.
SERIES = {
    "processed HRF blood flow index": ("hrf_bfi", ("HRF BFi",)),
    "processed HRF central moments": ("hrf_moments", ("HRF dMean", "HRF dVar", "HRF dSkew")),
    "processed HRF concentrations": ("hrf_conc", ("HRF HbO", "HRF HbR", "HRF HbT")),
    "processed HRF dOD": ("hrf_od", ("HRF dOD",)),
    "processed absorption coefficient": ("mua", ("mua",)),
    "processed blood flow index": ("bfi", ("BFi",)),
    "processed central moments": ("moments", ("dMean", "dVar", "dSkew")),
    "processed concentrations": ("conc", ("HbO", "HbR", "HbT", "H2O", "Lipid")),
    "processed dOD": ("od", ("dOD",)),
    "processed raw": ("amp", ("RAW", "raw-DC")),
    "processed scattering coefficient": ("musp", ("musp",)),
}
RAW = "unprocessed raw"
CHROMOPHORES = {"HbO": "HbO", "HbR": "HbR", "HbT": "HbT", "Lipid": "Lipid", "HRF HbO": "HbO", "HRF HbR": "HbR", "HRF HbT": "HbT"}
# The fields of a measurement.
FIELDS = {
    "sourceIndex": "int", "detectorIndex": "int", "wavelengthIndex": "int", "wavelengthActual": "double", "wavelengthEmissionActual": "double",
    "dataType": "int", "dataUnit": "string", "dataTypeLabel": "string", "dataTypeIndex": "int", "sourcePower": "double", "detectorGain": "double",
    "moduleIndex": "int", "sourceModuleIndex": "int", "detectorModuleIndex": "int",
}
LABELS = "channel string, source string, detector string, wavelength double, chromo string"
TABLES = {
    "timeseries": f"file string, nirs int, name string, {LABELS}, trial_type string, sample long, time double, value double, unit string",
    "measurements": f"file string, nirs int, data int, name string, column int, {', '.join(f'{k} {t}' for k, t in FIELDS.items())}, {LABELS}",
    "geometry": "file string, nirs int, dim int, label string, type string, x double, y double, z double, unit string",
    "stim": "file string, nirs int, trial_type string, row int, onset double, duration double, value double, data array<double>, labels array<string>",
    "aux": "file string, nirs int, name string, aux_channel int, sample long, time double, value double, unit string, time_offset double",
    "tags": "file string, nirs int, name string, value string",
}
SPLIT_BYTES, BLOCK_CELLS = 64 << 20, 1 << 18


def kind_of(data_type: int, label: str | None) -> str:
    known = DATA_TYPES.get(data_type)
    label = label if label in DATA_TYPE_LABELS else None
    if known == "CW_AMPLITUDE" and label in (None, "raw-DC"):
        return RAW
    for kind, (_, labels) in SERIES.items():
        if known == "PROCESSED" and label in labels:
            return kind
    raise ValueError(f"no series for data type {data_type} with label {label!r}")


class Nirs:
    """The small parts of one recording of a file."""

    def __init__(self, f: File, group: int):
        self.f, self.group = f, group
        members = f.links(group)
        self.probe = members.get("probe")
        self.tags = {k: f.get(members["metaDataTags"], k) for k in f.links(members["metaDataTags"])} if "metaDataTags" in members else {}
        self.stims = [g for _, g in numbered(members, "stim")]
        self.trial_types = list(dict.fromkeys(str(f.get(g, "name")) for g in self.stims))

    def optodes(self, kind: str) -> tuple[list[str], dict[int, np.ndarray]]:
        """Labels of sources, detectors or landmarks, and their positions by dimension."""
        get = lambda name: self.f.get(self.probe, name) if self.probe is not None else None
        places = {d: np.atleast_2d(p) for d in (2, 3) if (p := get(f"{kind}Pos{d}D")) is not None and np.size(p)}
        labels = get(f"{kind}Labels")
        if labels is None:
            n = max(map(len, places.values()), default=0) if kind != "landmark" else 0
            return [f"{kind[0].upper()}{i + 1}" for i in range(n)], places
        labels = np.asarray(labels, object)
        if labels.ndim == 2:
            labels = [os.path.commonprefix([str(x) for x in row]) for row in labels]
            if len(set(labels)) < len(labels):
                raise ValueError("labels have no unique common prefixes")
        return [str(x) for x in np.atleast_1d(labels)], places

    def wavelengths(self) -> np.ndarray:
        return np.atleast_1d(self.f.get(self.probe, "wavelengths", [])) if self.probe is not None else np.empty(0)

    def measurements(self, data: int) -> list[dict]:
        members = self.f.links(data)
        if "measurementLists" in members:
            lists = {k: np.atleast_1d(self.f.get(members["measurementLists"], self._plural(k))) for k in FIELDS if self._plural(k) in self.f.links(members["measurementLists"])}
            rows = [{k: v[i] for k, v in lists.items()} for i in range(max(map(len, lists.values()), default=0))]
        else:
            rows = [{k: self.f.get(g, k) for k in FIELDS} for _, g in numbered(members, "measurementList")]
        cast = {"int": int, "double": float, "string": str}
        rows = [{k: None if r.get(k) is None else cast[t](r[k]) for k, t in FIELDS.items()} for r in rows]
        sources, detectors, waves = self.optodes("source")[0], self.optodes("detector")[0], self.wavelengths()
        for r in rows:
            if r["sourceIndex"] < 1 or r["detectorIndex"] < 1:
                raise ValueError("a measurement's source or detector index is below 1")
            r["source"], r["detector"] = sources[r["sourceIndex"] - 1], detectors[r["detectorIndex"] - 1]
            r["channel"] = r["source"] + r["detector"]
            r["wavelength"] = None if r["wavelengthIndex"] in (None, -1) else float(waves[r["wavelengthIndex"] - 1])
            r["chromo"] = CHROMOPHORES.get(r["dataTypeLabel"])
            r["kind"] = kind_of(r["dataType"], r["dataTypeLabel"])
        return rows

    @staticmethod
    def _plural(field: str) -> str:
        return field.replace("Index", "Indices") if field.endswith("Index") else f"{field}s"

    def series(self) -> Iterator[tuple[int, int, list[dict], list[tuple[str, list[int]]]]]:
        """(number, group, measurements, [(name, columns)]) of each data element."""
        taken: set[str] = set()
        for number, data in numbered(self.f.links(self.group), "data"):
            rows, out = self.measurements(data), []
            for kind in sorted({r["kind"] for r in rows}):
                mine = {}
                columns = [i for i, r in enumerate(rows) if r["kind"] == kind]
                self._check([rows[i] for i in columns])
                hrf = "HRF" in kind and any(rows[i]["dataTypeIndex"] is not None for i in columns)
                for i in columns:
                    r = rows[i]
                    r["trial_type"] = self.trial_types[r["dataTypeIndex"] - 1] if hrf else None
                    mine[r["channel"], r["wavelength"], r["chromo"], r["trial_type"]] = i
                name = next_name("amp" if kind == RAW else SERIES[kind][0], taken)
                taken.add(name)
                out.append((name, sorted(mine.values())))
            yield number, data, rows, out

    @staticmethod
    def _check(rows: list[dict]) -> None:
        waves, chromos = any(r["wavelength"] is not None for r in rows), any(r["chromo"] is not None for r in rows)
        if waves == chromos:
            raise ValueError("columns have neither wavelength nor chromophore" if not waves else "columns have both wavelengths and chromophores")
        if len({r["dataUnit"] for r in rows}) > 1:
            raise ValueError("columns of one series have several units")

    def times(self, group: int, n: int) -> np.ndarray:
        t = np.asarray(self.f.get(group, "time"), float).reshape(-1)
        if len(t) == 2 and n != 2:
            return t[0] + t[1] * np.arange(n)
        if len(t) != n:
            raise ValueError("length of time and dataTimeSeries differ")
        return t


def numbered(members: dict[str, int], name: str) -> list[tuple[int, int]]:
    """(number, group) of name, name1, name2, ..., in order; name alone is number 1."""
    found = [(int(k[len(name) :] or 1), to) for k, to in members.items() if k.startswith(name) and (k == name or k[len(name) :].isdigit())]
    return sorted(found)


class Share(InputPartition):
    def __init__(self, file: str, k: int, n: int):
        self.file, self.k, self.n = file, k, n


class Shares(InputPartition):
    """Shares of files that one task reads."""

    def __init__(self, shares: list[Share]):
        self.shares = shares


class SnirfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "timeseries")
        self.path, self.split = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self) -> list[Shares]:
        sizes = dict(listed(self.path, ".snirf"))
        parts = [Share(*s) for s in shares(self.path, self.split, ".snirf") if self.table in ("timeseries", "aux") or s[1] == 0]
        return [Shares(p) for p in packs(parts, [sizes[s.file] // s.n for s in parts])]

    def read(self, part: Shares) -> Iterator:
        for share in part.shares:
            r = Ranges(share.file)
            f = File(r.read, r.size)
            for number, group in numbered(f.links(f.root), "nirs"):
                yield from getattr(self, self.table)(share, number, Nirs(f, group))

    def timeseries(self, share: Share, number: int, nirs: Nirs) -> Iterator[pa.RecordBatch]:
        schema = pa_schema("timeseries")
        for _, data, rows, series in nirs.series():
            d = nirs.f.dataset(nirs.f.links(data)["dataTimeSeries"])
            n, step = d.shape[0], d.layout[1][0] if d.layout[0] == "chunked" else 4096
            times, units = nirs.times(data, n), -(-n // step)
            a, b = (min(units * k // share.n * step, n) for k in (share.k, share.k + 1))
            rows_at_once = max(step, BLOCK_CELLS // max(len(rows), 1) // step * step)
            for s in range(a, b, rows_at_once):
                upto = min(s + rows_at_once, b)
                block = nirs.f.values(d, s, upto).reshape(upto - s, -1).astype(float)
                for name, columns in series:
                    pick = pa.array(np.repeat(np.arange(len(columns)), upto - s))
                    text = lambda k, t=pa.string(): pa.array([rows[i][k] for i in columns], t).take(pick)  # noqa: B023, E731
                    m = len(pick)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([share.file] * m), pa.array(np.full(m, number, np.int32)), pa.array([name] * m), text("channel"), text("source"), text("detector"), text("wavelength", pa.float64()), text("chromo"), text("trial_type"),
                         pa.array(np.tile(np.arange(s, upto), len(columns))), pa.array(np.tile(times[s:upto], len(columns))), pa.array(block[:, columns].T.reshape(-1)), text("dataUnit")], schema=schema)

    def measurements(self, share: Share, number: int, nirs: Nirs) -> Iterator[tuple]:
        for data, _, rows, series in nirs.series():
            of = {r["kind"]: name for name, columns in series for r in [rows[columns[0]]]}
            for i, r in enumerate(rows):
                yield (share.file, number, data, of[r["kind"]], i + 1, *[r[k] for k in FIELDS], r["channel"], r["source"], r["detector"], r["wavelength"], r["chromo"])

    def geometry(self, share: Share, number: int, nirs: Nirs) -> Iterator[tuple]:
        for kind in ("source", "detector", "landmark"):
            labels, places = nirs.optodes(kind)
            for dim, at in places.items():
                if len(labels) < len(at):
                    raise ValueError("a position has no label")
                for label, p in zip(labels, at.tolist(), strict=False):
                    yield share.file, number, dim, label, kind, p[0], p[1], p[2] if dim == 3 else None, nirs.tags.get("LengthUnit")

    def stim(self, share: Share, number: int, nirs: Nirs) -> Iterator[tuple]:
        for g in nirs.stims:
            data = np.asarray(nirs.f.get(g, "data", np.zeros((0, 3))), float)
            labels = nirs.f.get(g, "dataLabels")
            labels = None if labels is None else [str(x) for x in np.atleast_1d(labels)]
            for i, row in enumerate(data.reshape(-1, data.shape[-1]).tolist()):
                yield share.file, number, str(nirs.f.get(g, "name")), i, *row[:3], row, labels

    def aux(self, share: Share, number: int, nirs: Nirs) -> Iterator[pa.RecordBatch]:
        for k, g in numbered(nirs.f.links(nirs.group), "aux"):
            if k % share.n != share.k:
                continue
            values, offset = np.asarray(nirs.f.get(g, "dataTimeSeries"), float), nirs.f.get(g, "timeOffset")
            n = np.size(nirs.f.get(g, "time"))
            values = values.reshape(-1, 1) if values.ndim < 2 else values.T if values.shape[1] == n and values.shape[0] != n else values
            times, (n, c) = nirs.times(g, len(values)), values.shape
            m = n * c
            yield pa.RecordBatch.from_arrays(
                [pa.array([share.file] * m), pa.array(np.full(m, number, np.int32)), pa.array([str(nirs.f.get(g, "name"))] * m), pa.array(np.repeat(np.arange(c, dtype=np.int32), n)), pa.array(np.tile(np.arange(n), c)), pa.array(np.tile(times, c)), pa.array(values.T.reshape(-1)),
                 pa.array([str(nirs.f.get(g, "dataUnit", "1"))] * m), pa.array([None if offset is None else float(offset)] * m, pa.float64())], schema=pa_schema("aux"))

    def tags(self, share: Share, number: int, nirs: Nirs) -> Iterator[tuple]:
        for k, v in nirs.tags.items():
            yield share.file, number, k, str(v)


def pa_schema(table: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in TABLES[table].split(", ")])


class SnirfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snirf"

    def schema(self) -> str:
        table = self.options.get("table", "timeseries")
        if table not in TABLES:
            raise ValueError(f"a SNIRF file has the tables {', '.join(TABLES)}, but not {table!r}")
        return TABLES[table]

    def reader(self, schema) -> SnirfReader:
        return SnirfReader({k.lower() if k.lower() == "splitbytes" else k: v for k, v in self.options.items()})


def read_snirf(spark, path: str) -> dict[str, DataFrame]:
    """All tables of the files below path."""
    spark.dataSource.register(SnirfSource)
    return {t: spark.read.format("snirf").option("table", t).load(path) for t in TABLES}


#: What a written series is, by the begin of its name.
WRITTEN = ("amp", "od", "conc", "hrf")
#: Rows of a matrix that are compressed together.
CHUNK_ROWS = 1024


def _measurement(name: str, m: dict, heads: dict) -> dict:
    """The fields of one column of a series."""
    hrf, chromo = name.startswith("hrf"), m.get("chromo")
    out = {"sourceIndex": heads["source"].index(m["source"]) + 1, "detectorIndex": heads["detector"].index(m["detector"]) + 1, "dataType": 1 if name.startswith("amp") else 99999}
    if not name.startswith("amp"):
        out["dataTypeLabel"] = f"HRF {chromo}" if hrf and chromo else "HRF dOD" if hrf else chromo or "dOD"
    if m.get("wavelength") is not None:
        out["wavelengthIndex"] = heads["wavelength"].index(m["wavelength"]) + 1
    if hrf:
        out["dataTypeIndex"] = [s["trial_type"] for s in heads["stim"]].index(m["trial_type"]) + 1
    return out | ({"dataUnit": m["unit"]} if m.get("unit") else {})


class _FileWriter:
    """One file from its rows in order."""

    def __init__(self):
        self.w, self.nirs, self.elements = Writer(), {}, {}

    def head(self, number: int, h: dict) -> None:
        w, probe = self.w, {"wavelengths": self.w.dataset(np.array(h["wavelength"], float))}
        for kind in ("source", "detector", "landmark"):
            points = {p["label"]: p for p in h["points"] if p["type"] == kind}
            labels = h[kind] if kind != "landmark" else sorted(points)
            if labels:
                probe[f"{kind}Labels"] = w.dataset(labels)
            if points:
                probe[f"{kind}Pos3D"] = w.dataset(np.array([[points.get(x, {}).get(c) if points.get(x, {}).get(c) is not None else np.nan for c in "xyz"] for x in labels], float))
        self.elements = {"probe": w.group(probe), "metaDataTags": w.group({k: w.dataset(v) for k, v in h["tags"].items()})}
        for i, s in enumerate(h["stim"]):
            self.elements[f"stim{i + 1}"] = w.group({"name": w.dataset(s["trial_type"]), "data": w.dataset(np.array(s["rows"], float))})
        self.nirs[f"nirs{number}"], self.heads = self.elements, h

    def matrix(self, rows: Iterator[tuple], n: int) -> tuple[int, np.ndarray]:
        """(dataset, times) of rows (time, columns, values)."""
        times = []

        def blocks():
            block = np.full((CHUNK_ROWS, n), np.nan)
            at = 0
            for time, columns, values in rows:
                times.append(time)
                block[at, columns] = values
                at += 1
                if at == CHUNK_ROWS:
                    yield block
                    block, at = np.full((CHUNK_ROWS, n), np.nan), 0
            if at:
                yield block[:at]

        return self.w.chunked(blocks(), CHUNK_ROWS, n), np.array(times, float)

    def series(self, name: str, columns: list[dict], rows: Iterator[tuple]) -> None:
        w = self.w
        to, times = self.matrix(rows, len(columns))
        lists = {f"measurementList{i + 1}": w.group({k: w.dataset(v) for k, v in _measurement(name, m, self.heads).items()}) for i, m in enumerate(columns)}
        number = sum(k.startswith("data") for k in self.elements) + 1
        self.elements[f"data{number}"] = w.group({"dataTimeSeries": to, "time": w.dataset(times)} | lists)

    def aux(self, name: str, about: dict, rows: Iterator[tuple]) -> None:
        w = self.w
        to, times = self.matrix(rows, about["n"])
        fields = {"name": w.dataset(name), "dataTimeSeries": to, "time": w.dataset(times)}
        fields |= {"dataUnit": w.dataset(about["unit"])} if about.get("unit") else {}
        fields |= {"timeOffset": w.dataset(float(about["time_offset"]))} if about.get("time_offset") is not None else {}
        number = sum(k.startswith("aux") for k in self.elements) + 1
        self.elements[f"aux{number}"] = w.group(fields)

    def finish(self) -> list[bytes]:
        return self.w.finish({"formatVersion": self.w.dataset("1.1")} | {k: self.w.group(v) for k, v in self.nirs.items()})


def _write(path: str):
    """(file, size) of files from rows (file, nirs, stage, name, sample, time, columns, values, head) in order."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            small = [batch.column(c).to_pylist() for c in ("file", "nirs", "stage", "name", "sample", "time", "head")]
            columns, values = batch.column("columns"), batch.column("values")
            at, to = (np.asarray(x.offsets).tolist() for x in (columns, values))
            columns, values = np.asarray(columns.values), np.asarray(values.values)
            for i, row in enumerate(zip(*small, strict=True)):
                yield row, columns[at[i] : at[i + 1]], values[to[i] : to[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file, out = cells(batches), None, None
        held = next(stream, None)

        def following(key):
            nonlocal held
            while (held := next(stream, None)) is not None and held[0][:4] == key and held[0][6] is None:
                yield held[0][5], held[1], held[2]

        def done():
            size = put(f"{path}/{file}.snirf", out.finish())
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64())], names=["file", "size"])

        while held is not None:
            row = held[0]
            if row[0] != file:
                if file is not None:
                    yield done()
                file, out = row[0], _FileWriter()
            about = json.loads(row[6])
            if row[2] == 0:
                out.head(row[1], about)
                held = next(stream, None)
            elif row[2] == 1:
                out.series(row[3], about["columns"], following(row[:4]))
            else:
                out.aux(row[3], about, following(row[:4]))
        if file is not None:
            yield done()

    return run


def write_snirf(path: str, series: DataFrame, geometry: DataFrame | None = None, stim: DataFrame | None = None, aux: DataFrame | None = None, tags: DataFrame | None = None) -> int:
    """Write one file for each value of file, below path; how many there were.

    series: file, nirs, name (begins with amp, od, conc or hrf), channel, source, detector, wavelength or chromo,
    [trial_type,] sample, time, value[, unit]. geometry: file, nirs, label, type, x, y, z. stim: file, nirs,
    trial_type, onset, duration, value. aux: file, nirs, name, aux_channel, sample, time, value[, unit,
    time_offset]. tags: file, nirs, name, value. Cells that a series lacks become NaN. A task streams a file's
    rows in order and holds one block of them and what is compressed.
    """
    key, spark = ["file", "nirs"], series.sparkSession
    with_all = lambda df, **kinds: df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})
    series = with_all(series, wavelength="double", chromo="string", trial_type="string", unit="string")
    named = F.coalesce(*[F.when(F.startswith("name", F.lit(k)), F.col("name")) for k in WRITTEN])
    series = series.withColumn("name", F.coalesce(named, F.raise_error(F.concat(F.lit("no SNIRF type for the series "), "name")).cast("string")))
    labels = ["trial_type", "channel", "source", "detector", "wavelength", "chromo"]
    columns = series.groupBy(*key, "name", *labels).agg(F.min("unit").alias("unit"))
    columns = columns.withColumn("column", F.row_number().over(Window.partitionBy(*key, "name").orderBy(*labels)) - 1)
    about = columns.groupBy(*key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", *labels, "unit"))), lambda c: c.dropFields("column")).alias("columns"))

    def rows(df: DataFrame, stage: int, name, sample, time, cols, values, head) -> DataFrame:
        return df.select(*key, F.lit(stage).alias("stage"), F.lit(name).alias("name") if name == "" else F.col("name"), sample.cast("long").alias("sample"), time.cast("double").alias("time"), cols.cast("array<int>").alias("columns"), values.cast("array<double>").alias("values"), head.cast("string").alias("head"))

    none = F.lit(None)
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*key, "name", *labels]])
    cells = series.alias("s").join(columns.alias("c"), same).select(*[F.col(f"s.{c}") for c in [*key, "name", "sample", "time", "value"]], "c.column")
    packed = cells.groupBy(*key, "name", "sample").agg(F.min("time").alias("time"), F.collect_list(F.struct("column", F.coalesce("value", F.lit(float("nan"))).alias("value"))).alias("x"))
    parts = [rows(about, 1, "name", F.lit(-1), none, none, none, F.to_json(F.struct("columns"))), rows(packed, 1, "name", F.col("sample"), F.col("time"), F.col("x.column"), F.col("x.value"), none)]

    heads = columns.groupBy(*key).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("source", "detector", "wavelength")])
    some = lambda df, value, name: df.groupBy(*key).agg(value.alias(name))
    extra = []
    if geometry is not None:
        extra.append(some(geometry.where("type IN ('source', 'detector', 'landmark')"), F.collect_list(F.struct("label", "type", "x", "y", "z")), "points"))
    if stim is not None:
        one = stim.groupBy(*key, "trial_type").agg(F.array_sort(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("onset", "duration", "value")]))).alias("rows"))
        extra.append(some(one, F.array_sort(F.collect_list(F.struct(F.element_at("rows", 1)[0].alias("first"), "trial_type", "rows"))), "stim"))
    if tags is not None:
        extra.append(some(tags, F.map_from_entries(F.collect_list(F.struct("name", "value"))), "tags"))
    for e in extra:
        heads = heads.join(e, key, "left")
    lack = {"points": F.array().cast("array<string>"), "stim": F.array().cast("array<string>"), "tags": F.create_map().cast("map<string,string>")}
    heads = heads.select(*key, "source", "detector", "wavelength", *[F.coalesce(F.col(c), empty_of(c, heads)).alias(c) if c in heads.columns else v.alias(c) for c, v in lack.items()])
    parts.append(rows(heads, 0, "", F.lit(-1), none, none, none, F.to_json(F.struct("source", "detector", "wavelength", "points", "stim", "tags"))))
    if aux is not None:
        aux = with_all(aux, unit="string", time_offset="double")
        of = aux.groupBy(*key, "name").agg((F.max("aux_channel") + 1).alias("n"), F.min("unit").alias("unit"), F.min("time_offset").alias("time_offset"))
        parts.append(rows(of, 2, "name", F.lit(-1), none, none, none, F.to_json(F.struct("n", "unit", "time_offset"))))
        each = aux.groupBy(*key, "name", "sample").agg(F.min("time").alias("time"), F.collect_list(F.struct("aux_channel", F.coalesce("value", F.lit(float("nan"))).alias("value"))).alias("x"))
        parts.append(rows(each, 2, "name", F.col("sample"), F.col("time"), F.col("x.aux_channel"), F.col("x.value"), none))
    all_rows = reduce(DataFrame.unionByName, parts).repartition("file").sortWithinPartitions(*key, "stage", "name", "sample")
    written = all_rows.mapInArrow(_write(path), "file string, size long")
    return written.agg(F.count("*"), F.sum("size")).first()[0]


def empty_of(column: str, df: DataFrame):
    """An empty array or map of the column's type."""
    return (F.create_map() if column == "tags" else F.array()).cast(df.schema[column].dataType)
