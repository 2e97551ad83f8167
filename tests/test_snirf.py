"""The container reader and writer, and SNIRF recordings, against arrays and tables of the tests' own."""

import math
import struct

import numpy as np
import pytest

from lumenframe.sources import files, snirf
from lumenframe.sources.hdf5 import SIGNATURE, File, Unsupported, Writer


def opened(parts):
    data = b"".join(parts)
    return File(lambda at, n: data[at : at + n], len(data))


def test_groups_and_small_datasets_come_back():
    w = Writer()
    many = {f"x{i}": w.dataset(i) for i in range(700)}  # more than a node of a node holds
    f = opened(w.finish({"many": w.group(many), "none": w.group({}), "s": w.dataset("héllo"), "l": w.dataset(["a", "", "ccc"]), "d": w.dataset(2.5), "v": w.dataset([1.0, 2.0]), "e": w.dataset(np.zeros((0, 3)))}))
    g = f.find("many")
    assert {k: f.get(g, k) for k in f.links(g)} == {f"x{i}": i for i in range(700)}
    get = lambda k: f.get(f.root, k)
    assert (get("s"), get("d"), list(get("l")), list(get("v")), get("e").shape, f.links(f.find("none"))) == ("héllo", 2.5, ["a", "", "ccc"], [1.0, 2.0], (0, 3), {})


@pytest.mark.parametrize("rows", [0, 1, 7, 100, 9001])
def test_chunked_matrix_by_any_rows(rows):
    m, w = np.random.default_rng(rows).normal(size=(rows, 3)), Writer()
    f = opened(w.finish({"m": w.chunked((m[i : i + 20] for i in range(0, rows, 20)), 20, 3)}))
    d = f.dataset(f.find("m"))
    assert d.shape == (rows, 3) and len(f.chunks(d)) == -(-rows // 20)
    for a, b in ((0, rows), (rows // 3, rows // 2), (rows, rows)):
        assert (f.values(d, a, b) == m[a:b]).all()


def test_a_share_reads_its_chunks_only():
    m, w = np.random.default_rng(1).normal(size=(4000, 10)), Writer()
    data = b"".join(w.finish({"m": w.chunked((m[i : i + 100] for i in range(0, 4000, 100)), 100, 10)}))
    got = []
    f = File(lambda at, n: got.append(n) or data[at : at + n], len(data))
    d = f.dataset(f.find("m"))
    f.values(d, 500, 600)
    assert sum(got) < len(data) / 10


def test_new_style_headers():
    """Superblock 3, version 2 object headers with compact links, a continuation, and a variable-length string."""

    def header(*messages, extra=b""):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4)

    def link(name, to):
        return 0x06, struct.pack("<BBB", 1, 0, len(name)) + name + struct.pack("<Q", to)

    number = struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
    values = header((1, struct.pack("<BBBBQ", 2, 1, 0, 1, 2)), (3, number), (8, struct.pack("<BBH", 4, 0, 16) + struct.pack("<dd", 1.5, -2.0)))
    heap = b"GCOL" + struct.pack("<B3xQ", 1, 64) + struct.pack("<HHIQ", 1, 1, 0, 3) + b"abc" + bytes(5)
    heap += bytes(64 - len(heap))
    string = header((1, struct.pack("<BBBB", 2, 0, 0, 0)), (3, struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + struct.pack("<B3BI", 0x10, 0, 0, 0, 1)), (8, struct.pack("<BBH", 3, 0, 16) + struct.pack("<IQI", 3, 1000, 1)))
    more = b"OCHK" + struct.pack("<BHB", 6, len(link(b"s", 600)[1]), 0) + link(b"s", 600)[1] + bytes(4)
    root = header(link(b"v", 400), (0x10, struct.pack("<QQ", 800, len(more))), (0x02, struct.pack("<BBQQ", 0, 0, 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF)))
    data = bytearray(1100)
    data[: 12 + 36] = SIGNATURE + struct.pack("<4B", 3, 8, 8, 0) + struct.pack("<4Q", 0, 0xFFFFFFFFFFFFFFFF, 1100, 48) + bytes(4)
    for at, part in ((48, root), (400, values), (600, string), (800, more), (1000, heap)):
        data[at : at + len(part)] = part
    f = opened([bytes(data)])
    assert list(f.get(f.root, "v")) == [1.5, -2.0] and f.get(f.root, "s") == "abc"
    dense = header((0x02, struct.pack("<BBQQ", 0, 0, 500, 0)))
    data[48 : 48 + len(dense)] = dense
    with pytest.raises(Unsupported, match="dense"):
        opened([bytes(data)]).find("v")
    with pytest.raises(Unsupported, match="signature"):
        opened([b"not such a file" * 100])


FILE_ROWS = "file string, nirs int, name string, channel string, source string, detector string, wavelength double, chromo string, trial_type string, sample long, time double, value double, unit string"


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for file in ("a", "b"):
        for nirs in (1, 2):
            for s, t in (("S1", "D1"), ("S2", "D1"), ("S2", "D3")):
                for i in range(2100 if file == "a" else 5):
                    for w in (760.0, 850.0):
                        rows.append((file, nirs, "amp", s + t, s, t, w, None, None, i, i / 10, math.sin(i + w + nirs), "V"))
                        rows.append((file, nirs, "od", s + t, s, t, w, None, None, i, i / 10, math.cos(i + w), None))
                    if i < 7:
                        for c in ("HbO", "HbR"):
                            rows.append((file, nirs, "conc", s + t, s, t, None, c, None, i, i / 10, i * 1.5, "uM"))
                            for trial in ("x", "y"):
                                rows.append((file, nirs, "hrf_conc", s + t, s, t, None, c, trial, i, i / 10, i + len(c + trial) / 7, "uM"))
    return spark.createDataFrame(rows, FILE_ROWS).repartition(4)


@pytest.fixture(scope="module")
def stim(spark):
    return spark.createDataFrame([(f, n, t, o, 1.0, 2.0) for f in "ab" for n in (1, 2) for t, o in (("y", 0.5), ("x", 1.0), ("y", 9.0))], "file string, nirs int, trial_type string, onset double, duration double, value double")


@pytest.fixture(scope="module")
def tables(spark, series, stim, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snirf"))
    geometry = spark.createDataFrame([(f, n, label, kind, x, 2.0, 3.0) for f in "ab" for n in (1, 2) for label, kind, x in (("S1", "source", 1.0), ("S2", "source", 2.0), ("D1", "detector", 4.0), ("D3", "detector", 5.0), ("Nz", "landmark", 6.0))], "file string, nirs int, label string, type string, x double, y double, z double")
    aux = spark.createDataFrame([("a", 1, "acc", c, i, i / 5, c + i / 2, "mm") for i in range(30) for c in range(3)], "file string, nirs int, name string, aux_channel int, sample long, time double, value double, unit string")
    tags = spark.createDataFrame([("a", 1, "SubjectID", "me"), ("a", 1, "LengthUnit", "mm")], "file string, nirs int, name string, value string")
    assert snirf.write_snirf(path, series, geometry, stim, aux, tags) == 2
    return path, snirf.read_snirf(spark, path)


def test_series_come_back(tables, series):
    got = {tuple(r)[1:] for r in tables[1]["timeseries"].collect()}
    want = {tuple(r)[1:] for r in series.where("file = 'a'").collect()} | {tuple(r)[1:] for r in series.where("file = 'b'").collect()}
    key = lambda rows: sorted((repr(r[:10]), round(r[10], 12), r[11]) for r in rows)
    assert key(got) == key(want)


def test_many_shares_read_the_same(spark, tables, series):
    df = spark.read.format("snirf").option("splitBytes", 20_000).load(tables[0])
    assert df.rdd.getNumPartitions() > 4
    assert df.groupBy("name").count().collect() and df.count() == series.count()
    assert df.selectExpr("sum(value) AS s").first().s == pytest.approx(series.selectExpr("sum(value) AS s").first().s)


def test_other_tables(tables, stim):
    t = tables[1]
    assert sorted(tuple(r)[1:] for r in t["stim"].select("file", "nirs", "trial_type", "onset", "duration", "value").collect()) == sorted(tuple(r)[1:] for r in stim.collect())
    ms = t["measurements"].where("file LIKE '%a.snirf' AND nirs = 1").collect()
    assert {(m.name, m.dataType, m.dataTypeLabel) for m in ms} == {("amp", 1, None), ("od", 99999, "dOD"), ("conc", 99999, "HbO"), ("conc", 99999, "HbR"), ("hrf_conc", 99999, "HRF HbO"), ("hrf_conc", 99999, "HRF HbR")}
    assert {(m.channel, m.sourceIndex, m.detectorIndex, m.wavelengthIndex) for m in ms if m.name == "amp"} == {(c, s, d, w) for c, s, d in (("S1D1", 1, 1), ("S2D1", 2, 1), ("S2D3", 2, 2)) for w in (1, 2)}
    assert {(g.label, g.type, g.x) for g in t["geometry"].collect()} == {("S1", "source", 1.0), ("S2", "source", 2.0), ("D1", "detector", 4.0), ("D3", "detector", 5.0), ("Nz", "landmark", 6.0)}
    assert {(a.aux_channel, a.sample, a.value, a.unit) for a in t["aux"].collect()} == {(c, i, c + i / 2, "mm") for i in range(30) for c in range(3)}
    assert {(r.name, r.value) for r in t["tags"].collect()} == {("SubjectID", "me"), ("LengthUnit", "mm")}


def by_hand(tmp_path, columns, wavelengths=(760.0, 850.0), data=None, times=None, labels=None):
    """A file of one recording, with these measurement fields by column."""
    w = Writer()
    n = len(columns)
    lists = {f"measurementList{i + 1}": w.group({k: w.dataset(v) for k, v in m.items()}) for i, m in enumerate(columns)}
    values = np.arange(4.0 * n).reshape(4, n) if data is None else data
    element = w.group({"dataTimeSeries": w.dataset(values), "time": w.dataset([0.0, 0.5] if times is None else times)} | lists)
    probe = w.group({"wavelengths": w.dataset(list(wavelengths)), "sourcePos3D": w.dataset(np.zeros((2, 3))), "detectorPos2D": w.dataset(np.ones((2, 2)))} | ({"sourceLabels": w.dataset(labels)} if labels is not None else {}))
    nirs = w.group({"data": element, "data2": element, "probe": probe, "metaDataTags": w.group({"TimeUnit": w.dataset("s")}), "stim1": w.group({"name": w.dataset("go"), "data": w.dataset(np.array([[1.0, 2.0, 3.0, 4.0]])), "dataLabels": w.dataset(["onset", "duration", "value", "hits"])})})
    path = f"{tmp_path}/one.snirf"
    files.put(path, w.finish({"formatVersion": w.dataset("1.0"), "nirs": nirs}))
    r = files.Ranges(path)
    f = File(r.read, r.size)
    return path, snirf.Nirs(f, f.links(f.root)["nirs"])


def column(**fields):
    return {"sourceIndex": 1, "detectorIndex": 2, "wavelengthIndex": 1, "dataType": 1} | fields


def test_names_kinds_and_generated_labels(spark, tmp_path):
    raw = [column(), column(wavelengthIndex=2), column(dataType=99999, dataTypeLabel="raw-DC", dataUnit="V"), column(dataType=99999, dataTypeLabel="dOD"), column()]
    path, nirs = by_hand(tmp_path, raw)
    named = [(name, columns) for _, _, _, s in nirs.series() for name, columns in s]
    assert named == [("od", [3]), ("amp", [2]), ("amp_02", [1, 4]), ("od_02", [3]), ("amp_03", [2]), ("amp_04", [1, 4])]  # column 4 stands for the same cell as column 0
    t = snirf.read_snirf(spark, path)
    rows = t["timeseries"].where("name = 'amp_02' AND wavelength = 760").orderBy("sample").collect()
    assert [(r.channel, r.source, r.detector, r.time, r.value) for r in rows] == [("S1D2", "S1", "D2", i / 2, 5.0 * i + 4) for i in range(4)]
    assert [tuple(r)[2:] for r in t["stim"].collect()] == [("go", 0, 1.0, 2.0, 3.0, [1.0, 2.0, 3.0, 4.0], ["onset", "duration", "value", "hits"])]
    assert {(g.label, g.dim) for g in t["geometry"].collect()} == {("S1", 3), ("S2", 3), ("D1", 2), ("D2", 2)}


@pytest.mark.parametrize("change, error", [
    ({"sourceIndex": 0}, "below 1"), ({"wavelengthIndex": -1}, "neither"), ({"dataType": 99999, "dataTypeLabel": "HbO"}, "both"), ({"dataType": 410}, "no series"),
])
def test_wrong_measurements_raise(tmp_path, change, error):
    with pytest.raises(ValueError, match=error):
        list(by_hand(tmp_path, [column(**change)])[1].series())


def test_other_errors_raise(tmp_path):
    with pytest.raises(ValueError, match="several units"):
        list(by_hand(tmp_path, [column(dataUnit="V"), column(wavelengthIndex=2, dataUnit="mV")])[1].series())
    _, nirs = by_hand(tmp_path, [column()], times=[0.0, 1.0, 2.0])
    with pytest.raises(ValueError, match="differ"):
        nirs.times(next(nirs.series())[1], 4)
    assert by_hand(tmp_path, [column()], labels=np.array([["ab1", "ab2"], ["cd1", "cd2"]]))[1].optodes("source")[0] == ["ab", "cd"]
    with pytest.raises(ValueError, match="unique"):
        by_hand(tmp_path, [column()], labels=np.array([["ab1", "ab2"], ["ab3", "ab4"]]))[1].optodes("source")


def test_series_without_a_type_raise(spark, series, tmp_path):
    with pytest.raises(Exception, match="no SNIRF type"):
        snirf.write_snirf(str(tmp_path), series.where("file = 'b'").limit(3).replace({"amp": "what", "od": "what", "conc": "what", "hrf_conc": "what"}, subset=["name"]))
    with pytest.raises(Exception, match="not 'nothing'"):
        spark.read.format("snirf").option("table", "nothing").load(str(tmp_path))
