"""NIfTI volumes and .nirs recordings against arrays of the tests' own."""

import gzip
import struct

import numpy as np
import pytest

from lumenframe.sources import files, mat5, nifti, nirs

AFFINE = np.array([[2.0, 0, 0, -20], [0, 0, 1.5, 4], [0, -1.0, 0, 30], [0, 0, 0, 1]])


def raw_volume(a, order="<", scode=0, qcode=0, quatern=(0.0, 0.0, 0.0, 1.0, 2.0, 3.0), pixdim=(1, 2, 3, 4), slope=(0.0, 0.0)):
    code = {"u1": 2, "i2": 4, "f4": 16}[a.dtype.str[1:]]
    h = bytearray(352)
    struct.pack_into(order + "i", h, 0, 348)
    struct.pack_into(order + "8h", h, 40, 3, *a.shape, 1, 1, 1, 1)
    struct.pack_into(order + "h", h, 70, code)
    struct.pack_into(order + "8f", h, 76, *pixdim, 0, 0, 0, 0)
    struct.pack_into(order + "3f", h, 108, 352, *slope)
    struct.pack_into(order + "2h", h, 252, qcode, scode)
    struct.pack_into(order + "6f", h, 256, *quatern)
    struct.pack_into(order + "12f", h, 280, *AFFINE[:3].reshape(-1))
    h[344:348] = b"n+1\0"
    return bytes(h) + a.astype(a.dtype.newbyteorder(order)).tobytes(order="F")


def rows(df):
    return sorted(tuple(r) for r in df.select("i", "j", "k", "value").collect())


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_volume_is_read_whole_and_in_shares(spark, tmp_path, order, packed):
    spark.dataSource.register(nifti.NiftiSource)
    a = np.random.default_rng(1).integers(-3, 4, (5, 7, 11)).astype("i2")
    data = raw_volume(a, order, scode=2, slope=(0.5, 0.0))
    path = f"{tmp_path}/v.nii" + ".gz" * packed
    files.put(path, [gzip.compress(data) if packed else data])
    want = sorted((*map(int, p), float(a[tuple(p)]) / 2) for p in np.argwhere(a != 0))
    assert rows(spark.read.format("nifti").load(path)) == want
    shared = spark.read.format("nifti").option("splitBytes", 200).option("zeros", "true").load(str(tmp_path))
    assert shared.rdd.getNumPartitions() == (1 if packed else 6) and shared.count() == a.size
    assert rows(shared.where("value <> 0")) == want
    h = spark.read.format("nifti").option("table", "header").load(path).collect()
    assert [(r.ni, r.nj, r.nk, r.datatype, r.space) for r in h] == [(5, 7, 11, "int16", "aligned")] and np.reshape(h[0].affine, (4, 4)) == pytest.approx(AFFINE)


def test_affines():
    a = np.zeros((3, 4, 5), "u1")
    half = np.sqrt(0.5)
    h = nifti.Header(raw_volume(a, qcode=1, quatern=(0.0, 0.0, half, 1.0, 2.0, 3.0))[:348])  # a quarter turn about z
    assert h.space == "scanner" and h.affine == pytest.approx(np.array([[0, -3.0, 0, 1], [2, 0, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]]), abs=1e-6)
    flipped = nifti.Header(raw_volume(a, qcode=1, pixdim=(-1, 2, 3, 4))[:348])
    assert flipped.affine[2, 2] == pytest.approx(-4)
    h = nifti.Header(raw_volume(a)[:348])
    assert h.space == "unknown" and h.affine == pytest.approx(np.array([[-2.0, 0, 0, 2], [0, 3, 0, -4.5], [0, 0, 4, -8], [0, 0, 0, 1]]))
    with pytest.raises(ValueError, match="NIfTI"):
        nifti.Header(bytes(348))


@pytest.mark.parametrize("packed", [False, True])
def test_written_volumes_come_back(spark, tmp_path, packed):
    spark.dataSource.register(nifti.NiftiSource)
    rng = np.random.default_rng(2)
    cells = {(f, int(i), int(j), int(k)): float(v) for f in ("a", "b") for i, j, k, v in rng.integers(0, 6, (60, 4)) if v}
    df = spark.createDataFrame([(*p, v) for p, v in cells.items()], "file string, i int, j int, k int, value double").repartition(3)
    assert nifti.write_nifti(str(tmp_path), df, (6, 7, 9), AFFINE, "f4", "mni", packed) == 2
    back = spark.read.format("nifti").load(str(tmp_path)).collect()
    assert {(r.file.split("/")[-1][0], r.i, r.j, r.k): r.value for r in back} == cells
    with pytest.raises(Exception, match="outside the shape"):
        nifti.write_nifti(str(tmp_path), df, (6, 7, 2), AFFINE)


def test_masks(spark, tmp_path):
    def write(name, a, **how):
        files.put(f"{tmp_path}/{name}.nii", [raw_volume(a, scode=4, **how)])

    gm, wm = np.zeros((4, 4, 4), "f4"), np.zeros((4, 4, 4), "f4")
    gm[1, 2, 3], wm[0, 0, 0], wm[3, 3, 3] = 0.99999999, 1, 1
    write("gm", gm)
    write("wm", wm)
    masks, affine, space = nifti.read_segmentation_masks(spark, str(tmp_path), {"gm": "gm.nii", "wm": "wm.nii"})
    assert {tuple(r) for r in masks.collect()} == {(1, 2, 3, "gm", 1), (0, 0, 0, "wm", 2), (3, 3, 3, "wm", 2)} and space == "mni" and affine == pytest.approx(AFFINE)
    wm[1, 2, 3] = 1
    write("wm", wm)
    with pytest.raises(ValueError, match="more than one mask"):
        nifti.read_segmentation_masks(spark, str(tmp_path), {"gm": "gm.nii", "wm": "wm.nii"})
    wm[0, 0, 0] = 2
    write("wm", wm)
    with pytest.raises(ValueError, match="more than two values"):
        nifti.read_segmentation_masks(spark, str(tmp_path), {"wm": "wm.nii"})
    write("wm", np.zeros((4, 4, 5), "f4"))
    with pytest.raises(ValueError, match="differ"):
        nifti.read_segmentation_masks(spark, str(tmp_path), {"gm": "gm.nii", "wm": "wm.nii"})
    with pytest.raises(Exception, match="csf"):
        nifti.read_segmentation_masks(spark, str(tmp_path))


@pytest.mark.parametrize("compressed", [False, True])
def test_mat_values_come_back(compressed):
    v = {"n": 3, "m": np.arange(6.0).reshape(2, 3), "text": "héllo", "cells": ["a", 2.5, ["b"]], "s": {"x": 1, "deep": {"name": "q"}}, "none": np.zeros((0, 0))}
    back = mat5.load(b"".join(mat5.dump(v, compressed)))
    assert back["text"] == "héllo" and back["n"].tolist() == [[3.0]] and back["m"].tolist() == v["m"].tolist() and back["none"].shape == (0, 0)
    assert back["cells"][0] == "a" and back["cells"][1].item() == 2.5 and back["cells"][2] == ["b"] and back["s"]["deep"]["name"] == "q" and back["s"]["x"].item() == 1


def test_mat_in_other_forms():
    """Big-endian, numbers stored in a smaller type, several structs, and text of several lines."""
    def element(kind, body):
        return struct.pack(">II", kind, len(body)) + body + bytes(-len(body) % 8)

    def array(name, cls, shape, *body):
        return element(14, element(6, struct.pack(">II", cls, 0)) + element(5, struct.pack(">2i", *shape)) + element(1, name) + b"".join(body))

    numbers = array(b"x", 6, (2, 2), element(2, bytes([1, 2, 3, 4])))
    lines = array(b"t", 4, (2, 3), element(16, b"adbecf"))
    one = lambda v: array(b"", 6, (1, 1), element(9, struct.pack(">d", v)))
    structs = array(b"s", 2, (1, 2), struct.pack(">HHi", 4, 5, 8), element(1, b"a\0\0\0\0\0\0\0"), one(1.0), one(2.0))
    back = mat5.load(bytes(126) + b"MI" + numbers + lines + structs)
    assert back["x"].tolist() == [[1, 3], [2, 4]] and back["t"] == ["abc", "def"] and [s["a"].item() for s in back["s"]] == [1.0, 2.0]
    with pytest.raises(ValueError, match="level 5"):
        mat5.load(bytes(200))


def recording(**change):
    sd = {"SpatialUnit": "mm", "nSrcs": 2, "nDets": 10, "SrcPos": np.ones((2, 3)), "DetPos": np.arange(30.0).reshape(10, 3), "Lambda": [760.0, 850.0], "MeasList": np.array([[1, 10, 1, 1], [1, 10, 1, 2], [2, 3, 1, 1], [2, 3, 1, 1]])}
    s = np.zeros((6, 2))
    s[1, 0], s[4, 1], s[5, 0] = 1, -2, 1
    return {"t": np.arange(6.0)[:, None] / 10, "d": np.arange(24.0).reshape(6, 4), "s": s, "SD": sd, "aux": np.arange(12.0).reshape(6, 2)} | change


def test_nirs_tables(spark, tmp_path):
    files.put(f"{tmp_path}/r.nirs", mat5.dump(recording()))
    t = nirs.read_nirs(spark, str(tmp_path))
    cells = {(r.channel, r.wavelength, r.sample): (r.time, r.value) for r in t["timeseries"].collect()}
    assert len(cells) == 18 and cells["S1D10", 850.0, 2] == (0.2, 9.0) and cells["S2D3", 760.0, 5] == (0.5, 23.0)  # the later of two columns
    assert [(r.column, r.sourceIndex, r.detectorIndex, r.wavelengthIndex, r.channel) for r in t["measurements"].orderBy("column").collect()] == [(0, 0, 9, 0, "S1D10"), (1, 0, 9, 1, "S1D10"), (2, 1, 2, 0, "S2D3"), (3, 1, 2, 0, "S2D3")]
    assert sorted((r.trial_type, r.onset, r.duration, r.value) for r in t["stim"].collect()) == [("1", 0.1, 0.0, 1.0), ("1", 0.5, 0.0, 1.0), ("2", 0.4, 0.0, 1.0)]
    assert {r.label for r in t["geometry"].collect()} == {"S1", "S2", *[f"D{i}" for i in range(1, 11)]} and t["geometry"].where("label = 'D2'").first().z == 5.0
    assert t["aux"].count() == 12 and t["aux"].where("aux_channel = 1 AND sample = 3").first().value == 7.0


def test_nirs_prefers_3d_names_conditions_and_raises():
    n = nirs.Nirs(b"".join(mat5.dump(recording(SD3D=recording()["SD"] | {"Landmarks": np.zeros((1, 3)), "SpatialUnit": "cm"}, CondNames=["go", "stop"]))))
    assert n.sd["SpatialUnit"] == "cm" and n.points["landmark"][0] == ["L1"] and n.trial_types(2) == ["go", "stop"]
    with pytest.raises(ValueError, match="conditions"):
        n.trial_types(3)
    for change, error in (({"d": np.zeros((6, 3))}, "matrix"), ({"SD": recording()["SD"] | {"nSrcs": 3}}, "positions")):
        with pytest.raises(ValueError, match=error):
            nirs.Nirs(b"".join(mat5.dump(recording(**change))))
