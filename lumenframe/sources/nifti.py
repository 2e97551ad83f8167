"""NIfTI-1 volumes (.nii, .nii.gz) as tables of voxels, and voxels as volumes.

    spark.dataSource.register(NiftiSource)
    spark.read.format("nifti").load("folder or file")                                  # voxels other than 0
    spark.read.format("nifti").option("zeros", "true").load(...)                       # all voxels
    spark.read.format("nifti").option("table", "header").load(...)

A plain file is read in slabs of whole k planes by several tasks (option splitBytes), each its own byte range; a
compressed one by one task, as a stream, a slab at a time. Values are scaled by the header's slope and intercept.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import Ranges, filesystem, put, shares
from .snirf import SPLIT_BYTES, Share

TABLES = {
    "voxels": "file string, i int, j int, k int, value double",
    "header": "file string, ni int, nj int, nk int, datatype string, space string, affine array<double>",
}
# The data types, and what the codes of a transform's target space mean.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
SPACES = {0: "unknown", 1: "scanner", 2: "aligned", 3: "talairach", 4: "mni"}
SLAB_BYTES = 1 << 24


class Header:
    def __init__(self, raw: bytes):
        order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
        get = lambda form, at: struct.unpack_from(order + form, raw, at)
        if get("i", 0)[0] != 348 or raw[344:347] != b"n+1":
            raise ValueError("not a NIfTI-1 file")
        dim = get("8h", 40)
        if dim[0] < 3 or any(d > 1 for d in dim[4 : dim[0] + 1]):
            raise ValueError("a volume has three dimensions")
        self.shape, code = dim[1:4], get("h", 70)[0]
        if code not in DTYPES:
            raise ValueError(f"the data type {code} is not read")
        self.dtype = np.dtype(order + DTYPES[code])
        self.pixdim, self.offset = get("8f", 76), int(get("f", 108)[0])
        slope, inter = get("2f", 112)
        self.slope, self.inter = (slope, inter) if slope and math.isfinite(slope) else (1.0, 0.0)
        qcode, scode = get("2h", 252)
        if scode:
            self.affine, self.space = np.vstack([np.reshape(get("12f", 280), (3, 4)), [0, 0, 0, 1]]), SPACES.get(scode, "unknown")
        elif qcode:
            self.affine, self.space = self._turned(get("6f", 256)), SPACES.get(qcode, "unknown")
        else:
            self.affine, self.space = self._centred(), SPACES[0]

    def _turned(self, q: tuple) -> np.ndarray:
        b, c, d = q[:3]
        a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        m = np.eye(4)
        m[:3, :3] = turn * [self.pixdim[1], self.pixdim[2], self.pixdim[3] * (-1 if self.pixdim[0] < 0 else 1)]
        m[:3, 3] = q[3:]
        return m

    def _centred(self) -> np.ndarray:
        """Without a transform: voxel sizes, the first axis mirrored, the volume's middle at the origin."""
        zooms = np.array(self.pixdim[1:4]) * [-1, 1, 1]
        m = np.diag([*zooms, 1.0])
        m[:3, 3] = -zooms * (np.array(self.shape) - 1) / 2
        return m


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "voxels")
        self.zeros, self.split = options.get("zeros", "false").lower() == "true", int(options.get("splitbytes") or SPLIT_BYTES)

    def partitions(self) -> list[Share]:
        found = shares(self.path, self.split, ".nii", ".nii.gz")
        return [Share(p, k, n if self.table == "voxels" and p.endswith(".nii") else 1) for p, k, n in found if k == 0 or (self.table == "voxels" and p.endswith(".nii"))]

    def read(self, share: Share) -> Iterator:
        if share.file.endswith(".gz"):
            system, at = filesystem(share.file)
            stream = system.open_input_stream(at)  # its name tells the compression
            h = Header(stream.read(348))
            stream.read(h.offset - 348)
            take = lambda k0, n: stream.read(n * int(np.prod(h.shape[:2])) * h.dtype.itemsize)
        else:
            r = Ranges(share.file)
            h = Header(r.read(0, 348))
            plane = int(np.prod(h.shape[:2])) * h.dtype.itemsize
            take = lambda k0, n: r.read(h.offset + k0 * plane, n * plane)
        if self.table == "header":
            yield share.file, *h.shape, h.dtype.name, h.space, h.affine.reshape(-1).tolist()
            return
        first, last = (h.shape[2] * x // share.n for x in (share.k, share.k + 1))
        step = max(1, SLAB_BYTES // max(1, 8 * h.shape[0] * h.shape[1]))
        for k0 in range(first, last, step):
            n = min(step, last - k0)
            slab = np.frombuffer(take(k0, n), h.dtype).reshape(*h.shape[:2], n, order="F") * h.slope + h.inter
            at = np.nonzero(np.ones(slab.shape, bool) if self.zeros else slab != 0)
            ints = [pa.array((x + (k0 if axis == 2 else 0)).astype(np.int32)) for axis, x in enumerate(at)]
            yield pa.RecordBatch.from_arrays([pa.array([share.file] * len(at[0]), pa.string()), *ints, pa.array(slab[at].astype(float))], names=["file", "i", "j", "k", "value"])


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "voxels")]

    def reader(self, schema) -> NiftiReader:
        return NiftiReader({k.lower() if k.lower() == "splitbytes" else k: v for k, v in self.options.items()})


def _header(shape: tuple[int, int, int], dtype: str, affine: np.ndarray, code: int) -> bytes:
    raw = bytearray(352)
    number = next(k for k, v in DTYPES.items() if v == dtype)
    size = np.dtype(dtype).itemsize
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, number, 8 * size)
    struct.pack_into("<8f", raw, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 0, 0, 0, 0)
    struct.pack_into("<3f", raw, 108, 352, 1, 0)
    raw[123] = 2  # millimetres
    struct.pack_into("<2h", raw, 252, 0, code)
    struct.pack_into("<12f", raw, 280, *affine[:3].reshape(-1))
    raw[344:348] = b"n+1\0"
    return bytes(raw)


def write_nifti(path: str, voxels: DataFrame, shape: tuple[int, int, int], affine: np.ndarray, dtype: str = "u1", space: str = "scanner", compressed: bool = False) -> int:
    """Write voxels (file, i, j, k, value) as one volume a file, below path; how many. Voxels that are missing are 0.

    A task streams a file's voxels in order of k and holds one plane and what is written. A voxel outside the shape raises.
    """
    code = {v: k for k, v in SPACES.items()}[space]
    head, suffix = _header(shape, dtype, np.asarray(affine, float), code), ".nii.gz" if compressed else ".nii"

    def volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parts, plane, k, pack = None, [], None, 0, None

        def shift(upto: int) -> None:
            nonlocal plane, k
            while k < upto:
                parts.append(pack(plane.astype(np.dtype("<" + dtype)).tobytes(order="F")))
                plane, k = np.zeros(shape[:2]), k + 1

        def done() -> pa.RecordBatch:
            shift(shape[2])
            parts.append(deflate.flush() if compressed else b"")
            size = put(f"{path}/{file}{suffix}", parts)
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64())], names=["file", "size"])

        for batch in batches:
            names = np.asarray(batch.column("file").to_pylist(), object)
            cells = [np.asarray(batch.column(c)) for c in ("i", "j", "k", "value")]
            if any(len(c) and (c.min() < 0 or c.max() >= n) for c, n in zip(cells, shape, strict=False)):
                raise ValueError(f"a voxel lies outside the shape {shape}")
            cuts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]) | (cells[2][1:] != cells[2][:-1])) + 1, len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if names[a] != file:
                    if file is not None:
                        yield done()
                    file, plane, k = names[a], np.zeros(shape[:2]), 0
                    deflate = zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                    pack = deflate.compress if compressed else bytes
                    parts = [pack(head)]
                shift(int(cells[2][a]))
                plane[cells[0][a:b], cells[1][a:b]] = cells[3][a:b]
        if file is not None:
            yield done()

    rows = voxels.select("file", *[F.col(c).cast("int").alias(c) for c in "ijk"], F.col("value").cast("double").alias("value"))
    written = rows.repartition("file").sortWithinPartitions("file", "k").mapInArrow(volumes, "file string, size long")
    return written.agg(F.count("*")).first()[0]


def read_segmentation_masks(spark, basedir: str, mask_files: dict[str, str] | None = None) -> tuple[DataFrame, np.ndarray, str]:
    """(voxels of tissues (i, j, k, seg_type, label), affine, its space); label is a tissue's place in mask_files, from 1.

    Raises if a file is missing or not of two values, if files differ in shape or affine, or if a voxel is in two masks.
    """
    spark.dataSource.register(NiftiSource)
    mask_files = mask_files or {t: f"{t}.nii" for t in ("csf", "gm", "scalp", "skull", "wm")}
    heads, out = [], None
    for label, (tissue, name) in enumerate(mask_files.items(), 1):
        path = f"{basedir.rstrip('/')}/{name}"
        h = spark.read.format("nifti").option("table", "header").load(path).first()
        heads.append(h)
        v = spark.read.format("nifti").load(path)
        n = v.select("value").distinct().limit(3).collect()
        full = v.count() == h.ni * h.nj * h.nk
        if len(n) > (2 if full else 1):
            raise ValueError(f"{path} has more than two values")
        # resampling leaves small deviations
        mine = v.where(F.round("value", 6).cast("int") != 0).select("i", "j", "k", F.lit(tissue).alias("seg_type"), F.lit(label).alias("label"))
        out = mine if out is None else out.unionByName(mine)
    if len({(h.ni, h.nj, h.nk) for h in heads}) > 1 or len({tuple(h.affine) for h in heads}) > 1:
        raise ValueError("the masks differ in shape or affine")
    if not out.groupBy("i", "j", "k").count().where("count > 1").isEmpty():
        raise ValueError("a voxel is in more than one mask")
    return out, np.reshape(heads[0].affine, (4, 4)), heads[0].space
