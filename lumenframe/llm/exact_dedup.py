"""Exact deduplication by an extendible-hash index on shared files.

A content's key is XXH64 of its normalised text. The index is a folder in the shared storage: one
Parquet folder per version of a bucket below ``buckets``, and below ``directory`` one table per
version of the directory. Slots are the leading bits of a key. A bucket that a batch overfills splits
in two by its next bit, again and again until each part fits; a split of a bucket whose local depth
equals the global depth doubles the directory. The directory is kept folded: one row per bucket
stands for its 2 ** (global - local depth) slots, so doubling costs nothing and its size follows
from the buckets (16 bytes for each ``BUCKET_BYTES`` / 2 of distinct text or so: raise that with the
data, to 256 MB at 100 TB). A bucket that no bit can divide (one key) stays overfull and keeps its
rows chained.

``insert`` adds a batch: it reads back only the buckets that the batch touches, merges, and writes
those (and what they split into) under new numbers; all other buckets' files stay as they are. The
next directory version is written last, so readers keep the old one until then, a lost task is just
run again, and a failed insert leaves the index as it was.

An owner task holds a range of keys: its rows arrive sorted by key, and equal keys are chained;
each chain compares bytes, so two texts share a class only if they are identical. Each map task
first folds its own copies of a text into one row (smallest id, count), so a hot text reaches its
owner as a few rows per map task. Documents then look their class up by key and SHA-256; classes
that hold at least one row in ``HOT`` (so there are at most ``HOT``) are looked up by broadcast.

Defined results: a null text equals an empty one; repeated rows are members like any other; a row
without an id counts in its group and stays only where no member has an id; of rows that share the
smallest id and a text, one stays, no matter which; an empty table gives an empty result; other
columns are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, materialize, shared_dir, table, text_or_empty, unboxed

#: Bytes of distinct text that a bucket holds before it splits; buckets of one owner task.
BUCKET_BYTES, OWNED = 16 << 20, 4
#: Bits by which one look at the sizes may split a bucket.
STEP = 4
#: Classes of at least one row in so many are looked up by broadcast.
HOT = 10_000
KEY_BITS = 64
ENTRY = "key long, text string, first {id}, n long"


def normalised(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


@dataclass
class Bucket:
    """All keys whose first depth bits are those of slot; number names its folder, bytes is what it holds."""

    slot: int
    depth: int
    number: int = 0
    bytes: int = 0

    @property
    def least(self) -> int:
        return self.slot << (KEY_BITS - self.depth)


@dataclass
class Directory:
    """The buckets of an index in the order of their keys (as unsigned numbers)."""

    path: str
    version: int = 0
    buckets: list[Bucket] = field(default_factory=lambda: [Bucket(0, 0)])
    next_number: int = 1

    @classmethod
    def open(cls, spark, path: str, version: int) -> Directory:
        rows = spark.read.parquet(f"{path}/directory/{version}").collect()
        found = sorted((Bucket(r["slot"], r["depth"], r["number"], r["bytes"]) for r in rows), key=lambda b: b.least)
        return cls(path, version, found, max(b.number for b in found) + 1)

    @property
    def depth(self) -> int:
        return max(b.depth for b in self.buckets)

    def save(self, spark) -> None:
        self.version += 1
        rows = [(b.slot, b.depth, b.number, b.bytes) for b in self.buckets]
        spark.createDataFrame(rows, "slot long, depth int, number long, bytes long").coalesce(1).write.parquet(f"{self.path}/directory/{self.version}")

    def starts(self) -> np.ndarray:
        return np.array([b.least for b in self.buckets], np.uint64)


def _at(starts: np.ndarray, key: pa.Array) -> np.ndarray:
    """The place in the directory of each key's bucket."""
    return np.searchsorted(starts, np.asarray(key).view(np.uint64), "right") - 1


#: Bytes of text after which a map task passes on what it has folded.
FOLD_BYTES = 32 << 20


def _fold(shared):
    """Adds each row's bucket; rows of one map task with the same text become one: smallest id and count."""

    def folded(held):
        t = pa.Table.from_batches(held).group_by(["bucket", "key", "text"]).aggregate([("first", "min"), ("n", "sum")])
        return t.select(["bucket", "key", "text", "first_min", "n_sum"]).rename_columns(["bucket", "key", "text", "first", "n"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, numbers = shared.value
        held, size = [], 0
        for batch in batches:
            bucket = pa.array(numbers[_at(starts, batch.column("key"))])
            held.append(pa.RecordBatch.from_arrays([bucket, *batch.columns], names=["bucket", *batch.schema.names]))
            size += batch.column("text").nbytes
            if size > FOLD_BYTES:
                yield from folded(held).to_batches()
                held, size = [], 0
        if held:
            yield from folded(held).to_batches()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and key: chains the texts of each key and compares their bytes."""
    last, chain = None, {}

    def closed():
        cols = list(zip(*[(last[0], last[1], t, first, n) for t, (first, n) in chain.items()], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names, types, out, size = ["bucket", "key", "text", "first", "n"], None, [], 0
    for batch in batches:
        types = types or [f.type for f in batch.schema]
        key = batch.column("key")
        n = len(key)
        if not n:
            continue
        # rows whose key stands alone need no comparison
        lone = pc.fill_null(pc.and_(pc.not_equal(key, pa.concat_arrays([pa.nulls(1, key.type), key.slice(0, n - 1)])), pc.not_equal(key, pa.concat_arrays([key.slice(1), pa.nulls(1, key.type)]))), False)
        plain = batch.filter(lone)
        if len(plain):
            yield plain
        for row in batch.filter(pc.invert(lone)).to_pylist():
            at = (row["bucket"], row["key"])
            if at != last:
                if chain:
                    out.append(closed())
                last, chain = at, {}
            first, count = chain.get(row["text"], (None, 0))
            ids = [x for x in (first, row["first"]) if x is not None]
            chain[row["text"]] = (min(ids, default=None), count + row["n"])
        yield from out
        out = []
    if chain:
        yield closed()


def _divided(b: Bucket, parts: dict[int, tuple[int, int, int]], bits: int, limit: int) -> list[tuple[Bucket, bool]]:
    """b or the buckets it splits into, and whether each is settled; parts: by the next bits (bytes, least key, greatest key)."""
    total = sum(p[0] for p in parts.values())
    if total <= limit or min(p[1] for p in parts.values()) == max(p[2] for p in parts.values()):
        return [(Bucket(b.slot, b.depth, b.number, total), True)]
    if not bits:
        return [(b, False)]
    half = 1 << (bits - 1)
    low, high = {s: p for s, p in parts.items() if s < half}, {s - half: p for s, p in parts.items() if s >= half}
    return _divided(Bucket(2 * b.slot, b.depth + 1), low, bits - 1, limit) + _divided(Bucket(2 * b.slot + 1, b.depth + 1), high, bits - 1, limit)


def _sums(shared):
    """Rows (key, bytes): their bucket's place, its next bits, bytes and keys; places that are settled are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, depth, open_ = shared.value
        for batch in batches:
            key = np.asarray(batch.column("key"))
            at = _at(starts, batch.column("key"))
            keep = open_[at]
            sub = (key.view(np.uint64) << depth[at].astype(np.uint64)) >> np.uint64(KEY_BITS - STEP)
            yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(sub[keep].astype(np.int32)), pa.array(key[keep]), batch.column("bytes").filter(pa.array(keep))], names=["at", "sub", "key", "bytes"])

    return run


def _settle(directory: Directory, sizes: DataFrame, bucket_bytes: int) -> None:
    """Split what a batch overfills and give each bucket that is written anew a new number.

    sizes: key and bytes of each content that the touched buckets will hold. Each look sums the
    buckets in doubt; the driver sees 2 ** STEP sums for each.
    """
    spark = sizes.sparkSession
    doubt, touched = [True] * len(directory.buckets), set()
    while any(doubt):
        shared = spark.sparkContext.broadcast((directory.starts(), np.array([b.depth for b in directory.buckets]), np.array(doubt)))
        sums = sizes.select("key", "bytes").mapInArrow(_sums(shared), "at long, sub int, key long, bytes long").groupBy("at", "sub").agg(F.sum("bytes").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
        parts: dict[int, dict] = {}
        for r in sums.collect():
            parts.setdefault(r["at"], {})[r["sub"]] = (r["bytes"], r["least"], r["most"])
        buckets, again = [], []
        for i, b in enumerate(directory.buckets):
            for x, settled in _divided(b, parts[i], STEP, bucket_bytes) if i in parts else [(b, True)]:
                buckets.append(x)
                again.append(not settled)
                if i in parts and settled:
                    touched.add((x.slot, x.depth))
        directory.buckets, doubt = buckets, again
    for b in directory.buckets:
        if (b.slot, b.depth) in touched:
            b.number, directory.next_number = directory.next_number, directory.next_number + 1


#: What a content counts for in its bucket; more than nothing, so that a bucket without bytes has no folder.
_BYTES = "octet_length(text) + 1L"


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("first"), normalised(text_or_empty(text)).alias("text"), F.lit(1).cast("long").alias("n"))
    return rows.withColumn("key", F.xxhash64("text")).select("key", "text", "first", "n")


def insert(docs: DataFrame, index: Directory | None = None, id_col: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """Add docs to an index (None: a new one); its next version."""
    new = _rows(docs, id_col, text)
    sizes = materialize(new.groupBy("key").agg(F.max(F.expr(_BYTES)).alias("bytes")))
    return _merge(new, sizes, index, dict(docs.dtypes)[id_col], bucket_bytes)


def _merge(new: DataFrame, sizes: DataFrame, index: Directory | None, kind: str, bucket_bytes: int) -> Directory:
    """new: key, text, first, n; sizes: key and bytes of its contents."""
    spark = new.sparkSession
    if index is None:
        target = Directory(shared_dir(spark))
    else:
        target = Directory.open(spark, index.path, index.version)
        shared = spark.sparkContext.broadcast((target.starts(), np.array([b.depth for b in target.buckets]), np.ones(len(target.buckets), bool)))
        hit = sizes.mapInArrow(_sums(shared), "at long, sub int, key long, bytes long").select("at").distinct().collect()
        old = _read(spark, target, [target.buckets[r["at"]] for r in hit], kind)
        new = new.unionByName(old)
        sizes = materialize(sizes.unionByName(old.select("key", F.expr(_BYTES).alias("bytes"))).groupBy("key").agg(F.max("bytes").alias("bytes")))
    before = target.next_number
    _settle(target, sizes, bucket_bytes)
    fresh = target.next_number - before
    if fresh:
        shared = spark.sparkContext.broadcast((target.starts(), np.array([b.number for b in target.buckets], np.int64)))
        schema = f"bucket long, {ENTRY.format(id=kind)}"
        folded = new.select("key", "text", "first", "n").mapInArrow(_fold(shared), schema)
        # new numbers ascend with the keys, so an owner's buckets are a range of keys
        owner = F.floor((F.col("bucket") - before) / OWNED).cast("int")
        owned = folded.repartitionById(-(-fresh // OWNED), owner).sortWithinPartitions("bucket", "key").mapInArrow(_own, schema)
        owned.write.mode("append").partitionBy("bucket").parquet(f"{target.path}/buckets")
    target.save(spark)
    return target


def _read(spark, index: Directory, buckets: list[Bucket], kind: str) -> DataFrame:
    """The contents of some buckets: key, text, first, n; only their folders are listed."""
    schema, paths = ENTRY.format(id=kind), [f"{index.path}/buckets/bucket={b.number}" for b in buckets if b.bytes]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def open_index(spark, index: Directory, kind: str = "bigint") -> DataFrame:
    """The classes of an index: key, text, first, n."""
    return _read(spark, index, index.buckets, kind)


def _classed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """For every row: rn (its number), id, keep_id, group_size, kept, sha."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    new, sha = _rows(docs, id_col, text), F.unhex(F.sha2("text", 256))
    rows = materialize(new.select(F.monotonically_increasing_id().alias("rn"), F.col("first").alias("id"), "key", sha.alias("sha"), F.expr(_BYTES).alias("bytes")))
    sizes = materialize(rows.groupBy("key").agg(F.max("bytes").alias("bytes")))
    index = _merge(new, sizes, None, kind, BUCKET_BYTES)
    known = materialize(open_index(spark, index, kind).select("key", sha.alias("sha"), F.col("first").alias("keep_id"), F.col("n").alias("group_size")))
    total = rows.count()
    hot = known.where(F.col("group_size") * HOT >= total).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})
    marked = rows.drop("bytes").join(F.broadcast(hot), ["key", "sha"], "left")
    rest = marked.where("hot_size IS NULL").drop("hot_id", "hot_size").join(known, ["key", "sha"])
    found = marked.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"}).unionByName(rest)
    # rows that share their group's smallest id (or have none, where none has): the first of them stays
    shared = rows.groupBy("id", "key", "sha").agg(F.count("*").alias("n"), F.min("rn").alias("least")).where("n > 1").select("least", F.col("id").alias("s_id"), F.col("key").alias("s_key"), F.col("sha").alias("s_sha"))
    shared = materialize(shared)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    if not shared.isEmpty():
        found = found.join(shared, (F.col("key") == F.col("s_key")) & (F.col("sha") == F.col("s_sha")) & F.col("id").eqNullSafe(F.col("s_id")), "left")
        stays = stays & F.coalesce(F.col("rn") == F.col("least"), F.lit(True))
    return found.select("rn", "id", "keep_id", "group_size", stays.alias("kept"), "sha", "key")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: id, keep_id, group_size, kept, text_sha256."""
    return _classed(docs, id_col, text).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, of equal texts only one, with the smallest id."""
    kept = _classed(docs, id_col, text).where("kept").select("id", "sha")
    rows = boxed(docs).withColumn("sha", F.unhex(F.sha2(normalised(text_or_empty(F.col("row").getField(text))), 256)))
    found = rows.join(kept, F.col("row").getField(id_col).eqNullSafe(kept["id"]) & (rows["sha"] == kept["sha"]), "left_semi")
    return unboxed(found.groupBy("sha").agg(F.first("row").alias("row")))


def query(spark, sf_dir) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
