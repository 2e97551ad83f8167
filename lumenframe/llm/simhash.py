"""SimHash near-duplicates: blocks of fingerprint bits as join keys, then Hamming distance.

Shingles are hashed by built-in expressions; only the bit votes are summed in numpy. Equal
fingerprints collapse first, so copies never meet each other. Keys are blocks of bits:

* ``pigeonhole`` keys find every pair within a distance: with ``blocks`` blocks, two 64-bit
  fingerprints at ``distance`` or fewer differing bits agree on at least ``blocks - distance``
  of them, and there is a key for each choice of so many blocks;
* ``similarity`` keys serve pairs of a Jaccard similarity, which differ in far more bits than
  blocks could cover: wider fingerprints and as many drawn blocks as the wanted recall needs. Their
  links are candidates only: inside each component of candidates the exact Jaccard similarity of
  the shingle sets decides.

A bucket (the fingerprints of one key) is compared inside one task only up to ``TILE`` members; a
larger one is divided again by pigeonhole keys over its remaining bits where there are such, and
what is still larger is compared tile by tile in separate tasks. Every link is verified by its
Hamming distance, and a task emits a spanning forest of its links, never all pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; rows that
share an id are one document, which links all their fingerprints; a row without an id never names
its component: without any id in it, the component is null and made of equal shingle sets (or
fingerprints); ``keep_first`` keeps exactly one row of each component, of those with its smallest
id (or none has one) a row of the smallest text hash; an empty table gives an empty result; columns
besides the id and the text are ignored by ``fingerprints`` and carried by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, materialize, table, text_or_empty, unboxed, words_of
from .components import components

#: Members of a bucket that one task compares at once.
TILE = 2048
#: Shingles of a tile's documents that are compared by their sets.
TILE_SHINGLES = 1 << 21


def _votes(width: int):
    """Fingerprints of width words of 64 bits; further words vote on mixed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, flat = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values).view(np.uint64)
            out = np.zeros((width, len(lists)), np.uint64)
            for i in range(len(lists)):
                own = flat[ends[i] : ends[i + 1]]
                for k in range(width if len(own) else 0):
                    h = own if not k else (own ^ (own >> np.uint64(29 + k))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                    h = h if not k else h ^ (h >> np.uint64(32))
                    n = np.zeros(64, np.int64)
                    for at in range(0, len(h), 1 << 16):
                        n += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    out[k, i] = np.packbits(2 * n > len(h)).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in out], *batch.columns[2:]], names=["id", *[f"f{k}" for k in range(width)], *batch.schema.names[2:]])

    return run


def shingles(docs: DataFrame, size: int, text: str, *keep: Column) -> DataFrame:
    """The kept columns and h: the XXH64 (seed 42) hashes of a text's runs of size words."""
    words = docs.select(*keep, words_of(ascii_lower(text_or_empty(text))).alias("w"))
    w = F.col("w")
    starts = F.when(F.size(w) > size, F.sequence(F.lit(1), F.size(w) - (size - 1))).when(F.size(w) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    return words.select(*words.columns[:-1], hashes.alias("h"))


def fingerprints(docs: DataFrame, size: int = 5, width: int = 1, id_col: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(id, f0, f1, ..., th): signed longs; f0 alone is the 64-bit SimHash of XXH64 (seed 42) shingles, th the text's hash.

    distinct: each shingle votes once, and a column s tells apart sets of one fingerprint.
    """
    rows = shingles(docs, size, text, F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"))
    h = F.array_sort(F.array_distinct("h")) if distinct else F.col("h")
    rows = rows.select("id", h.alias("h"), "th", *[F.xxhash64(h).alias("s")] * distinct)
    return rows.mapInArrow(_votes(width), f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"f{k} long" for k in range(width)) + ", th long" + ", s long" * distinct)


def pigeonhole(distance: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """A mask for each choice of blocks - distance blocks of the bits."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits if bits is not None else range(64), dtype=object), blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def similarity(n: int, jaccard: float, recall: float, width: int) -> tuple[list[int], int]:
    """(masks, distance) for n fingerprints of width words.

    Bits of texts at this Jaccard similarity differ with probability angle / pi. A block has two
    bits more than n needs to be told apart, so that chance meetings stay in proportion to n, and
    there are as many blocks as the recall asks for. The distance allows three standard deviations.
    """
    differ = math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    bits = max(16, math.ceil(math.log2(max(n, 2))) + 2)
    keys = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    rng = np.random.default_rng(11)
    masks = [sum(1 << int(b) for b in rng.choice(64 * width, bits, replace=False)) for _ in range(keys)]
    return masks, round(64 * width * differ + 3 * math.sqrt(64 * width * differ * (1 - differ)))


def _masked(mask: int, width: int) -> Column:
    """The bits of a mask, as one long: themselves for one word, else their hash."""
    words = [(mask >> 64 * k) & (1 << 64) - 1 for k in range(width)]
    cols = [F.col(f"f{k}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for k, m in enumerate(words) if m]
    return cols[0] if width == 1 else F.xxhash64(*cols)


def _forest(f: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest: from each component's first member to its others."""
    out, left = [], np.argsort(ids, kind="stable")
    while len(left) > 1:
        root, front = left[0], left[:1]
        left = left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                near |= np.bitwise_count(f[left] ^ f[x]).sum(1) <= distance
            front, left = left[near], left[~near]
            out += [(ids[root], ids[x]) for x in front]
    return out


def _link_sorted(distance: int, width: int):
    """Over rows sorted by bucket: the forest of each bucket. A bucket has at most two tiles' members."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["k", "v", "t"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = cut[-1] if len(cut) else 0
            rest = pdf.iloc[last:]
            if last:
                yield found(pdf.iloc[:last], np.r_[0, cut[:-1]], cut)
        if rest is not None and len(rest):
            yield found(rest, np.array([0]), np.array([len(rest)]))

    def found(pdf, starts, ends):
        f, ids, size = pdf[[f"f{k}" for k in range(width)]].to_numpy().view(np.uint64), pdf["id"].to_numpy(), ends - starts
        two = starts[size == 2]
        near = two[np.bitwise_count(f[two] ^ f[two + 1]).sum(1) <= distance] if len(two) else two
        more = [e for s, t in zip(starts[size > 2], ends[size > 2], strict=True) for e in _forest(f[s:t], ids[s:t], distance)]
        return pd.DataFrame({"a": np.r_[ids[near], np.array([e[0] for e in more], np.int64)], "b": np.r_[ids[near + 1] if len(near) else ids[near], np.array([e[1] for e in more], np.int64)]})

    return link


def links(fps: DataFrame, masks: list[int], distance: int, width: int = 1, finer: dict[int, list[int]] | None = None) -> DataFrame:
    """(a, b): ids of a spanning forest of the pairs that share a masked key and differ in at most distance bits.

    fps: a long id and the words, distinct fingerprints. finer: by key number, masks (of that key's
    bits and more) that divide its buckets over TILE without losing a pair.
    """
    own = ["id", *[f"f{k}" for k in range(width)]]

    def keyed(rows: DataFrame, keys: Column) -> DataFrame:
        return rows.select(F.explode(keys).alias("key"), *own).select("key.k", "key.v", *own)

    def keys_of(numbered: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(k).cast("int").alias("k"), _masked(m, width).alias("v")) for k, m in numbered])

    def within(rows: DataFrame) -> DataFrame:
        return rows.repartition("k", "v", "t").sortWithinPartitions("k", "v", "t").mapInPandas(_link_sorted(distance, width), "a long, b long")

    rows = keyed(fps, keys_of(list(enumerate(masks))))
    sizes = materialize(rows.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"))
    small = rows.join(sizes.where(F.col("n") <= TILE).select("k", "v"), ["k", "v"]).select("k", "v", F.lit(0).alias("t"), *own)
    out = within(small)
    over = sizes.where(F.col("n") > TILE)
    if over.isEmpty():
        return out
    large = rows.join(over.select("k", "v"), ["k", "v"])
    if finer:
        again = F.lit(None).cast("array<struct<k:int,v:bigint>>")
        for k, more in finer.items():
            again = F.when(F.col("k") == k, keys_of([(1000 * (k + 1) + j, m) for j, m in enumerate(more)])).otherwise(again)
        large = large.select(F.explode(again).alias("key"), *own).select("key.k", "key.v", *own)
    large = materialize(large)
    counts = large.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    tiled = large.join(counts, ["k", "v"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles").cast("long")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(o, F.col("mine")) * F.col("tiles") + F.greatest(o, F.col("mine")))
    return out.union(within(tiled.select("k", "v", F.explode(meet).alias("t"), *own)))


def _forest_of_sets(sets: list[np.ndarray], ids: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs of sets with the similarity or more."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends, mark = np.cumsum(size), np.zeros(len(flat), bool)
    parts = [flat[e - n : e] for e, n in zip(ends, size, strict=True)]

    def near(x: int, others: np.ndarray, those: np.ndarray) -> np.ndarray:
        mark[parts[x]] = True
        both = np.diff(np.r_[0, np.cumsum(mark[those])][np.r_[0, np.cumsum(size[others])]])
        mark[parts[x]] = False
        union = size[x] + size[others] - both
        return (both >= jaccard * union - 1e-9) | (union == 0)

    out, left = [], np.argsort(ids, kind="stable")
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            # from the smaller side, so that a few left over cost little
            few, many = (front, left) if len(front) <= len(left) else (left, front)
            those = np.concatenate([parts[i] for i in many])
            hits = [near(x, many, those) for x in few]
            found = np.any(hits, axis=0) if few is front else np.array([h.any() for h in hits])
            front, left = left[found], left[~found]
            out += [(ids[root], ids[x]) for x in front]
    return out


def _link_sets(jaccard: float):
    """Over rows (root, t, id, h) sorted by root and t: the forest of each group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def found():
            e = _forest_of_sets(sets, np.array(ids), jaccard) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in e], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            ends, flat = np.asarray(batch.column("h").offsets).astype(np.int64), np.asarray(batch.column("h").values)
            for i, (r, t, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "t", "id")), strict=True)):
                if (r, t) != key:
                    yield found()
                    key, ids, sets = (r, t), [], []
                ids.append(d)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        yield found()

    return link


def verified(edges: DataFrame, docs: DataFrame, jaccard: float, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): a spanning forest of the pairs of the Jaccard similarity or more inside each component of edges.

    Every pair of a component is decided by its shingle sets; a component of more than TILE
    documents or TILE_SHINGLES shingles is compared tile by tile in separate tasks.
    """
    member = components(edges).withColumnRenamed("vertex", "id")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(member, "id")
    sets = materialize(shingles(own, size, "text", F.col("root"), F.col("id")).select("root", "id", F.array_distinct("h").alias("h")).distinct())
    counts = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("h")).alias("m"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("m") / TILE_SHINGLES), F.lit(1)).cast("int")
    tiled = sets.join(counts.select("root", tiles.alias("tiles")), "root").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles").cast("long")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(o, F.col("mine")) * F.col("tiles") + F.greatest(o, F.col("mine")))
    rows = tiled.select("root", F.explode(meet).alias("t"), "id", "h")
    return rows.repartition("root", "t").sortWithinPartitions("root", "t").mapInArrow(_link_sets(jaccard), "a long, b long")


def _classes(docs: DataFrame, size: int, distance: int | None, blocks: int, jaccard: float, recall: float, width: int, id_col: str, text: str) -> tuple[DataFrame, list[str]]:
    """(id, words, th, component_id) of every row and the columns that tell fingerprints (and sets) apart."""
    width = width if distance is None else 1
    words = [f"f{k}" for k in range(width)]
    fps = materialize(fingerprints(docs, size, width, id_col, text, distance is None))
    same = words + ["s"] * (distance is None)
    first = materialize(fps.groupBy(*same).agg(F.min("id").alias("first")))
    ids = first.where(F.col("first").isNotNull()).select(F.col("first").cast("long").alias("id"), *words)
    if distance is None:
        masks, distance = similarity(first.count(), jaccard, recall, width)
        # sets that share a fingerprint are candidates too
        alike = first.groupBy(*words).agg(F.min("first").cast("long").alias("b")).join(ids, words).select(F.col("id").alias("a"), "b")
        one = first.groupBy(*words).agg(F.min("first").cast("long").alias("id")).where("id IS NOT NULL").select("id", *words)
        edges = materialize(verified(links(one, masks, distance, width).union(alike.where("a <> b")), docs, jaccard, size, id_col, text))
    else:
        masks = pigeonhole(distance, blocks)
        edges = links(ids, masks, distance, 1, {k: [m | x for x in pigeonhole(distance, blocks, [b for b in range(64) if not m >> b & 1])] for k, m in enumerate(masks)})
    several = fps.groupBy("id").agg(F.count_distinct(*same).alias("n")).where("n > 1 AND id IS NOT NULL").select("id")
    ties = fps.join(several, "id").join(first, same).select(F.col("id").cast("long").alias("a"), F.col("first").cast("long").alias("b"))
    comp = components(edges.union(ties)).withColumnRenamed("vertex", "first")
    rooted = first.join(comp, "first", "left").select(*same, F.coalesce("root", "first").alias("component_id"))
    return fps.join(rooted, same).select("id", *same, "th", "component_id"), same


def near_duplicates(docs: DataFrame, size: int = 5, distance: int | None = 3, blocks: int = 5, jaccard: float = 0.8, recall: float = 0.99, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f0, ..., component_id): component_id is the smallest id reachable over links.

    With a distance, all pairs of 64-bit fingerprints that close are linked; more blocks mean smaller
    buckets and more keys (5 serve up to about a hundred million fingerprints, 6 or 7 beyond). With
    distance None, texts of the Jaccard similarity or more are linked: wider fingerprints find the
    candidates, a pair at the similarity with the recall, and the shingle sets decide.
    """
    out, same = _classes(docs, size, distance, blocks, jaccard, recall, width, id_col, text)
    return out.select(F.col("id").alias(id_col), *[c for c in same if c != "s"], "component_id")


def keep_first(docs: DataFrame, size: int = 5, distance: int | None = 3, blocks: int = 5, jaccard: float = 0.8, recall: float = 0.99, width: int = 4) -> DataFrame:
    """The rows of docs, of each component only one, with its smallest id."""
    classed, same = _classes(docs, size, distance, blocks, jaccard, recall, width, "doc_id", "text")
    rows = materialize(classed)
    named = rows.where("id = component_id").groupBy("id").agg(F.min("th").alias("th"))
    nameless = rows.where("component_id IS NULL").groupBy(*same).agg(F.min("th").alias("th")).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "th").distinct()
    chosen = named.unionByName(nameless)
    # rows of one id and text are told apart by nothing else: of them one is taken
    n = rows.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    again = n.alias("n").join(chosen.alias("c"), F.col("n.id").eqNullSafe(F.col("c.id")) & (F.col("n.th") == F.col("c.th"))).select("n.id", "n.th")
    hits = lambda keys, how: boxed(docs).join(keys, F.col("row.doc_id").eqNullSafe(keys["id"]) & (F.xxhash64(text_or_empty(F.col("row.text"))) == keys["th"]), how)
    again = materialize(again)
    if again.isEmpty():
        return unboxed(hits(chosen, "left_semi"))
    single = chosen.join(again, chosen["id"].eqNullSafe(again["id"]) & (chosen["th"] == again["th"]), "left_anti")
    folded = hits(again, "inner").groupBy("id", "th").agg(F.first("row").alias("row")).select("row")
    return unboxed(hits(single, "left_semi").unionByName(folded))


def query(spark, sf_dir) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
