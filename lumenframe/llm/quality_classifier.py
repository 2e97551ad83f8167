"""Quality classifier: a linear support vector machine over naive Bayes features.

A text's features are indicators of its byte n-grams (``ORDERS``) and of runs of one repeated
word, hashed to ``BUCKETS``. Each is scaled by its log-count ratio between the two classes, which
Spark counts over every labelled training text. One hinge loss with an L2 penalty is then minimised by
dual coordinate descent over a bounded sample of the labelled texts: those with the smallest hash of
id and text, at most ``FIT_ROWS`` of them and ``FIT_BYTES`` bytes, whatever the number of texts. Their
features are computed by many tasks and meet in one, which descends until the duality gap is at most
``TOLERANCE`` of the primal objective, or raises; the gap reached is part of the model. (Blocks that
descend side by side were tried: with a step that is safe to add, 20 blocks still had a gap of a half after 50
rounds where one block needs three, so their result would depend on the number of blocks.) A score is the
logistic function of the margin; only the weights (``BUCKETS`` numbers) travel.

Defined results: a null or empty text is scored by the bias alone; labels that are null are not
learned from; documents with several labels are learned from once for each, repeated rows each time; without any training
label of one class the score is 0.5 moved by the class that exists; an empty table gives an empty
result; columns besides the id and the text never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, table, text_or_empty

ORDERS, BUCKETS = (3, 4, 5), 1 << 18
#: Labelled texts that the loss is fitted to, and their bytes, at most. A larger sample costs one task more time.
FIT_ROWS, FIT_BYTES = 16_384, 40_000_000
#: The duality gap, as a share of the primal objective, that ends the descent; passes after which it raises; the penalty's weight; slope of the score.
TOLERANCE, MOST_PASSES, PENALTY, SLOPE = 0.02, 1000, 0.1, 2.0
#: Labels up to which their table (16 bytes each) travels to the texts; beyond, the texts are shuffled.
BROADCAST_LABELS = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(data: bytes) -> np.ndarray:
    """The distinct buckets of a text's indicators; bucket 0 is the bias, 1 to 9 are repeated words."""
    b = np.frombuffer(data, np.uint8)
    out = [np.zeros(1, np.uint32)]
    x = b.astype(np.uint32)
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + x[j : len(b) - n + 1 + j]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(10 + (h >> np.uint32(8)) % np.uint32(BUCKETS - 10))
    words = data.split()
    if len(words) > 1:
        same = np.fromiter((p == q for p, q in zip(words, words[1:], strict=False)), bool, len(words) - 1)
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        longest = int((edge[1::2] - edge[::2]).max(initial=0))
        out.append(np.arange(1, 1 + min(longest, 9), dtype=np.uint32))
    all_ = np.sort(np.concatenate(out))
    return all_[np.r_[True, all_[1:] != all_[:-1]]].astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            seen[label, features(text.as_py().encode())] += 1
    some = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["bucket", "neg", "pos"])


def log_ratios(train: DataFrame) -> np.ndarray:
    """The log-count ratio of each bucket, over all training rows (text, label)."""
    sums = train.select("text", "label").mapInArrow(_counts, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    count = np.ones((2, BUCKETS))
    count[:, sums["bucket"].to_numpy(np.int64)] += sums[["neg", "pos"]].to_numpy(np.float64).T
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[0] = 1.0
    return ratio


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, tolerance: float = TOLERANCE, most: int = MOST_PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(dual variables, weights over the scaled indicators, relative duality gap, passes) of the hinge loss over rows of unit length.

    RuntimeError if most passes leave a larger gap than the tolerance.
    """
    alpha, w, rng = np.zeros(len(rows)), np.zeros(len(ratio)), np.random.default_rng(7)
    norms = [np.sqrt((ratio[r] ** 2).sum()) for r in rows]
    gap, check = 1.0, 1
    for k in range(1, most + 1):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r] / norms[i]
            new = min(max(alpha[i] + 1 - y[i] * (w[r] @ x), 0.0), c)
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
        if k == check or k == most:
            # a look costs as much as a pass, so looks grow apart
            check = max(k + 1, k * 3 // 2)
            loss = sum(max(0.0, 1 - y[i] * (w[r] @ ratio[r]) / norms[i]) for i, r in enumerate(rows))
            half = 0.5 * float(w @ w)
            gap = (half + c * loss - (alpha.sum() - half)) / max(half + c * loss, 1e-300)
            if gap <= tolerance:
                return alpha, w, gap, k
    raise RuntimeError(f"the descent has a duality gap of {gap:.3f} after {most} passes")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, r, label, ids) of rows (h, r, label, text)."""
    for batch in batches:
        ids = [features(t.as_py().encode()).astype(np.int32) for t in batch.column("text")]
        ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.select(["h", "r", "label"]).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["h", "r", "label", "ids"])


def _descent(shared, c: float, tolerance: float, most: int):
    """One row: the weights, the gap, and how many passes and rows there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            ids = batch.column("ids")
            ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            rows += [flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            labels.append(np.asarray(batch.column("label")))
        if rows:
            _, w, gap, passes = descend(rows, 2 * np.concatenate(labels).astype(np.int64) - 1, shared.value, c, tolerance, most)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([gap]), pa.array([passes], pa.int64()), pa.array([len(rows)], pa.int64())], names=["w", "gap", "passes", "n"])

    return run


def sample(train: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """(h, r, label, text) of the training rows that come first by hash, within both bounds; train has a row number r of its own."""
    hashed = train.withColumn("h", F.xxhash64("doc_id", "text", F.lit(11)))
    first = hashed.select("h", "r", F.octet_length("text").cast("long").alias("size")).orderBy("h", "r").limit(rows)
    # at most rows numbers; the first row counts even if it is over the bound by itself
    so_far = F.sum("size").over(Window.orderBy("h", "r").rowsBetween(Window.unboundedPreceding, 0))
    last = first.withColumn("so_far", so_far).where((F.col("so_far") <= most_bytes) | (F.col("so_far") == F.col("size"))).agg(F.max(F.struct("h", "r")).alias("e")).first()["e"]
    if last is None:
        return hashed.limit(0).select("h", "r", "label", "text")
    return hashed.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("r") <= last["r"]))).select("h", "r", "label", "text")


class Model:
    """Weights per bucket (already scaled by the log-count ratio) and the squared ratios for a text's length.

    gap, passes, n: the duality gap of the fit, and how many passes and texts it took.
    """

    def __init__(self, weights: np.ndarray, squares: np.ndarray, gap: float = 0.0, passes: int = 0, n: int = 0):
        self.weights, self.squares, self.gap, self.passes, self.n = weights, squares, gap, passes, n

    def score(self, data: bytes) -> float:
        f = features(data)
        return float(1 / (1 + np.exp(-SLOPE * self.weights[f].sum() / np.sqrt(self.squares[f].sum()))))


def fit(train: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES, c: float = 1 / PENALTY, tolerance: float = TOLERANCE, passes: int = MOST_PASSES) -> Model:
    """A model from training rows (doc_id, text, label 0 or 1): ratios over all of them, weights over the sample."""
    spark, path = train.sparkSession, shared_dir(train.sparkSession)
    stored = materialize(train.select(F.monotonically_increasing_id().alias("r"), "doc_id", "text", F.col("label").cast("int").alias("label")), path)
    ratio = log_ratios(stored)
    shared = spark.sparkContext.broadcast(ratio)
    chosen = sample(stored, rows, most_bytes).mapInArrow(_featured, "h long, r long, label int, ids array<int>")
    one = chosen.repartition(1).sortWithinPartitions("h", "r").mapInArrow(_descent(shared, c, tolerance, passes), "w binary, gap double, passes long, n long").first()
    discard(spark, path)
    if one is None:
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS))
    return Model(np.frombuffer(one["w"]) * ratio, ratio**2, one["gap"], one["passes"], one["n"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row; the model is a broadcast variable of 4 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py().encode()) for t in batch.column(1)], pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_or_empty(text).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of the labelled documents that may be learned from."""
    lab = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    if lab.count() <= BROADCAST_LABELS:
        lab = F.broadcast(lab)
    return docs.where(~held_out()).select("doc_id", text_or_empty().alias("text")).join(lab, "doc_id")


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
