"""Ranked lexical search as a blocked sparse matrix product.

Left stands the item-term matrix (multiplicities, or ones), right the term-document matrix of int64
impacts. The items are dealt to blocks of bounded size; the terms of one block are the vocabulary with
which tasks cut the documents to postings, stored once a block: (doc_id, n, term numbers, occurrences).
From them Spark counts documents, terms and each term's documents; the impacts follow inside the tasks,
where the documents stand in blocks of their own. There the rows of the right matrix that an item's row
names are merged into one dense accumulator (Gustavson), and the best k of the block are kept. A ranking
window, which keeps k rows an item in each task before anything is shuffled, reduces blocks to the result.
Texts stay in the tasks that read them; nothing on the driver grows with the documents.

A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` in doubles; everything after it is int64.

Defined results: a null or empty text has no term; a document without terms counts in no statistic;
each item row is an item of its own, also if it repeats an id, and rows that score nothing are not
returned; repeated documents are ranked one by one; a null doc_id comes last among equal scores; an
empty table on either side gives an empty result; ids may be of any ordered type; other columns are
ignored. An item is one row, so a block holds ``BLOCK_TERMS`` term entries or one item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize, shared_dir, table, text_or_empty

#: What lies between two terms: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Term entries of a block of items, documents and postings of a block of documents, bytes of text split at once.
BLOCK_TERMS, BLOCK_DOCS, BLOCK_POSTINGS, SPLIT_BYTES = 1 << 18, 1 << 15, 1 << 22, 1 << 22


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive (begin, length) whose sizes sum to most, or single rows."""
    group = np.maximum(np.cumsum(sizes) - 1, 0) // most
    cut = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(sizes)]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield a, b - a


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the row of each term, the terms) of some texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), GAP)
    flat, row = lists.flatten(), np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    real = pc.greater(pc.binary_length(flat), 0)
    return row[np.asarray(real)], flat.filter(real)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, term, times) of items (r, text)."""
    for batch in batches:
        for at, n in _slices(np.asarray(pc.binary_length(batch.column(1))), SPLIT_BYTES):
            part = batch.slice(at, n)
            row, terms = _split(part.column(1))
            t = pa.table([part.column(0).take(pa.array(row)), terms], ["r", "term"]).group_by(["r", "term"]).aggregate([([], "count_all")])
            yield from t.rename_columns(["r", "term", "times"]).to_batches()


def _postings(vocabulary: pa.Array):
    """(doc_id, n, terms, tf) of documents (doc_id, text); terms are numbers in vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(vocabulary)
        for batch in batches:
            for at, n in _slices(np.asarray(pc.binary_length(batch.column(1))), SPLIT_BYTES):
                part = batch.slice(at, n)
                row, terms = _split(part.column(1))
                known = np.asarray(pc.index_in(terms, value_set=vocabulary).fill_null(-1)).astype(np.int64)
                hit = known >= 0
                cell, tf = np.unique(row[hit] * v + known[hit], return_counts=True)
                ends = pa.array(np.searchsorted(cell, np.arange(n + 1) * v).astype(np.int32))
                cols = [pa.array(np.bincount(row, minlength=n), pa.int64()), pa.ListArray.from_arrays(ends, pa.array((cell % v).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n", "terms", "tf"])

    return run


class ItemBlock:
    """Rows of the left matrix: items' numbers, where each row begins, its terms in a sorted vocabulary, their factors."""

    def __init__(self, pairs: pa.Table, once: bool):
        pairs = pairs.combine_chunks().sort_by([("r", "ascending"), ("term", "ascending")])
        self.vocabulary = pc.unique(pairs.column("term")).sort()
        self.terms = np.asarray(pc.index_in(pairs.column("term"), value_set=self.vocabulary)).astype(np.int64)
        self.items, first = np.unique(np.asarray(pairs.column("r")), return_index=True)
        self.begin = np.r_[first, pairs.num_rows]
        self.factor = np.ones(pairs.num_rows, np.int64) if once else np.asarray(pairs.column("times")).astype(np.int64)


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores, highest first; of equal ones the first places."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-score[at], kind="stable")][:k]


def _product(left: ItemBlock, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(r, doc_id, score): the best k of each block of documents for each item of left."""

    def merged(block: pa.Table) -> pa.RecordBatch:
        block = block.take(pc.sort_indices(block, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        n = np.asarray(block.column("n")).astype(np.int64)
        lists = block.column("terms").combine_chunks()
        doc, term = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten()).astype(np.int64)
        tf = np.asarray(block.column("tf").combine_chunks().flatten()).astype(np.int64)
        m = 10 + (90 * n * n_docs) // n_terms
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        doc, impact = doc[order], impact[order]
        row = np.searchsorted(term[order], np.arange(len(weight) + 1)).tolist()
        items, docs, scores = [], [], []
        for i, r in enumerate(left.items.tolist()):
            score = np.zeros(len(n), np.int64)
            for t, f in zip(left.terms[left.begin[i] : left.begin[i + 1]].tolist(), left.factor[left.begin[i] : left.begin[i + 1]].tolist(), strict=True):
                a, b = row[t], row[t + 1]
                if b > a:  # a document occurs once in a row, so plain indexing adds
                    score[doc[a:b]] += f * impact[a:b]
            top = best(score, k)
            items.append(np.full(len(top), r))
            docs.append(top)
            scores.append(score[top])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(items), pa.int64()), block.column("doc_id").combine_chunks().take(pa.array(cat(docs), pa.int64())), pa.array(cat(scores), pa.int64())], names=["r", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs, entries = docs + batch.num_rows, entries + len(batch.column(2).flatten())
            if docs >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
                yield merged(pa.Table.from_batches(held))
                held, docs, entries = [], 0, 0
        if docs:
            yield merged(pa.Table.from_batches(held))

    return run


def _blocks(pairs: DataFrame, most: int) -> tuple[int, object]:
    """How many blocks of items, and the column that gives an item's: none has over most entries, but a single item may."""
    sizes = pairs.groupBy("r").agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n = 1 if total <= most else -(-2 * total // most)
    while True:
        block = F.pmod(F.xxhash64("r", F.lit(13)), F.lit(n))
        if n == 1 or sizes.groupBy(block.alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= max(most, largest):
            return (n if total else 0), block
        n *= 2


def search(items: DataFrame, docs: DataFrame, k: int = 10, once: bool = True, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each item.

    once: each term of an item counts once; otherwise as often as the item has it.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("r"), F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text")))
    pairs = materialize(numbered.select("r", "text").mapInArrow(_pairs, "r long, term string, times long"))
    n_blocks, block = _blocks(pairs, BLOCK_TERMS)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    by = Window.partitionBy("r").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = []
    for b in range(n_blocks):
        left = ItemBlock(pairs.where(block == b).toArrow(), once)
        if not len(left.items):
            continue
        path = shared_dir(spark)
        postings = materialize(texts.mapInArrow(_postings(left.vocabulary), f"doc_id {kind}, n long, terms array<int>, tf array<long>"), path)
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_terms:
            df = np.zeros(len(left.vocabulary), np.int64)
            holding = postings.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
            df[np.asarray(holding.column("t"))] = np.asarray(holding.column("count"))
            near = postings.mapInArrow(_product(left, term_weights(df, n_docs), n_docs, n_terms, k), f"r long, doc_id {kind}, score long")
            top = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            found.append(materialize(top))
        discard(spark, path)
    if not found:
        empty = spark.createDataFrame([], f"r long, doc_id {kind}, score long, rank int")
        found = [empty]
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked.join(numbered.select("r", "item_id"), "r").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
q AS (SELECT i, item_id, unnest(t) AS term FROM i),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
b AS (SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * n_docs) // n_terms))) AS impact FROM p JOIN w USING (term) JOIN d ON d.r = p.r, s),
c AS (SELECT q.i, any_value(q.item_id) AS item_id, b.r, sum(impact)::BIGINT AS score FROM q JOIN b USING (term) GROUP BY q.i, b.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM c JOIN d ON d.r = c.r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""
