"""Substring deduplication by Rabin-Karp hashes of every window of so many words.

Words are hashed by built-in expressions; a window's hash is a polynomial of its word hashes
modulo 2^64, computed for all windows of a chunk of documents at once. Windows travel in runs:
neighbouring windows share their smallest inner run of ``INNER`` words (the minimizer), equal
windows have equal minimizers, so one row carries a run's place and 48 bits of each window's hash
and is dealt by the 64-bit minimizer. A chunk of documents first settles its own repeats, so a
passage that many documents share leaves a map task once per chunk. Minimizers that a sample of
the documents shows to be hot (at most some hundreds, a bounded list) are divided further by their
windows' hashes; the sample steers the dealing and never the result. Spark then takes the runs
apart into windows and ranks each window's places (smallest doc_id, then start) where they were
dealt, without another shuffle: the first place stays and every later one is removed. Removed
windows merge into maximal intervals of words. Two windows count as equal when their minimizers'
64 bits and 48 bits of their own hashes agree.

A document is a doc_id with a text (by the text's XXH64). Defined results: a null or empty text has
no words; rows with one doc_id and the same text are one document; rows that share a doc_id with
different texts are documents of their own, ordered by text hash; a row without an id keeps every
word and claims none; an empty table gives an empty result; other columns are carried by
``drop_repeated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, table, text_or_empty, unboxed, words_of

#: Words of a minimizer; windows that a chunk holds at once; one document in so many is looked at for hot minimizers.
INNER, CHUNK, LOOK = 6, 1 << 19, 64
#: A minimizer is hot from this share of the sampled runs (and count) on; it is divided into so many parts.
HOT_SHARE, HOT_LEAST, PARTS = 0.002, 50, 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
#: Bytes of a window's hash in a run.
SIX = 6
RUNS = "key long, doc_id long, th long, start int, done int, hashes binary"
SPANS = "doc_id long, th long, start int, end int"


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of each run of n word hashes: sum of h[i + j] * BASE ** (n - 1 - j), modulo 2^64."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * BASE + h[j : len(h) - n + 1 + j]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, text hash, start, window hash, minimizer) of all windows of some documents, until a chunk is full."""
    held, n = [], 0
    for batch in batches:
        words = batch.column(2)
        ends, flat = np.asarray(words.offsets).astype(np.int64), np.asarray(words.values).view(np.uint64)
        ids, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        at = 0
        while at < len(ids):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
            count = np.diff(ends[at : upto + 1]) - size + 1
            h = flat[ends[at] : ends[upto]]
            keep = count > 0
            if keep.any():
                win, low = _rolling(h, size), _sliding_min(_mix(_rolling(h, INNER)), size - INNER + 1)
                off = np.repeat((ends[at:upto] - ends[at])[keep], count[keep])
                start = np.arange(len(off)) - np.repeat(np.cumsum(count[keep]) - count[keep], count[keep])
                held.append((np.repeat(ids[at:upto][keep], count[keep]), np.repeat(texts[at:upto][keep], count[keep]), start, win[off + start], low[off + start]))
                n += len(off)
            at = upto
            if n >= CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _later(doc: np.ndarray, th: np.ndarray, start: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at an earlier place."""
    order = np.argsort(hashes[0], kind="stable")
    same = hashes[0][order[1:]] == hashes[0][order[:-1]]
    some = order[np.r_[False, same] | np.r_[same, False]]
    out = np.zeros(len(doc), bool)
    if len(some):
        some = some[np.lexsort((start[some], th[some], doc[some], *[h[some] for h in hashes[1:]], hashes[0][some]))]
        eq = np.ones(len(some) - 1, bool)
        for h in hashes:
            eq &= h[some[1:]] == h[some[:-1]]
        lead = np.maximum.accumulate(np.where(np.r_[True, ~eq], np.arange(len(some)), 0))
        # a repeated row stands at its leader's own place and is no later occurrence
        first = some[lead]
        out[some[(doc[some] != doc[first]) | (th[some] != th[first]) | (start[some] != start[first])]] = True
    return out


def _runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where a run of neighbouring windows with one minimizer begins."""
    if not len(doc):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1) | (low[1:] != low[:-1])])


def _six(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIX])


def _blocks(doc, th, start, win, key) -> Iterator[pa.RecordBatch]:
    """One row per run: its key, place and the windows' hashes, six bytes each."""
    first = _runs(doc, th, start, key)
    ends = np.r_[first[1:], len(doc)]
    for at in range(0, len(first), 1 << 16):
        a, b = first[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        data = _six(_mix(win[a[0] : b[-1]])).reshape(-1)
        offsets = (np.r_[a, b[-1]] - a[0]) * SIX
        hashes = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(key[a].view(np.int64)), pa.array(doc[a]), pa.array(th[a]), pa.array(start[a].astype(np.int32)), pa.nulls(len(a), pa.int32()), hashes], names=_names(RUNS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _spans(doc, th, start, size: int) -> tuple[np.ndarray, ...]:
    """(doc, text hash, start, end): maximal intervals of words under windows given by place."""
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + size)]) if len(doc) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(doc)] - 1 if len(doc) else first
    return doc[first], th[first], start[first].astype(np.int32), (start[last] + size).astype(np.int32)


def _map(size: int, hot: np.ndarray):
    """Rows to be dealt; a chunk's own repeats become rows without hashes, with any key and done, their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, th, start, win, low in _chunks(batches, size):
            later = _later(doc, th, start, win, low)
            d, t, s, e = _spans(doc[later], th[later], start[later], size)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(_mix(t.view(np.uint64)).view(np.int64)), pa.array(d), pa.array(t), pa.array(s), pa.array(e - s), pa.nulls(len(d), pa.binary())], names=_names(RUNS))
            doc, th, start, win, low = doc[~later], th[~later], start[~later], win[~later], low[~later]
            if len(hot):
                is_hot = np.isin(low, hot)
                low = np.where(is_hot, _mix(low + (_mix(win) >> np.uint64(40)) % np.uint64(PARTS)), low)
            yield from _blocks(doc, th, start, win, low)

    return run


def _merge(size: int):
    """Places of removed windows (done: null) and intervals, as fewer intervals, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "start"))
            done = batch.column("done").fill_null(0).to_numpy(zero_copy_only=False)
            new = done == 0
            whole = doc[~new], th[~new], start[~new], start[~new] + done[~new]
            for out in (whole, _spans(doc[new], th[new], start[new], size)):
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=_names(SPANS))

    return run


def _count_hot(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, th, start, _, low in _chunks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(low[_runs(doc, th, start, low)].view(np.int64))], names=["key"])

    return run


def removal_spans(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, start, end): intervals of words under windows that also start earlier; they may overlap."""
    t = text_or_empty(text)
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), F.transform(words_of(t), lambda w: F.xxhash64(w)).alias("w"))
    seen = words.where(F.pmod(F.col("th"), F.lit(LOOK)) == 0).mapInArrow(_count_hot(size), "key long").groupBy("key").agg(F.count("*").alias("n"))
    seen = materialize(seen)
    # each hot key holds at least HOT_SHARE of the sample, so there are at most 1 / HOT_SHARE
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = [r["key"] for r in seen.where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * total)).collect()]
    runs = words.mapInArrow(_map(size, np.array(hot, np.int64).view(np.uint64)), RUNS)
    last = F.coalesce((F.length("hashes") / SIX).cast("int") - 1, F.lit(0))
    windows = runs.repartition("key").select("key", "doc_id", "th", "start", "done", "hashes", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    windows = windows.select("key", F.substring("hashes", SIX * F.col("i") + 1, F.lit(SIX)).alias("h"), "doc_id", "th", (F.col("start") + F.col("i")).alias("start"), "done")
    place = F.dense_rank().over(Window.partitionBy("key", "h").orderBy("doc_id", "th", "start"))
    later = windows.withColumn("place", place).where("place > 1 OR done IS NOT NULL")
    return later.select("doc_id", "th", "start", "done").mapInArrow(_merge(size), SPANS)


def kept_words(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the columns of docs), n_words, n_removed and kept (the words that stay, joined by one space)."""
    spans = removal_spans(docs, size, id_col, text).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")).hint("shuffle_hash")
    t = text_or_empty(F.col("row").getField(text))
    joined = boxed(docs).join(spans, (F.col("row").getField(id_col) == F.col("doc_id")) & (F.xxhash64(t) == F.col("th")), "left").withColumn("words", words_of(t))
    words, n = F.col("words"), F.size("words")
    cut = joined.withColumn("gone", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join(words, " ")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(words, i)), " "))
    return cut.select("row", n.cast("long").alias("n_words"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def drop_repeated(docs: DataFrame, size: int = 20) -> DataFrame:
    """docs with repeated passages gone; a text that loses words becomes its kept words, others stay as they are."""
    return unboxed(kept_words(docs, size), text=F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row").getField("text")))


def query(spark, sf_dir) -> DataFrame:
    out = kept_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 18), lambda i: {'i': i, 'g': array_to_string(words[i:i+19], ' ')})) AS x FROM w WHERE len(words) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, x.i AS i, row_number() OVER (PARTITION BY x.g ORDER BY doc_id, x.i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM later)),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
