"""Byte-level BPE by the ranks of a .tiktoken file, long texts in overlapping chunks; decoding.

A text of up to ``chunk`` characters is pre-tokenised where it is read. A longer one is cut into
chunks that overlap, and Spark deals them to tasks, which pre-tokenise them side by side. A chunk
begins anywhere, so its first pre-tokens may be wrong; a pre-token depends only on what follows its
begin, so from the first begin that lies in a chunk and also among those its predecessor found in the
overlap, both agree (they have resynchronised), and there the two are stitched. What stands within
``MARGIN`` characters of a chunk's end does not count, as the cut may have changed it. Chunks that do
not meet (a run of letters longer than the overlap) are joined and pre-tokenised again until all
neighbours meet, so nothing is guessed. By induction from the text's begin every stitch is a begin of
the whole text's own pre-tokens. Each chunk then encodes its pre-tokens between two stitches (it splits
its text once more, which costs less than to store and shuffle every begin), and a document's ids are put
together in order.

Pre-tokens' ids come from the tiktoken library, one pre-token at a time, and are remembered by the task.
Decoding concatenates the bytes of the ids.

Defined results: a null or empty text has no ids and decodes to no bytes; there are no special tokens, so
their strings are ordinary text; repeated rows are encoded alike, also with shared or null ids; ids
that the file lacks raise; an empty table gives an empty result; columns besides the id and the text
are ignored. A pre-token longer than a chunk, which must be merged as a whole, is held by one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, table, text_or_empty

#: Characters of a chunk and of what two share; characters before a chunk's end whose begins do not count.
CHUNK, OVERLAP, MARGIN = 1 << 14, 1 << 9, 16
#: Characters that are split at once, and distinct pre-tokens that a task remembers before it starts anew.
SPLIT_CHARS, REMEMBER = 1 << 20, 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def pretoken_pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def begins(text: str) -> list[int]:
    """Where the pre-tokens of text begin."""
    return [m.start() for m in pretoken_pattern().finditer(text)]


class PretokenEncoder:
    """Ids of pre-tokens; remembers those it has met."""

    def __init__(self, path: str):
        import tiktoken

        # the pattern takes a pre-token whole, so that the library only merges
        self.one = tiktoken.Encoding("pretoken", pat_str="(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, pretokens: list[list[str]]) -> pa.ListArray:
        """The ids of each list of pre-tokens."""
        if len(self.code) > REMEMBER:
            self._forget()
        known = len(self.code)
        code, counts = self.code, np.array([len(p) for p in pretokens], np.int64)
        number = np.fromiter((code.setdefault(p, len(code)) for part in pretokens for p in part), np.int64, int(counts.sum()))
        new = [self.one.encode_ordinary(p) for p in islice(code, known, None)] if len(code) > known else []
        if new:
            self.flat = np.concatenate([self.flat, np.fromiter((i for p in new for i in p), np.int32, sum(map(len, new)))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(p) for p in new])])
        n = self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[number] - (ends - n), n) + np.arange(n.sum())]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of successive groups of some SPLIT_CHARS characters."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < SPLIT_CHARS):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _encode_whole(path: str):
    """(doc_id, ids) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, split = PretokenEncoder(path), pretoken_pattern().findall
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), enc.encode([split(t) for t in texts[a:b]])], names=["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """(doc, k, last, doc_id, start, stop, text) chunks of rows (doc, doc_id, text); the last one is longer than the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                starts = range(0, max(len(text) - overlap, 1), chunk - overlap)
                one = pa.array(np.zeros(len(starts), np.int64) + i)
                k = pa.array(range(len(starts)), pa.int64())
                stops = pa.array([min(s + chunk, len(text)) for s in starts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(one), k, k, batch.column(1).take(one), pa.array(starts, pa.int64()), stops, pa.array([text[s : s + chunk] for s in starts], pa.string())], names=["doc", "k", "last", "doc_id", "start", "stop", "text"])

    return run


def _ends(text: str, start: int, overlap: int) -> tuple[list[int], list[int]]:
    """Begins of pre-tokens that a chunk may share with its predecessor, and with its successor, as places of the whole text."""
    at, stop = np.array(begins(text)) + start, start + len(text)
    return at[at < start + overlap].tolist(), at[(at >= stop - overlap) & (at <= stop - MARGIN)].tolist()


def _pretokenise(overlap: int):
    """Chunks with the begins of pre-tokens near their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_ends(text.as_py(), start.as_py(), overlap) for text, start in zip(batch.column("text"), batch.column("start"), strict=True)]
            both = [pa.array([e[i] for e in ends], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], names=[*batch.schema.names, "head", "tail"])

    return run


def _join(overlap: int):
    """One chunk of neighbours that do not meet, pre-tokenised anew."""

    def run(key, rows):
        rows = rows.sort_by("k")
        parts = rows.column("text").to_pylist()
        text = parts[0] + "".join(p[overlap:] for p in parts[1:])
        first, end = rows.slice(0, 1), rows.slice(rows.num_rows - 1)
        both = [pa.array([x], pa.list_(pa.int64())) for x in _ends(text, first["start"][0].as_py(), overlap)]
        return pa.table([first["doc"], first["k"], end["last"], first["doc_id"], first["start"], end["stop"], pa.array([text], pa.string()), *both], ["doc", "k", "last", "doc_id", "start", "stop", "text", "head", "tail"])

    return run


def stitches(chunks: DataFrame) -> DataFrame:
    """(doc, k, at) of every chunk but a text's first: where it and its predecessor first agree, null if nowhere."""
    before, after = chunks.select("doc", (F.col("last") + 1).alias("k"), "tail"), chunks.where("k > 0").select("doc", "k", "head")
    return after.join(before, ["doc", "k"]).select("doc", "k", F.array_min(F.array_intersect("tail", "head")).alias("at"))


def _encode_pieces(path: str):
    """(doc, k, doc_id, ids) of chunks with the columns begin and end: ids of their pre-tokens between the two."""

    def own(text: str, start: int, begin: int, end: int | None) -> list[str]:
        at = begins(text)
        a, b = np.searchsorted(at, [begin - start, len(text) + 1 if end is None else end - start])
        edges = [*at, len(text)][a : b + 1]
        return [text[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PretokenEncoder(path)
        for batch in batches:
            texts, start, begin, end = (batch.column(c).to_pylist() for c in ("text", "start", "begin", "end"))
            for a, b in _groups(texts):
                ids = enc.encode([own(texts[i], start[i], begin[i], end[i]) for i in range(a, b)])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc", "k", "doc_id")] + [ids], names=["doc", "k", "doc_id", "ids"])

    return run


def stitched_chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks (doc, k, doc_id, start, stop, text, begin, end, ...) of (doc, doc_id, text): each one's own pre-tokens begin from begin to before end."""
    kind = dict(texts.dtypes)["doc_id"]
    fields = f"doc long, k long, last long, doc_id {kind}, start long, stop long, text string"
    path = shared_dir(texts.sparkSession)
    chunks = materialize(texts.select("doc", "doc_id", "text").mapInArrow(_cut(chunk, overlap), fields).repartition("doc", "k").mapInArrow(_pretokenise(overlap), f"{fields}, head array<long>, tail array<long>"), path)
    while True:
        met = materialize(stitches(chunks))
        if met.where("at IS NULL").isEmpty():
            break
        # rows of two numbers each: the chunk with which each one is joined, itself where the two before it meet
        own = chunks.select("doc", "k").join(met.select("doc", "k", F.col("at").isNull().alias("apart")), ["doc", "k"], "left")
        root = F.last(F.when(F.coalesce("apart", F.lit(False)), None).otherwise(F.col("k")), True).over(Window.partitionBy("doc").orderBy("k"))
        roots = own.select("doc", "k", root.alias("root"))
        apart = materialize(roots.join(roots.where("root < k").select("doc", "root").distinct(), ["doc", "root"]))
        joined = chunks.join(apart, ["doc", "k"]).groupBy("doc", "root").applyInArrow(_join(overlap), chunks.schema)
        new = shared_dir(texts.sparkSession)
        chunks, old = materialize(chunks.join(apart, ["doc", "k"], "left_anti").unionByName(joined), new), path
        discard(texts.sparkSession, old)
        path = new
    plan = chunks.select("doc", "k", (F.col("last") + 1).alias("next")).join(met.select("doc", "k", F.col("at").alias("begin")), ["doc", "k"], "left")
    plan = plan.join(met.select("doc", F.col("k").alias("next"), F.col("at").alias("end")), ["doc", "next"], "left")
    return chunks.drop("head", "tail").join(plan.select("doc", "k", F.coalesce("begin", F.lit(0)).alias("begin"), "end"), ["doc", "k"])


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. A chunk holds two overlaps at least, an overlap more than MARGIN."""
    if chunk < 2 * overlap or overlap <= MARGIN:
        raise ValueError("chunks must be twice as long as overlaps, overlaps longer than their margin")
    path, kind = path or default_path(), dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    whole = texts.where(F.length("text") <= chunk).mapInArrow(_encode_whole(path), f"doc_id {kind}, ids array<int>")
    long = stitched_chunks(texts.where(F.length("text") > chunk).withColumn("doc", F.monotonically_increasing_id()), chunk, overlap)
    pieces = long.mapInArrow(_encode_pieces(path), f"doc long, k long, doc_id {kind}, ids array<int>")
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"]))
    return whole.unionByName(pieces.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), in_order.alias("ids")).drop("doc"))


def _decode(path: str):
    """(doc_id, ids, bytes) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = {i: b for b, i in ranks_of(path).items()}
        known = np.zeros(max(spelt) + 1, bool)
        known[list(spelt)] = True
        size = np.zeros(len(known), np.int64)
        size[list(spelt)] = [len(b) for b in spelt.values()]
        at = np.r_[0, np.cumsum(size)]
        letters = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(len(known))), np.uint8)
        for batch in batches:
            lists = batch.column(1).fill_null(pa.scalar([], batch.column(1).type))
            for i in range(0, len(lists), 256):
                part = lists.slice(i, 256)
                ids = np.asarray(part.flatten()).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(known) or not known[ids].all()):
                    raise ValueError("an id is not in the file of ranks")
                n = size[ids]
                ends = np.cumsum(n)
                joined = letters[np.repeat(at[ids] - (ends - n), n) + np.arange(n.sum())]
                offsets = np.r_[0, ends][np.r_[0, np.cumsum(np.asarray(part.value_lengths()))]].astype(np.int32)
                spelled = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), batch.column(1).slice(i, 256), spelled], names=["doc_id", "ids", "bytes"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for, which need not be UTF-8."""
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), f"doc_id {kind}, ids array<int>, bytes binary")


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)


def query(spark, sf_dir) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
