"""Overlapping chunk encoding against the library, with every odd case."""

import hashlib
import random
import sys

import pyarrow as pa
import pytest
import tiktoken

from lumenframe.llm import chunked_bpe

SCHEMA = "doc_id long, text string, ids string, k int, doc int, start string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunked_bpe.ranks_of(chunked_bpe.default_path()), special_tokens={})


def texts():
    rng = random.Random(4)
    bits = ["'re", "'", "re", " ", "  ", "\n", " \n", "\t", "word", "Ünï", "日本語", "123", "!?", "🙂", " ", "é", "'ll", "x"]
    long = ["".join(rng.choice(bits) for _ in range(n)) for n in (3, 50, 90, 400, 4000)]
    runs = ["a" * 500, " " * 700 + "b", "1" * 333 + " " * 90 + "ab c " * 30, "ab " * 40 + "z" * 300 + " cd" * 60 + "y" * 200 + "\n" * 150, "'" * 300, "é" * 129, " a" * 200, "x" * 64, "x" * 65, "\U0001f642" * 150]
    return [None, "", " ", "a", "<|endoftext|>", *long, *runs, long[3], long[3]]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "x") for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize("chunk, overlap", [(64, 32), (97, 20), (1 << 14, 1 << 9)])
def test_equals_library(spark, library, chunk, overlap):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts())] + [(3, texts()[8])]
    got = chunked_bpe.decode(chunked_bpe.encode(frame(spark, rows), chunk=chunk, overlap=overlap)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted([(r.doc_id, r.ids, bytes(r.bytes)) for r in got], key=key) == sorted(want, key=key)


def test_every_character(library):
    """Each code point among letters, spaces and digits is split as the library splits it."""
    enc = chunked_bpe.PretokenEncoder(chunked_bpe.default_path())
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        part = [f"a{chr(c)} {chr(c)}{chr(c)}1{chr(c)}\n" for c in points[at : at + 4096]]
        got = enc.encode([chunked_bpe.pretoken_pattern().findall(t) for t in part]).to_pylist()
        assert got == library.encode_ordinary_batch(part)


def test_stitches_lie_on_true_begins(spark):
    text = texts()[9]
    frame = spark.createDataFrame([(1, 7, text)], "doc long, doc_id long, text string")
    got = chunked_bpe.stitched_chunks(frame, 80, 40).orderBy("k").collect()
    true = set(chunked_bpe.begins(text))
    assert len(got) > 50 and all(r.begin in true for r in got)
    assert [r.end for r in got[:-1]] == [r.begin for r in got[1:]] and got[-1].end is None


def test_long_runs_are_joined(spark):
    frame = spark.createDataFrame([(1, 7, "a" * 1000 + " b" * 300)], "doc long, doc_id long, text string")
    sizes = [len(r.text) for r in chunked_bpe.stitched_chunks(frame, 80, 40).orderBy("k").collect()]
    assert sizes[0] > 1000 and max(sizes[1:]) == 80


def test_unknown_ids_raise():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[1 << 20]], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    with pytest.raises(ValueError, match="not in the file"):
        list(chunked_bpe._decode(chunked_bpe.default_path())(iter([batch])))


def test_decoding_gives_raw_bytes(spark):
    """Ids that cut a character are bytes, not replacement characters; null ids are none."""
    one = chunked_bpe.ranks_of(chunked_bpe.default_path())[b"\xc3"]
    got = chunked_bpe.decode(spark.createDataFrame([("a", [one]), ("b", None), ("c", [])], "doc_id string, ids array<int>")).collect()
    assert {r.doc_id: bytes(r.bytes) for r in got} == {"a": b"\xc3", "b": b"", "c": b""}


def test_empty_table_and_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chunked_bpe.decode(chunked_bpe.encode(empty)).collect() == []
    with pytest.raises(ValueError):
        chunked_bpe.encode(empty, chunk=63, overlap=32)


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = chunked_bpe.query(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {tuple(r) for r in got.collect()} == want and len(want) == len(docs)
