"""Ranked search against a brute-force version, with every odd case."""

import collections
import math
import random
import re

import duckdb
import pytest

from lumenframe.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(items, docs, k=10, once=True):
    of = [(d, collections.Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in of]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = collections.Counter(t for _, c in of for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), size in zip(of, sizes, strict=True):
            score = sum(f * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t, f in collections.Counter(terms(text)).items() if c[t] for f in [1 if once else f])
            if score > 0:
                scored.append((-score, d is None, d, score))
        scored.sort(key=lambda x: (x[0], x[1], str(x[2]) if isinstance(x[2], str) else x[2] or 0))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcDEFé3") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, say(rng.randint(1, 30))) for i in range(60)] + [(100, None), (101, ""), (102, "!?"), (103, "\u0085 ÀÉ"), (104, say(20000)), (None, "abc"), (None, "abc"), (7, "abc"), (7, "abc"), (3, "abc")]
    items = [(i, say(rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, "abc"), (23, "Abc abc ABC x"), (23, "Abc abc ABC x"), (24, "ÀÉ"), (25, say(3000))]
    return items, docs


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def frames(spark, items, docs, kind="long"):
    d = [(i, t, "clash", 1, 2, 3) for i, t in docs]
    random.Random(2).shuffle(d)
    docs = spark.createDataFrame(d, f"doc_id {kind}, text string, item_id string, rank int, score int, r int").repartition(3)
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2), docs


@pytest.mark.parametrize("once", [True, False])
def test_search(spark, once):
    items, docs = corpus()
    assert rows(lexical_search.search(*frames(spark, items, docs), once=once)) == by_hand(items, docs, once=once)


def test_small_blocks_change_nothing(spark, monkeypatch):
    items, docs = corpus()
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical_search, "SPLIT_BYTES", 50)
    left, right = frames(spark, items, docs)
    pairs = spark.createDataFrame([(r, t) for r, (_, x) in enumerate(items) for t in set(terms(x))], "r long, term string")
    n, block = lexical_search._blocks(pairs, 40)
    sizes = {b["b"]: b for b in pairs.groupBy(block.alias("b")).agg({"term": "count", "r": "approx_count_distinct"}).collect()}
    assert n > 5 and all(b[1] <= 40 or b[2] == 1 or b[1] <= len(set(terms(items[-1][1]))) for b in sizes.values())
    assert rows(lexical_search.search(left, right, k=3)) == by_hand(items, docs, 3)


def test_blocks_of_documents(monkeypatch):
    """Each block of documents gives its own best; places of equal scores are by id."""
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 2)
    left = lexical_search.ItemBlock(pa.table({"r": [5, 5], "term": ["b", "a"], "times": [1, 2]}), True)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([2]), pa.array([[0, 1]], pa.list_(pa.int32())), pa.array([[1, 1]], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"]) for i in (9, 4, 6)]
    import numpy as np

    out = [b.to_pydict() for b in lexical_search._product(left, np.array([1, 2]), 3, 6, 1)(iter(batches))]
    assert [o["doc_id"] for o in out] == [[4], [6]] and out[0]["score"] == out[1]["score"]


def test_string_ids(spark):
    items, docs = corpus()
    docs = [(None if d is None else f"d{d:03}", t) for d, t in docs]
    assert rows(lexical_search.search(*frames(spark, items, docs, "string"))) == by_hand(items, docs)


def test_empty_tables(spark):
    items, docs = corpus()
    for i, d in ((items, []), ([], docs), ([], []), (items, [(1, None), (2, "?")])):
        assert lexical_search.search(*frames(spark, i, d)).collect() == []


def test_query_equals_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = lexical_search.query(spark, d)
    want = con.sql(lexical_search.SQL)
    assert got.columns == want.columns and rows(got) == sorted(want.fetchall(), key=repr)
