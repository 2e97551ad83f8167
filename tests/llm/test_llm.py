"""Each operator of lumenframe.llm against a brute-force version, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import (
    bpe,
    components,
    exact_dedup,
    gated_lm,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    tokenizer_files,
)
from lumenframe.llm.common import shared_dir
from lumenframe.llm.tokenizer_files import default_path, library_encoder, rank_encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key int, id string"


def corpus():
    """Texts with copies, near copies, shared lines and passages, junk, nulls, empties, and one long text."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(60), "A line that many Documents share"
    texts = [None, "", " ", "\n\n", "  \t a  b ", "one two", "!!!!!!! #### $$$ %%% &&& ||| <<< >>> ***", "aaaa " * 40, "ÀÉ x\u0085y z \x1c q", "a<|endoftext|>b", say(9000)]
    for i in range(40):
        body = say(rng.randint(30, 200))
        texts.append(body if i % 3 else f"{line}\n{body}\n  {line.upper()} \n{passage if i % 2 else ''}\n{body[:90]}")
    base = say(150)
    texts += [base, base, base.replace(" ", "  "), base]
    for i in range(6):
        w = base.split(" ")
        w[20 * i + 3] = "changed"
        texts.append(" ".join(w))
    texts += [passage + " " + say(5), say(5) + " " + passage + " " + passage]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(i * 7 + 1, texts[i], None if i % 5 else "en", "s", None, "clash", 1, "x") for i in order]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return WORD.findall(t or "")


def ids_of(texts):
    return {i * 7 + 1: t for i, t in enumerate(texts)}


# quality rules


def test_quality_measures(docs, texts):
    got = by_id(quality_rules.ledger(docs))
    for d, t in ids_of(texts).items():
        w = words(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_symbols == sum(x in "#*$%&|<>" for x in t or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert bool(r.fail_bits & 1) == (len(w) < 10) and bool(r.fail_bits & 2) == (100 * len(covered) > 20 * len(w))


def test_quality_policies_and_ablation(docs, empty):
    kept = quality_rules.judge(docs)
    assert kept.columns == docs.columns
    led = quality_rules.ledger(docs).persist()
    bits = [r.fail_bits for r in led.collect()]
    assert kept.count() == sum(b & quality_rules.DEFAULT.mask == 0 for b in bits)
    for r in quality_rules.ablation(led).collect():
        m, bit = quality_rules.DEFAULT.mask, 1 << quality_rules.RULES[r.rule]
        assert r.n_rejected == sum(bool(b & bit) for b in bits) and r.n_only == sum(b & m == bit for b in bits)
        assert r.n_kept_without == sum(b & m & ~bit == 0 for b in bits)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.ledger(empty).count() == 0
    assert {r.n_kept for r in quality_rules.ablation(quality_rules.ledger(empty)).collect()} == {0}


def test_quality_policies_over_one_stored_ledger(spark, docs, tmp_path):
    path = quality_rules.store(quality_rules.ledger(docs), str(tmp_path / "ledger"))
    led = quality_rules.open_ledger(spark, path)
    for policy in (quality_rules.DEFAULT, quality_rules.LENIENT):
        n = led.where(quality_rules.verdict(F.col("fail_bits"), policy)).count()
        assert {r.n_kept for r in quality_rules.ablation(led, policy).collect()} == {n} and n == quality_rules.judge(docs, policy).count()
    led.withColumn("rule_set", F.lit("rules-0")).write.parquet(str(tmp_path / "older"))
    with pytest.raises(ValueError, match="rules-1"):
        quality_rules.open_ledger(spark, str(tmp_path / "older"))


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "x " * 30)], "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("fail_bits", F.lit(0))
    got = collections.Counter((r.doc_id, r.n_words, r.fail_bits & 3) for r in quality_rules.ledger(df).collect())
    assert got == collections.Counter({(None, 2, 1): 2, (3, 0, 1): 1, (3, 30, 2): 1})
    assert quality_rules.judge(df).columns == df.columns


# exact dedup


def test_exact_dedup(spark, docs, texts, empty):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in ids_of(texts).items()}
    groups = collections.defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    for r in exact_dedup.classes(docs).collect():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(g), len(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert exact_dedup.classes(docs).count() == len(texts)
    assert exact_dedup.classes(empty).count() == 0


def test_exact_dedup_index_splits_and_grows(spark, docs, texts):
    small = 2000
    first = exact_dedup.insert(docs.where("doc_id < 150"), None, bucket_bytes=small)
    files = {p: p.stat().st_mtime_ns for p in Path(first.path).glob("buckets/*/*.parquet")}
    one = exact_dedup.insert(docs.where("doc_id >= 150"), first, bucket_bytes=small)
    assert one.depth >= 2 and sum(0.5**b.depth for b in one.buckets) == 1.0
    got = {r.text: (r.first, r.n) for r in exact_dedup.open_index(spark, one).collect()}
    want = collections.defaultdict(list)
    for d, t in ids_of(texts).items():
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    assert got == {t: (min(g), len(g)) for t, g in want.items()}
    # a batch of one short text writes its own bucket only; the version before it can still be read
    two = exact_dedup.insert(spark.createDataFrame([(5000, "a new short text")], "doc_id long, text string"), one, bucket_bytes=1 << 20)
    kept = {b.number for b in one.buckets} & {b.number for b in two.buckets}
    assert len(kept) == len(one.buckets) - 1 and len(two.buckets) == len(one.buckets)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert exact_dedup.open_index(spark, two).count() == len(want) + 1
    assert exact_dedup.open_index(spark, exact_dedup.Directory.open(spark, one.path, one.version)).count() == len(want)


def test_exact_dedup_splits_double_the_directory_when_they_must():
    b = exact_dedup.Bucket(0, 0)
    got = exact_dedup._divided(b, {0: (5, 1, 2), 3: (5, 3, 4), 12: (3, 7, 9)}, 4, 6)
    assert [(x.slot, x.depth, x.bytes, s) for x, s in got] == [(0, 3, 5, True), (1, 3, 5, True), (1, 2, 0, True), (1, 1, 3, True)]
    assert exact_dedup._divided(b, {0: (50, 1, 1)}, 4, 6) == [(exact_dedup.Bucket(0, 0, 0, 50), True)]
    assert [s for _, s in exact_dedup._divided(b, {0: (50, 1, 2)}, 0, 6)] == [False]


def test_exact_dedup_keeps_one_row_of_each_text(spark, empty):
    rows = [(2, "a  b"), (2, "a b"), (5, "a b"), (None, "a b"), (None, "c"), (None, "c"), (7, None), (8, ""), (2, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("sha", F.lit(1)).withColumn("row", F.lit(2))
    got = exact_dedup.classes(df).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == collections.Counter({(2, 2, 4): 2, (5, 2, 4): 1, (None, 2, 4): 1, (None, None, 2): 2, (7, 7, 2): 1, (8, 7, 2): 1, (2, 2, 1): 1})
    assert all(r.kept is not None for r in got)
    assert collections.Counter((r.doc_id, r.group_size) for r in got if r.kept) == collections.Counter([(2, 4), (None, 2), (7, 2), (2, 1)])
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert collections.Counter((r.doc_id, " ".join((r.text or "").split())) for r in kept.collect()) == collections.Counter([(2, "a b"), (None, "c"), (7, ""), (2, "other")])
    assert exact_dedup.keep_first(empty).count() == 0


def test_exact_dedup_one_key_cannot_split(spark):
    df = spark.createDataFrame([(i, "same text " * 50) for i in range(300)] + [(None, "same text " * 50)], "doc_id long, text string")
    r = exact_dedup.classes(df).select("keep_id", "group_size").distinct().collect()
    assert [(x.keep_id, x.group_size) for x in r] == [(0, 301)]


# line dedup


def lines_by_hand(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), d), d)
    out = {}
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or first[key(x)] == d]
        out[d] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(docs, texts, batches):
    want = lines_by_hand(list(ids_of(texts).items()))
    got = line_dedup.kept_lines(docs, batches=batches, fanout=2).collect()
    assert {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want
    assert len(got) == len(texts)


def test_line_dedup_odd_rows(spark, empty):
    long = "this line is long enough"
    df = spark.createDataFrame([(1, long), (1, long), (1, "other\n" + long), (None, long), (2, long + "\nx"), (2, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.drop_repeated(df).collect())
    assert got == collections.Counter([(1, long), (1, long), (1, "other\n" + long), (None, long), (2, "x"), (2, None)])
    assert line_dedup.drop_repeated(empty).collect() == [] and line_dedup.drop_repeated(empty).columns == empty.columns


# simhash


def test_line_dedup_runs_are_kept_and_read_as_sorted(spark):
    runs = line_dedup.SortedRuns(spark, 4, fanout=2)
    try:
        df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
        one, two, three = "the first long line", "the second long line", "the third long line"
        assert line_dedup.repeated_lines(df([(5, one), (6, one)]), batches=1, store=runs).select("id").collect()[0].id == 6
        again = line_dedup.SortedRuns.open(spark, runs.name, fanout=2)
        got = line_dedup.repeated_lines(df([(1, one + "\n" + two), (2, two)]), batches=1, store=again).collect()
        assert {r.id: r.dropped for r in got} == {1: [0], 2: [0]}
        assert [len(level) for level in again.levels] == [0, 1]
        # one file per bucket after the merge of a level; the merged run is read without a sort or an exchange
        assert spark.table(again.runs()[0]).select(F.input_file_name()).distinct().count() <= 4
        with line_dedup._runs_as_sorted(spark):
            batch = spark.range(10).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
            plan = batch.join(spark.table(again.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        assert "SortMergeJoin" in physical and physical.count("Sort [") == 1 and physical.count("Exchange") == 1
        line_dedup.repeated_lines(df([(9, three)]), batches=1, store=again)
        assert [len(level) for level in again.levels] == [1, 1]
    finally:
        runs.drop()
        again.drop()


def simhash_by_hand(t, size):
    w = words((t or "").translate(LOWER))
    g = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, distance):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(fps.items())
    for i, (a, f) in enumerate(items):
        for b, g in items[:i]:
            if (f ^ g).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in fps}


def test_simhash(docs, texts, empty):
    fps = {d: simhash_by_hand(t, 3) for d, t in ids_of(texts).items()}
    comp = linked(fps, 3)
    got = by_id(simhash.near_duplicates(docs, size=3))
    assert {d: (r.f0 & (1 << 64) - 1, r.component_id) for d, r in got.items()} == {d: (fps[d], comp[d]) for d in fps}
    assert simhash.near_duplicates(empty, size=3).count() == 0 and simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash_dense_buckets(spark, monkeypatch, tile):
    """Large buckets are divided again and compared tile by tile, with the same components."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {}
    for c in centres:
        for _ in range(60):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.setdefault(f, len(fps))
    table = {i: f for f, i in fps.items()}
    monkeypatch.setattr(simhash, "TILE", tile)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()], "id long, f0 long")
    masks = simhash.pigeonhole(3, 5)
    finer = {k: [m | x for x in simhash.pigeonhole(3, 5, [b for b in range(64) if not m >> b & 1])] for k, m in enumerate(masks)}
    edges = simhash.links(df, masks, 3, 1, finer)
    got = {r.vertex: r.root for r in components.components(edges).collect()}
    want = linked(table, 3)
    assert {i: got.get(i, i) for i in table} == want


def test_simhash_similarity_keeps_one(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(300)]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 1 + i % 4):
            v = list(w)
            v[50 * k] = "other"
            rows.append((10 * i + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(df, distance=None).collect()}
    assert kept == {10 * i for i in range(60)}


@pytest.mark.parametrize("tile", [2048, 3])
def test_simhash_jaccard_by_brute_force(spark, monkeypatch, tile):
    """Pairs of similarity 0.65 to 0.95: none below 0.8 is linked, of the others nearly all are."""
    rng, rows, alike = random.Random(3), [], {}
    monkeypatch.setattr(simhash, "TILE", tile)
    for i in range(300):
        w = [f"w{rng.randrange(100000)}" for _ in range(304)]
        v = w[: 304 - rng.randint(4, 64)]
        v += [f"w{rng.randrange(100000)}" for _ in range(304 - len(v))]
        a, b = ({tuple(x[k : k + 5]) for k in range(300)} for x in (w, v))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        alike[2 * i + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), size=5, distance=None, jaccard=0.8).collect()}
    below, above = {d for d, j in alike.items() if j < 0.8}, {d for d, j in alike.items() if j >= 0.8}
    assert min(len(below), len(above)) > 50 and below <= kept
    assert len(above & kept) <= 0.02 * len(above)


def test_simhash_null_ids_and_shared_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x y z"
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (None, a), (None, "zz yy xx")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == collections.Counter({(5, 3): 2, (3, 3): 1, (None, 3): 1, (None, None): 1})


@pytest.mark.parametrize("distance", [3, None])
def test_simhash_keeps_one_row_of_each_component(spark, distance):
    a, b, c = "a b c d e f g h", "q r s t u v w x y z", "k l m n o p q r s t"
    rows = [(3, a, "en"), (None, a, "en"), (None, c, "en"), (None, c, "de"), (7, b, "en"), (7, b, "en"), (8, b, "fr"), (None, None, "en"), (None, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("th", F.lit(1)).withColumn("row", F.lit("clash"))
    out = simhash.keep_first(df, distance=distance)
    assert out.columns == df.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in out.collect()) == collections.Counter([(3, a), (None, c), (7, b), (None, "")])


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (200, 7)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}


# substring dedup


def substring_by_hand(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                gone |= set(range(i, i + size))
            seen.add(g)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("size, chunk, hot", [(20, 1 << 19, 50), (20, 64, 1), (8, 512, 1)])
def test_substring_dedup(docs, texts, monkeypatch, size, chunk, hot):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "LOOK", 2)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.kept_words(docs, size).collect()}
    assert got == substring_by_hand(list(ids_of(texts).items()), size)


def test_substring_dedup_odd_rows(spark, empty):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (9, t + " tail"), (1, None), (2, "a  b")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in substring_dedup.drop_repeated(df).collect())
    assert got == collections.Counter([(4, t), (4, t), (None, t), (9, "tail"), (1, None), (2, "a  b")])
    assert substring_dedup.drop_repeated(empty).count() == 0


def test_substring_dedup_rows_that_share_an_id_keep_their_own_words(spark):
    t, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (2, t), (2, "only three words"), (2, other), (3, other + " " + t)], "doc_id long, text string")
    got = collections.Counter((r.row.doc_id, r.row.text, r.n_words, r.n_removed, r.kept) for r in substring_dedup.kept_words(df).collect())
    assert got == collections.Counter([(1, t, 30, 0, t), (2, t, 30, 30, ""), (2, "only three words", 3, 0, "only three words"), (2, other, 40, 0, other), (3, other + " " + t, 70, 70, "")])


# tokens, packing, byte-pair encoding


def test_rank_encoder_equals_library(texts):
    lib, fast = library_encoder(default_path()), rank_encoder(default_path())
    more = [f"a{chr(c)}b {chr(c)} 1{chr(c)}\n{chr(c)}" for c in range(1, 0x3100)]
    for t in [x or "" for x in texts] + more:
        assert lib.encode(t, add_special_tokens=False).ids == fast.encode(t, allowed_special="all")


def test_token_counts_and_cache(spark, docs, texts, empty):
    lib, cache = library_encoder(default_path()), shared_dir(spark)
    got = by_id(token_counts.count_tokens(docs.where("doc_id < 200"), cache))
    size = spark.read.parquet(cache).count()
    assert size == len({(t or "") for d, t in ids_of(texts).items() if d < 200})
    got = by_id(token_counts.count_tokens(docs, cache))
    assert {d: (r.n_bytes, r.n_tokens) for d, r in got.items()} == {d: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in ids_of(texts).items()}
    token_counts.fill_cache(docs, cache, default_path())
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(empty, shared_dir(spark)).count() == 0


def test_token_counts_take_the_fast_way_to_the_same_ids(monkeypatch):
    texts = ["", "one two", "<|endoftext|> <s></s>[UNK] ", " " * 5000 + "x" * 3000, "é\u3000\U0001f600\r\n\t", "1234567890" * 50]
    want = [len(library_encoder(default_path()).encode(t, add_special_tokens=False).ids) for t in texts]

    def refused(path):
        raise AssertionError("the file has ranks")

    for module in (token_counts, tokenizer_files):
        monkeypatch.setattr(module, "library_encoder", refused, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([b"d"] * len(texts)), pa.array(texts)], names=["digest", "text"])
    assert [n for out in token_counts._count(default_path())([batch]) for n in out.column("n_tokens").to_pylist()] == want


@pytest.mark.parametrize("few", [0, 200_000])
def test_token_cache_is_asked_before_the_texts(spark, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    df = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    cache, path = shared_dir(spark), default_path()
    assert token_counts.fill_cache(df(), cache, path) == 0
    assert token_counts.fill_cache(df("one two", "one two", None, ""), cache, path) == 2
    assert token_counts.fill_cache(df("one two", "three"), cache, path) == 1
    assert token_counts.fill_cache(df("three", None, "three"), cache, path) == 0
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, None), (4, "three")], "doc_id long, text string").withColumn("digest", F.lit("clash"))
    n = len(library_encoder(path).encode("one two", add_special_tokens=False).ids)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(rows, cache).collect())
    assert got[None, 7, n] == 2 and got[4, 0, 0] == 1 and sum(got.values()) == 4
    assert spark.read.parquet(cache).count() == 3


def test_packing(docs, texts, empty):
    lib = library_encoder(default_path())
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t in ids_of(texts).items()}
    rows, seqs, seen = packing.pack(docs).collect(), collections.defaultdict(list), collections.Counter()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        seen.update((r.doc_id, r.start + k) for k in range(r.length))
    assert len(seen) == sum(map(len, ids.values())) and set(seen.values()) == {1}
    waste = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        waste += packing.padding(at, 2048)
    assert waste < 2048
    assert packing.pack(empty).count() == 0


def test_packing_equal_rows_and_a_file_without_ranks(spark, tmp_path):
    rows = [(None, "same words")] * 30 + [(4, "other")] * 30 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("g", F.lit(1))
    path = tmp_path / "only.json"
    path.write_bytes(Path(default_path()).read_bytes())
    got = [collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(df, p).collect()) for p in (None, str(path))]
    assert got[0] == got[1] and sorted(got[0].values()) == [5, 30, 30]


def test_fill_finds_the_fullest_window():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        used = packing.fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_bpe(docs, texts, empty):
    lib = library_encoder(default_path())
    got, back = by_id(bpe.encode(docs)), by_id(bpe.decode(bpe.encode(docs)))
    for d, t in ids_of(texts).items():
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[d].ids) == want
        assert back[d].text == lib.decode(want, skip_special_tokens=False)
    assert by_id(bpe.round_trip(docs)) == back
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_small_index(monkeypatch):
    monkeypatch.setattr(bpe, "INDEX_BYTES", 5)
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    enc, lib = bpe.Encoder(default_path()), library_encoder(default_path())
    for t in ("aaaaaaa aaaa banana", "x<|endoftext|><|endoftext|> y", "it's I'm   \n\n 12345 ééé日本", ""):
        got = [i for ids, _ in enc.encode([t]) for i in ids.tolist()]
        assert got == lib.encode(t, add_special_tokens=False).ids


# classifier and language model


def labelled(spark, n=400):
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("ka", "to", "mi", "ra", "su") for b in ("n", "lo", "ver", "ti", "dom")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        good = i % 3 > 0
        rows.append((i, " ".join(w if good else [x + rng.choice(["&&&", "$$$"]) for x in w])))
        labels.append((i, int(good) if i % 10 else None))
    rows += [(n, None), (n + 1, ""), (None, "text")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.fit(quality_classifier.training_rows(docs, labels))
    got = by_id(quality_classifier.score(docs, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and np.mean([(got[i].score >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 403
    none = quality_classifier.fit(quality_classifier.training_rows(docs.limit(0), labels))
    assert quality_classifier.score(docs.limit(0), none).count() == 0


def test_quality_classifier_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = docs.union(docs).withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = quality_classifier.fit(quality_classifier.training_rows(odd, labels.withColumn("text", F.lit("clash"))))
    got = quality_classifier.score(odd, model)
    assert got.columns == ["doc_id", "score"] and got.count() == odd.count()
    scores = collections.defaultdict(set)
    for r in got.where("doc_id >= 400").collect():
        scores[r.doc_id].add(r.score)
    assert scores[400] == scores[401] and len(scores[400]) == 1
    assert {r.held for r in docs.select(quality_classifier.held_out().alias("held")).where("doc_id IS NULL").collect()} == {False}


def test_labels_are_joined_alike_by_both_ways(spark, monkeypatch):
    docs, labels = labelled(spark, 60)
    got = []
    for most in (0, 2_000_000):
        monkeypatch.setattr(quality_classifier, "BROADCAST_LABELS", most)
        got.append(collections.Counter((r.doc_id, r.text, r.label) for r in quality_classifier.training_rows(docs, labels).collect()))
    assert got[0] == got[1] and sum(got[0].values()) > 20


def hinge(rows, y, w, c):
    """The objective over rows of unit length."""
    return 0.5 * w @ w + c * sum(max(0.0, 1 - s * (w[r].sum() / np.sqrt(len(r)))) for r, s in zip(rows, y, strict=True))


def test_descent_separates_and_is_optimal():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[0, rng.integers(10, 50, 5), 60 + i % 2]) for i in range(100)]
    y = np.array([1 if i % 2 else -1 for i in range(100)])
    alpha, w, gap, _ = quality_classifier.descend(rows, y, np.ones(100), 10.0, 1e-3)
    assert all(np.sign(w[r].sum()) == s for r, s in zip(rows, y, strict=True)) and gap <= 1e-3
    best = hinge(rows, y, w, 10.0)
    assert 0 <= best - (alpha.sum() - 0.5 * w @ w) <= 1e-3 * best  # the dual objective meets it
    for _ in range(50):
        assert hinge(rows, y, w + rng.normal(size=100) * 0.1, 10.0) > best * (1 - 1e-3)


def test_descent_ends_by_its_gap_on_noisy_labels():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.r_[0, rng.integers(10, 90, 6), 95 + i % 2]) for i in range(600)]
    y = np.array([(1 if i % 2 else -1) * (1 if rng.random() > 0.15 else -1) for i in range(600)])
    exact = hinge(rows, y, quality_classifier.descend(rows, y, np.ones(100), 10.0, 1e-3)[1], 10.0)
    for tolerance in (0.2, 0.02):
        _, w, gap, passes = quality_classifier.descend(rows, y, np.ones(100), 10.0, tolerance)
        assert gap <= tolerance and exact * (1 - 2e-3) <= hinge(rows, y, w, 10.0) <= exact / (1 - tolerance) and passes > 1
    with pytest.raises(RuntimeError, match="gap"):
        quality_classifier.descend(rows, y, np.ones(100), 10.0, 1e-6, 2)


@pytest.mark.parametrize("parts", [1, 7])
def test_fit_is_the_descent_over_the_sample(spark, parts):
    """However the rows are dealt; ratios are counted over all rows, also beyond the sample."""
    docs, labels = labelled(spark, 300)
    train = quality_classifier.training_rows(docs, labels).repartition(parts)
    n = train.count()
    ratio = quality_classifier.log_ratios(train)
    for rows, most_bytes in ((10_000, 10**9), (50, 10**9), (10_000, 4_000), (10_000, 1)):
        model = quality_classifier.fit(train, rows, most_bytes)
        order = sorted(train.select(F.xxhash64("doc_id", "text", F.lit(11)).alias("h"), "text", "label").collect())
        size = np.cumsum([len(r.text.encode()) for r in order])
        want = order[: max(1, min(rows, int((size <= most_bytes).sum())))]
        assert model.n == len(want) <= n and 0 <= model.gap <= quality_classifier.TOLERANCE
        feats = [quality_classifier.features(r.text.encode()) for r in want]
        w = quality_classifier.descend(feats, np.array([2 * r.label - 1 for r in want]), ratio, 10.0)[1]
        assert model.weights == pytest.approx(w * ratio)


def lm_rows(spark):
    rng = random.Random(4)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("aa", "bb", "cc")]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(rng.randint(10, 120)))) for i in range(300)]
    return rows + [(300, None), (301, "  "), (302, "Unseen WORDS here"), (None, "aa1 aa2")]


def test_language_model(spark):
    rows = lm_rows(spark)
    got = gated_lm.log_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts, tokens = collections.Counter(), {}
    for d, t in rows:
        tokens[d] = (t or "").encode().lower().split() + [None]
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gated_lm.log_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_model_scores_every_row_and_by_both_ways_to_a_count(spark, monkeypatch):
    """Rows that share an id or have none stay rows; known and joined counts give one score; a word too long is no head word."""
    monkeypatch.setattr(gated_lm, "HEAD", 7)
    rows = lm_rows(spark) + [(5, "aa1 bb2"), (5, "aa1 bb2"), (None, ""), (None, "x " * 9), (7, "q" * 5000 + " q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("rn", F.lit(0)).coalesce(1)
    got = []
    for mid in (0, 50, 1 << 17):
        monkeypatch.setattr(gated_lm, "MID", mid)
        out = sorted(gated_lm.log_likelihood(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score))
        assert len(out) == len(rows)
        got.append(out)
    for other in got[1:]:
        assert [(r.doc_id, r.n_tokens, r.n_known) for r in other] == [(r.doc_id, r.n_tokens, r.n_known) for r in got[0]]
        assert [r.score for r in other] == pytest.approx([r.score for r in got[0]], rel=1e-6)
        assert [r.base_score for r in other] == pytest.approx([r.base_score for r in got[0]])
    assert len({r.score for r in got[0] if r.doc_id == 5 and r.n_tokens == 3}) == 1


def test_language_model_trains_on_every_token():
    """Also on what does not fill the lanes; padding changes nothing."""
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(20)], np.full(21, 10.0), np.ones(gated_lm.ENDINGS))
    ids = np.array([3, 5, 0, 7, 9, 11, 2], np.int64)
    for lanes in (1, 2, 4, 5):
        net, opt = gated_lm.Network(sym), {}
        gated_lm.train_stream(net, sym, ids, np.r_[True, ids[:-1] == 0], lanes, opt)
        assert {int(i) for i in np.flatnonzero(opt["class_bias"][0] < 0)} == {int(i) for i in sym.class_of[ids]} and opt["t"] == 1
        assert opt["class_bias"][0].sum() == pytest.approx(0, abs=1e-5)


def test_language_model_is_a_distribution():
    """The classes and the members of each class sum to one, and gradients agree with differences."""
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(40)], np.arange(41, 0, -1.0), np.arange(1.0, gated_lm.ENDINGS + 1))
    net = gated_lm.Network(sym)
    h = np.random.default_rng(0).normal(size=(3, gated_lm.HIDDEN)).astype(np.float32)
    total = np.zeros(3)
    for s in range(sym.n):
        y = np.full(3, s)
        total += np.exp(net.class_log_probs(h)[np.arange(3), sym.class_of[y]] + gated_lm._head_terms(net, sym, h, y))
    assert total == pytest.approx(np.ones(3), abs=1e-4)


def test_language_model_training_lowers_the_loss():
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(20)], np.full(21, 10.0), np.ones(gated_lm.ENDINGS))
    net = gated_lm.Network(sym)
    ids = np.tile(np.r_[np.arange(1, 11), 0], 400).astype(np.int64)
    begins = np.r_[True, ids[:-1] == 0]
    before = gated_lm.score_sequences(net, sym, [ids[:11]])[0]
    for _ in range(8):
        gated_lm.train_stream(net, sym, ids, begins, 16, opt := {})
    assert opt["t"] and gated_lm.score_sequences(net, sym, [ids[:11]])[0] > before / 2


def test_every_head_word_depends_on_the_state():
    """Also the rarest of a large head, whose size grows with the vocabulary."""
    assert gated_lm.sizes_for(100) == (gated_lm.HEAD, gated_lm.ENDINGS)
    head, endings = gated_lm.sizes_for(4_000_000)
    assert head > gated_lm.HEAD and endings > gated_lm.ENDINGS
    counts = 1e6 / np.arange(1, head + 2)
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(head)], counts, np.ones(endings))
    assert sym.class_of[: sym.first_ending].max() < sym.n_soft
    net, h = gated_lm.Network(sym), np.random.default_rng(0).normal(size=(2, gated_lm.HIDDEN)).astype(np.float32)
    terms = np.array([gated_lm._head_terms(net, sym, h, np.full(2, s)) for s in (head // 2, head - 1)])
    assert (terms[:, 0] != terms[:, 1]).all()


def test_scoring_is_the_same_alone_and_together():
    sym = gated_lm.Symbols([b"a", b"b"], np.array([3.0, 2.0, 1.0]), np.ones(gated_lm.ENDINGS))
    net, rng = gated_lm.Network(sym), np.random.default_rng(1)
    docs = [rng.integers(0, sym.n, n).astype(np.int16) for n in (1, 7, 7, 300, 2)]
    alone = [gated_lm.score_sequences(net, sym, [d])[0] for d in docs]
    assert gated_lm.score_sequences(net, sym, docs) == pytest.approx(alone, rel=1e-4)


def test_a_token_meets_few_scores_whatever_the_vocabulary():
    """Groups, classes of one group and members together grow far slower than the classes; every class is in one group."""
    met = []
    for vocab in (1_000_000, 100_000_000):
        head, endings = gated_lm.sizes_for(vocab)
        sym = gated_lm.Symbols([f"w{i}".encode() for i in range(head)], 1e8 / np.arange(1, head + 2), np.full(endings, 1e5))
        assert sym.group_cuts[0] == 0 and sym.group_cuts[-1] == sym.n_classes == len(sym.group_of) and (np.diff(sym.group_cuts) > 0).all()
        assert (sym.group_cuts[sym.group_of] <= np.arange(sym.n_classes)).all() and (np.arange(sym.n_classes) < sym.group_cuts[sym.group_of + 1]).all()
        met.append((sym.n_classes, len(sym.group_cuts) - 1 + np.diff(sym.group_cuts).max()))
    assert met[1][0] > 7 * met[0][0] and met[1][1] < min(4 * met[0][1], met[1][0] / 6)


@pytest.mark.parametrize("scale", [1, 300])
def test_class_terms_are_the_class_distribution_and_its_gradients(scale):
    """Also where weights are so large that exponentials need each token's maximum."""
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(40)], np.arange(41, 0, -1.0), np.arange(1.0, gated_lm.ENDINGS + 1))
    net, rng = gated_lm.Network(sym), np.random.default_rng(2)
    net.classes *= scale
    net.groups *= scale
    net.members *= scale
    y = np.tile(np.arange(sym.n), 2)
    h = rng.normal(size=(len(y), gated_lm.HIDDEN)).astype(np.float32)
    want = net.class_log_probs(h)
    assert np.exp(want.astype(float)).sum(1) == pytest.approx(np.ones(len(y)), abs=1e-4)
    h1 = gated_lm._with_ones(h)
    assert gated_lm._class_terms(net, sym, h1, y) == pytest.approx(want[np.arange(len(y)), sym.class_of[y]], rel=1e-4, abs=1e-4 * scale)
    assert np.isfinite(gated_lm._member_terms(net, sym, h1, y)).all()
    if scale > 1:
        return
    for terms in (gated_lm._class_terms, gated_lm._member_terms):
        grads, dh = {k: np.zeros_like(getattr(net, k)) for k in net.SHAPES}, np.zeros_like(h)
        terms(net, sym, h1, y, grads, dh)
        loss = lambda: -float(terms(net, sym, gated_lm._with_ones(h), y).astype(float).sum())  # noqa: E731,B023
        for grad, value in [(dh, h), *((grads[k], getattr(net, k)) for k in ("groups", "group_bias", "classes", "class_bias", "members", "member_bias"))]:
            at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
            if not grad[at]:
                continue
            old, eps = value[at], np.float32(0.02)
            value[at] = old + eps
            more = loss()
            value[at] = old - eps
            less = loss()
            value[at] = old
            assert (more - less) / (2 * float(eps)) == pytest.approx(float(grad[at]), rel=0.02)


def test_training_gradients_agree_with_differences():
    """Through the gates and the carried state, by the first moments of one step."""
    sym = gated_lm.Symbols([f"w{i}".encode() for i in range(20)], np.full(21, 10.0), np.ones(gated_lm.ENDINGS))
    ids = np.array([3, 5, 7, 9, 0, 3, 5, 2, 0], np.int64)
    begins = np.r_[True, ids[:-1] == 0]

    def fresh():
        net, rng = gated_lm.Network(sym), np.random.default_rng(3)
        for k in net.SHAPES:
            getattr(net, k)[...] += rng.normal(0, 0.5, getattr(net, k).shape)
        return net

    def loss(net):
        return -float(gated_lm.score_sequences(net, sym, [ids[:5], ids[5:]]).sum()) / len(ids)

    gated_lm.train_stream(fresh(), sym, ids, begins, 1, opt := {})
    picked, slopes = [], []
    for k in gated_lm.Network.SHAPES:
        for i in np.argsort(-np.abs(opt[k][0]).ravel())[:3]:
            sides = []
            for sign in (1, -1):
                net = fresh()
                getattr(net, k).reshape(-1)[i] += np.float32(sign * 0.01)
                sides.append(loss(net))
            slopes.append((sides[0] - sides[1]) / 0.02)
            picked.append(float(opt[k][0].ravel()[i]))
    # the step clips the gradient's norm, and the moment is a tenth of it
    slopes, picked = np.array(slopes), np.array(picked)
    factor = (slopes @ picked) / (picked @ picked)
    assert factor >= 10 - 0.2 and slopes == pytest.approx(picked * factor, rel=0.05, abs=2e-3)


def test_symbols_of_words():
    words = [b"a", b"", b"zz", b"abcd", b"xbcd", b"\xff\xfe\xfd\xfc", b"b"]
    for head in ([b"a", b"b"], []):
        sym = gated_lm.Symbols(head, np.full(len(head) + 1, 5.0), np.ones(gated_lm.ENDINGS))
        want = [head.index(w) + 1 if w in head else sym.first_ending + zlib.crc32(w[-gated_lm.LAST :]) % gated_lm.ENDINGS for w in words]
        assert sym.of_words(pa.array(words, pa.binary())).tolist() == want


# pipeline


def test_pipeline_keeps_columns_and_ends_in_pieces(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), now.schema)
        assert now.columns == docs.columns, name
        assert now.count() <= before
        before = now.count()
    lib = library_encoder(default_path())
    want = {(r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in now.collect()}
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_pipeline_stages_by_hand(spark, docs, texts):
    """Quality, lines and passages against brute force, each on its own input."""
    rows = [(r.doc_id, r.text) for r in quality_rules.judge(docs).collect()]
    led = {r.doc_id: r.fail_bits for r in quality_rules.ledger(docs).collect()}
    assert {d for d, _ in rows} == {d for d, b in led.items() if b & quality_rules.DEFAULT.mask == 0}
    lined = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    want = lines_by_hand(rows)
    after = {r.doc_id: r.text for r in lined.collect()}
    assert after == {d: want[d][2] for d in want}
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeated(spark.createDataFrame(list(after.items()), "doc_id long, text string")).collect()}
    hand = substring_by_hand(list(after.items()), 20)
    assert cut == {d: hand[d][2] if hand[d][1] else t for d, t in after.items()}


def test_pipeline_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
