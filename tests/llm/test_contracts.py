"""Each registered query of the training-data operators at sf0.001: its columns, their types, and its rows."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import queries
from lumenframe.llm.tokenizer_files import default_path, library_encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
L, S, B, D, I = "bigint", "string", "boolean", "double", "int"
COLUMNS = {
    "op1": {"doc_id": L, "start": L, "length": L, "ids_crc32": L, "doc_tokens": L, "sequence_id": L, "offset": L},
    "op2": {"doc_id": L, "held_out": B, "n_tokens": L, "n_known": L, "train_tokens": L, "base_score": D, "score": D},
    "op3": {"doc_id": L, "keep_id": L, "group_size": L, "kept": B, "text_sha256": S},
    "op4": {"doc_id": L, "n_words": L, "word_chars": L, "n_symbols": L, "n_dup_lines": L, "n_repeat_words": L, "base_failed": B, "kept": B},
    "op5": {"doc_id": L, "fingerprint": S, "component_id": L},
    "op6": {"doc_id": L, "n_bytes": L, "n_tokens": L, "over_limit": B},
    "op7": {"doc_id": L, "n_lines": L, "n_dropped": L, "kept_sha256": S},
    "op8": {"doc_id": L, "held_out": B, "score": D, "predicted": I},
    "op9": {"doc_id": L, "n_tokens": L, "ids_sha256": S, "decoded_sha256": S},
    "op10": {"doc_id": L, "n_words": L, "n_removed": L, "kept_sha256": S},
    "op11": {"doc_id": L, "n_tokens": L, "ids_sha256": S, "decoded_sha256": S},
    "op12": {"conv_id": L, "gaps": L, "blank": L, "duplicate": L, "truncated": L, "illegal": L, "cost": L, "audit": S, "repaired_sha256": S},
    "op13": {"item_id": L, "rank": I, "doc_id": L, "score": L},
}


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.startswith("op")])
def test_contract(spark, name):
    op = name.split("_")[0]
    out = queries.QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[op]} == COLUMNS[op]
    rows = out.cache()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    digests = [c for c in COLUMNS[op] if c.endswith("sha256")]
    assert rows.where(F.greatest(*[(~F.col(c).rlike("^[0-9a-f]{64}$")).cast("int") for c in digests], F.lit(0), F.lit(0)) > 0).count() == 0
    if op == "op12":
        assert rows.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    elif op == "op13":
        assert rows.groupBy("item_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n OR n > 10").count() == 0
    elif op == "op1":
        assert rows.select("doc_id").distinct().count() == n and rows.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("s")).where("s <> doc_tokens").count() == 0
    else:
        assert rows.count() == n == rows.select("doc_id").distinct().count()
    if op == "op5":
        assert rows.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$") | (F.col("component_id") > F.col("doc_id"))).count() == 0
    if op == "op6":
        assert rows.where("over_limit <> (n_tokens > 512)").count() == 0
    if op == "op8":
        assert rows.where("predicted <> IF(score >= 0.5, 1, 0) OR score < 0 OR score > 1").count() == 0
    if op == "op9":
        text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        library = library_encoder(default_path())
        for r in rows.collect():
            ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows.unpersist()
