"""Token counts through a digest cache.

The cache is a Parquet table keyed by the digest of the content (SHA-256 of the text, null as
empty; no other normalisation, as any would change counts) and the digest of the tokenizer file.
Only distinct contents that it lacks are encoded (by the ranks of the same vocabulary, whose ids are
those of the library, where it has such a file), and their counts are appended; copies and later
runs are served by a join. The missing digests are found first, over digests alone; only their texts
are then fetched: with nothing missing no text is read twice or shuffled, few missing digests (at
most ``FEW``) are broadcast to the texts, and of many the texts collapse by digest within each map
task, so a hot content is shuffled once per task.

Defined results: null counts as empty (no tokens); repeated rows each get a row; an empty table
gives an empty result; other columns are ignored. A cache row appended twice (a job run again
after a failure) is read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, text_or_empty
from .tokenizer_files import default_path, file_digest, id_encoder

CACHE = "digest binary, tokenizer string, n_tokens long"
#: Missing digests (32 bytes each) up to which they travel to the texts.
FEW = 200_000


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        for batch in batches:
            n = [len(encode(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file_digest(path)] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def read_cache(spark, cache: str, version: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:
        return None
    return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, path: str, text: str = "text") -> int:
    """Encode the distinct contents that the cache lacks and append their counts; how many they were."""
    spark, t = docs.sparkSession, text_or_empty(text)
    keyed = docs.select(F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    missing, known = keyed.select("digest").distinct(), read_cache(spark, cache, file_digest(path))
    missing = materialize(missing if known is None else missing.join(known.select("digest"), "digest", "left_anti"))
    n = missing.count()
    if n:
        want = keyed.join(F.broadcast(missing), "digest", "left_semi") if n <= FEW else keyed
        want = want.groupBy("digest").agg(F.first("text").alias("text"))
        if n > FEW and known is not None:
            want = want.join(missing, "digest", "left_semi")
        want.select("digest", "text").mapInArrow(_count(path), CACHE).write.mode("append").parquet(cache)
    return n


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs."""
    path, t = path or default_path(), text_or_empty(text)
    fill_cache(docs, cache, path, text)
    rows = docs.select(F.col(id_col), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("digest"))
    found = read_cache(docs.sparkSession, cache, file_digest(path))
    if found is None:
        found = docs.sparkSession.createDataFrame([], "digest binary, n_tokens long")
    # the counts of these documents as a table of their own: Spark can then split a hot digest in the last join
    known = materialize(rows.select("digest").distinct().join(found, "digest"))
    return rows.join(known, "digest").select(id_col, "n_bytes", "n_tokens")


def query(spark, sf_dir) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), shared_dir(spark))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def warm_query(spark, sf_dir) -> DataFrame:
    """Counts of documents by a cache that benchmark and then documents have filled, with what each pass had to encode."""
    docs, cache, path = table(spark, sf_dir, "documents"), shared_dir(spark), default_path()
    passes = [fill_cache(d, cache, path) for d in (table(spark, sf_dir, "benchmark"), docs, docs)]
    out = count_tokens(docs, cache, path)
    return out.select("doc_id", "n_bytes", "n_tokens", *[F.lit(n).cast("long").alias(f"encoded_{i}") for i, n in enumerate(passes)])
