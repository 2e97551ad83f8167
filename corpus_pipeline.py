"""Cleaning pipeline over documents: quality rules, line dedup, near-duplicates, passages, packing.

Every stage works on all that the one before kept, written as Parquet to the shared folder. All
but the last return the columns of documents; the last returns packed pieces. A document that
loses all of its words to the deduplication stages stays as an empty text; of empty texts the
near-duplicate stage keeps one. Scratch tables of a stage are deleted when the next one begins,
as its input is then a table of its own; an input that still reads them leaves them alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from lumenframe.llm.common import discard, materialize, noted_scratch, shared_dir, table

#: By application: scratch folders of the stage that was built last.
_scratch: dict[str, list[str]] = {}


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = _scratch.pop(app, [])
        read = docs.inputFiles() if before else []
        for path in before:
            if not any(path.rpartition("/")[2] in f for f in read):
                discard(spark, path)
        with noted_scratch() as paths:
            out = work(spark, docs, sf_dir)
        _scratch[app] = paths
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail no rule of the policy; a null or empty text has no words and goes. Repeated rows and ids are judged one by one."""
    return quality_rules.judge(docs)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; lines of an earlier document go. Rows with a null id lose none and make others lose none."""
    return line_dedup.drop_repeated(docs)


@stage
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more; of rows that share an id and a text one stays, null ids included."""
    return simhash.keep_first(docs, size=5, distance=None, jaccard=0.8)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words of passages that start earlier go. Rows with a null id lose none; a text that loses none stays as it is."""
    return substring_dedup.drop_repeated(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; an empty or null text is its end id, a null id is carried along."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Simhash and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for _, work in STAGES[:-1]:
        before, path = path, shared_dir(spark)
        docs = materialize(work(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
