"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java and Python regular expression class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noted: list[list[str]] = []


@contextmanager
def noted_scratch() -> Iterator[list[str]]:
    """The folders that shared_dir names meanwhile, so that a caller can discard them once nothing reads them."""
    _noted.append(paths := [])
    try:
        yield paths
    finally:
        _noted.pop()


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the session's spark.checkpoint.dir, which driver and executors share.

    Without that setting (a local test) the folder lies below the session's warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Runs of characters that are not ASCII white space; none for an empty text."""
    return F.array_remove(F.split(c, f"{SPACE}+"), "")


def boxed(docs: DataFrame) -> DataFrame:
    """docs as one struct column row, so that no column's name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame, **instead: Column) -> DataFrame:
    """The columns of row again; instead replaces some."""
    return df.select(*[instead.get(c, F.col("row").getField(c)).alias(c) for c in df.schema["row"].dataType.names])
