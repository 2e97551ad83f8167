"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of line hashes (two independent XXH64 of the line's key, 128 bits) with the first
document that holds each, bucketed by hash and sorted within a bucket; all runs of a store have the
same buckets. Documents are taken in batches of ascending id. A batch's hashes are reduced to the
smallest id of each and anti-joined with every run by sort-merge: the runs are read as they lie,
bucketed and sorted, so only the batch is shuffled and sorted. What no run holds becomes the batch's
own run on level 0. When a level has ``fanout`` runs, they are merged bucket by bucket, by sort-merge
joins without a shuffle, into one run of the next level. Over n batches a hash is rewritten some
log(n) times.

``SortedRuns`` is a store: it keeps its runs and a manifest of its levels, so that later batches
meet the runs of earlier ones (a hash belongs to the batch that brought it first, and within a
batch to its smallest id). ``repeated_lines`` uses a store of its own, which it drops at its end,
unless the caller passes one.

All of it is DataFrame expressions. The join that decides a line is on hash and document, so a hot
line spreads over its documents.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document
(their lines are judged by that id and each row keeps its own); a row without an id keeps all its
lines and claims none; an empty table gives an empty result; other columns are carried by
``drop_repeated``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, discard, materialize, shared_dir, table, text_or_empty, unboxed

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


@contextmanager
def _runs_as_sorted(spark):
    """Take runs' rows as sorted, which Spark does only when told (a run has one file per bucket)."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class SortedRuns:
    """Levelled runs of (h1, h2, first); a hash is in one run only.

    name: a store's name, for opening it again; its tables lie in the warehouse.
    """

    def __init__(self, spark, buckets: int, fanout: int = 2, name: str | None = None):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = name or f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    @classmethod
    def open(cls, spark, name: str, fanout: int = 2) -> SortedRuns:
        rows = spark.table(f"{name}_manifest").orderBy("level", "at").collect()
        out = cls(spark, rows[0]["buckets"], fanout, name)
        out.levels = [[r["run"] for r in rows if r["level"] == k and r["run"]] for k in range(1 + max(r["level"] for r in rows))]
        return out

    def save(self) -> None:
        """Write the manifest: a row per run (a null run stands for a level without one)."""
        rows = [(k, i, run, self.buckets) for k, level in enumerate(self.levels) for i, run in enumerate(level or [None])]
        self.spark.createDataFrame(rows, "level int, at int, run string, buckets int").coalesce(1).write.mode("overwrite").saveAsTable(f"{self.name}_manifest")

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _write(self, df: DataFrame) -> str:
        """df, which is partitioned as the buckets are, as a run with one file per bucket."""
        name = f"{self.name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    def _merged(self, a: str, b: str) -> str:
        """One run of two, by a full outer sort-merge join, which neither shuffles nor sorts them."""
        other = self.spark.table(b).withColumnRenamed("first", "other").hint("merge")
        both = self.spark.table(a).join(other, HASH, "full_outer")
        return self._write(both.select(*HASH, F.coalesce("first", "other").alias("first")))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, firsts: DataFrame) -> DataFrame:
        """Merge-anti-join (h1, h2, first) with every run; what is new becomes a run of level 0, returned."""
        with _runs_as_sorted(self.spark):
            for name in self.runs():
                firsts = firsts.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
            self.levels[0].append(self._write(firsts.repartition(self.buckets, *HASH)))
        return self.spark.table(self.levels[0][-1])

    def compact(self) -> None:
        """Merge the runs of every full level; the merged runs' tables go."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                merged = level[0]
                with _runs_as_sorted(self.spark):
                    for name in level[1:]:
                        one = self._merged(merged, name)
                        self._drop([merged, name])
                        merged = one
                self.levels[k + 1].append(merged)
                self.levels[k] = []

    def drop(self) -> None:
        self._drop([*self.runs(), f"{self.name}_manifest"])
        self.levels = [[]]


def repeated_lines(docs: DataFrame, batches: int = 6, fanout: int = 2, min_chars: int = 10, id_col: str = "doc_id", text: str = "text", store: SortedRuns | None = None) -> DataFrame:
    """(id, th, dropped): for each text (th: its hash) the 0-based numbers of the lines it loses.

    store: runs of earlier documents, whose lines are lost here too; this call's runs are added.
    """
    spark, t = docs.sparkSession, text_or_empty(text)
    bounds = sorted(set(docs.approxQuantile(id_col, [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = sum((F.when(F.col("id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(t).alias("th"), F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    keyed = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    path = shared_dir(spark)
    hashed = keyed.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.cast("int").alias("batch"))
    hashed.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(hashed.schema).parquet(path)
    runs = store or SortedRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    dropped = None
    try:
        for b in range(len(bounds) + 1):
            mine = stored.where(F.col("batch") == b).drop("batch")
            own = runs.add(mine.groupBy(*HASH).agg(F.min("id").alias("first"))).withColumnRenamed("first", "id")
            with _runs_as_sorted(spark):
                lost = materialize(mine.join(own, [*HASH, "id"], "left_anti").groupBy("id", "th").agg(F.collect_set("pos").alias("dropped")))
            dropped = lost if dropped is None else dropped.unionByName(lost)
            runs.compact()
        if store is not None:
            store.save()
    finally:
        discard(spark, path)
        if store is None:
            runs.drop()
    return dropped


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """row (the columns of docs), n_lines, n_dropped and kept, the text of the lines that stay."""
    lost = repeated_lines(docs, id_col=id_col, text=text, **how).hint("shuffle_hash")
    t = text_or_empty(F.col("row").getField(text))
    joined = boxed(docs).join(lost, (F.col("row").getField(id_col) == F.col("id")) & (F.xxhash64(t) == F.col("th")), "left")
    split = joined.withColumn("lines", F.split(t, "\n"))
    lines, gone = F.col("lines"), F.col("dropped")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), t).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return split.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_repeated(docs: DataFrame, **how) -> DataFrame:
    """docs with the repeated lines gone from the text; texts that lose none stay as they are."""
    return unboxed(kept_lines(docs, **how), text=F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row").getField("text")))


def query(spark, sf_dir) -> DataFrame:
    out = kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
j AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
