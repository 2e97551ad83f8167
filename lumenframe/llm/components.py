"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a vertex moves to the smallest vertex of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point downwards here; the lower neighbours of a vertex and itself move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root): root is the smallest vertex that each vertex of an edge can reach.

    edges has columns a and b of one ordered type; self-loops and repeats are allowed. Each round's
    edges are written to the shared folder, so that lineage stays short. The number of edges never
    grows, and a hub's edges are spread over tasks by its neighbours in the aggregation.
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession)
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), path)
    state = None
    for _ in range(max_rounds):
        before, path = path, shared_dir(spark)
        edges = materialize(_small_star(_large_star(edges)), path)
        discard(spark, before)
        now = edges.agg(F.count("*").alias("n"), F.count_distinct("b").alias("roots"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
