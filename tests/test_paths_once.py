"""Ways down a surface, each place of which is found once."""

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import geodesics


def test_ways_need_no_second_look(spark):
    n = 40
    faces = spark.range(n - 2).select(F.col("id").alias("face"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    distances = spark.range(n + 1).select(F.col("id").alias("vertex"), F.when(F.col("id") < n, F.col("id").cast("double")).alias("distance"))
    starts = spark.createDataFrame([(0,), (1,), (20,), (39,), (n,)], "vertex long")
    got = geodesics.geodesic_path(faces, distances, starts, longest=21)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    ways = {}
    for r in got.orderBy("start", "step").collect():
        ways.setdefault(r.start, []).append((r.step, r.vertex))
    want = {s: [*range(s, 0, -2), 0] if s < n else [s] for s in (0, 1, 20, 39, n)}
    assert ways == {s: list(enumerate(w)) for s, w in want.items()}
    with pytest.raises(RuntimeError):
        geodesics.geodesic_path(faces, distances, starts, longest=20)
