"""Rounding of results and the registry of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added before rounding, so that decimal halves round alike in every engine.
OFF_TIES = 1.3e-8
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero as zero, so that engines agree."""
    return df.select(*[(F.round(F.col(f"`{c}`") + OFF_TIES, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with the SQL that it must equal."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r(expr: str, name: str | None = None) -> str:
    return f"round(({expr}) + {OFF_TIES}, 6) + 0.0 AS {name or expr}"
