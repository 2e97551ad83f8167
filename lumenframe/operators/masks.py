"""Masks over labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant(df: DataFrame, value: bool) -> DataFrame:
    return df.drop("value").withColumn("mask", F.lit(value))


def collapse(mask: DataFrame, dim: str) -> DataFrame:
    """AND over all dimensions but one."""
    return mask.groupBy(dim).agg(F.bool_and("mask").alias("mask"))


def combine(masks: list[DataFrame], operator: str, dim: str = "channel") -> DataFrame:
    """Masks of different dimensions as one over dim: AND for all, OR for any."""
    if operator not in ("all", "any"):
        raise ValueError("operator must be all or any")
    parts = [collapse(m, dim).withColumnRenamed("mask", f"m{i}") for i, m in enumerate(masks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, dim)
    cols = [F.col(f"m{i}") for i in range(len(parts))]
    verdict: Column = cols[0]
    for c in cols[1:]:
        verdict = (verdict & c) if operator == "all" else (verdict | c)
    return out.select(dim, verdict.alias("mask"))


def apply(df: DataFrame, mask: DataFrame, operator: str, dim_collapse: str | None = None) -> DataFrame:
    """operator nan: values become NULL where the mask is false; drop: labels that are false everywhere go."""
    mask = collapse(mask, dim_collapse) if dim_collapse else mask
    keys = [c for c in mask.columns if c != "mask"]
    if set(keys) - set(df.columns):
        raise ValueError("the mask has dimensions that the table lacks")
    if operator == "nan":
        return df.join(mask, keys, "left").withColumn("value", F.when(F.coalesce("mask", F.lit(True)), F.col("value"))).select(*df.columns)
    if operator == "drop":
        return df.join(mask.where("mask").select(*keys).distinct(), keys, "left_semi")
    raise ValueError("operator must be nan or drop")


def masked(mask: DataFrame, dim: str) -> DataFrame:
    """Labels that the mask takes out, sorted."""
    return collapse(mask, dim).where(~F.col("mask")).select(dim).orderBy(dim)


def prune(df: DataFrame, masks: list[DataFrame], operator: str = "all", drop: bool = True) -> DataFrame:
    return apply(df, combine(masks, operator), "drop" if drop else "nan")
