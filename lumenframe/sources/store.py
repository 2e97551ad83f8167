"""Parquet stores: recordings, fluence and sensitivities, partitioned so that a lookup reads its part only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.recording import Recording
from ..core.schema import require


class FluenceStore:
    """(label, wavelength, voxel, value), one folder per label and wavelength."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, fluence: DataFrame) -> None:
        """Replaces the (label, wavelength) parts that fluence has."""
        require(fluence, "label", "wavelength", "voxel", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "wavelength").parquet(f"{self.path}/fluence")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fluence")

    def get(self, label: str, wavelength: float) -> DataFrame:
        return self.all().where((F.col("label") == label) & (F.col("wavelength") == wavelength)).select("voxel", "value")

    def put_at_optodes(self, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/at_optodes")

    def at_optodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/at_optodes")


def save_sensitivity(adot: DataFrame, path: str) -> None:
    adot.write.mode("overwrite").partitionBy("wavelength").parquet(path)


def load_sensitivity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_recording(rec: Recording, path: str) -> None:
    """Each table in a folder of its kind and name."""
    for name, df in rec.timeseries.items():
        df.write.mode("overwrite").parquet(f"{path}/timeseries/{name}")
    for name, df in rec.masks.items():
        df.write.mode("overwrite").parquet(f"{path}/masks/{name}")
    for name in ("geo3d", "geo2d", "stim"):
        if getattr(rec, name) is not None:
            getattr(rec, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_recording(spark: SparkSession, path: str, timeseries: list[str], masks: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> Recording:
    """The named parts of a saved recording, lazily."""
    out = Recording({n: spark.read.parquet(f"{path}/timeseries/{n}") for n in timeseries}, {n: spark.read.parquet(f"{path}/masks/{n}") for n in masks})
    for name in parts:
        setattr(out, name, spark.read.parquet(f"{path}/{name}"))
    return out
