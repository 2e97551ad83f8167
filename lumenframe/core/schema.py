"""Long-form tables: one row per cell of a labelled array, with dimension columns and a value.

A time series has the columns channel, wavelength or chromo, sample, time and value; further
dimension columns are allowed everywhere. Missing data is NULL inside the library. A mask is keyed
by some of the dimensions and has a boolean column mask (true: clean).
"""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STIM = "onset double, duration double, value double, trial_type string"


class SchemaError(ValueError):
    """A table lacks a column that an operator needs."""


class CRSMismatchError(ValueError):
    """Two point sets, or a set and a transform, have different coordinate reference systems."""

    @classmethod
    def unexpected_crs(cls, expected_crs: str, found_crs: str) -> CRSMismatchError:
        return cls(f"expected the coordinate reference system {expected_crs!r} but found {found_crs!r}")

    @classmethod
    def wrong_transform(cls, current_crs: str, transform_crs: str) -> CRSMismatchError:
        return cls(f"a transform from {transform_crs!r} cannot be applied to points in {current_crs!r}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself; raises SchemaError if a column is missing. Starts no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def validates(**needs: tuple[str, ...]):
    """Decorator: the named arguments must have these columns."""

    def wrap(f):
        sig = inspect.signature(f)

        @functools.wraps(f)
        def checked(*args, **kwargs):
            for name, value in sig.bind(*args, **kwargs).arguments.items():
                if name in needs and value is not None:
                    require(value, *needs[name])
            return f(*args, **kwargs)

        return checked

    return wrap


def has_time(df: DataFrame) -> DataFrame:
    return require(df, "time")


def has_wavelengths(df: DataFrame) -> DataFrame:
    return require(df, "wavelength")


def has_channel(df: DataFrame) -> DataFrame:
    return require(df, "channel", "source", "detector")


def has_positions(df: DataFrame, n: int = 3) -> DataFrame:
    return require(df, *("x", "y", "z")[:n])


def spectral(df: DataFrame) -> list[str]:
    """The spectral dimension of a time series, if it has one."""
    return [c for c in ("wavelength", "chromo") if c in df.columns]


def trace_keys(df: DataFrame) -> list[str]:
    """The dimension columns that name one trace."""
    return [c for c in df.columns if c not in ("sample", "time", "value", "reltime", "rel_idx", "source", "detector")]


def trace(df: DataFrame) -> Window:
    return Window.partitionBy(*trace_keys(df))


def along_time(df: DataFrame) -> Window:
    return trace(df).orderBy("sample" if "sample" in df.columns else "time")


def zero_padded(numbers: Column, top: Column, prefix: str = "") -> Column:
    """prefix and the number, padded to the digits of ceil(log10(top)); powers of ten get a digit less."""
    return F.concat(F.lit(prefix), F.lpad(numbers.cast("string"), F.greatest(F.ceil(F.log10(F.abs(top))), F.length(numbers.cast("string"))).cast("int"), "0"))


def empty_stim(spark) -> DataFrame:
    return spark.createDataFrame([], STIM)


def build_timeseries(df: DataFrame, values: str = "values", times: str = "times") -> DataFrame:
    """Packed traces (two array columns) as a long series with samples 0, 1, ..."""
    keys = [c for c in df.columns if c not in (values, times)]
    return df.select(*keys, F.posexplode(F.arrays_zip(F.col(times).alias("time"), F.col(values).alias("value"))).alias("sample", "cell")).select(*keys, F.col("sample").cast("long").alias("sample"), F.col("cell.time").alias("time"), F.col("cell.value").alias("value"))


def pack(df: DataFrame, *keys: str) -> DataFrame:
    """One row per trace with the arrays times and values in order of time."""
    by = keys or trace_keys(df)
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("cells")).select(*by, F.col("cells.time").alias("times"), F.col("cells.value").alias("values"))
