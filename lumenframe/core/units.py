"""Units as column metadata, with the few conversions that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: factor to the base unit of each dimension (fixed values)
UNITS = {
    "length": {"m": 1.0, "cm": 1e-2, "mm": 1e-3, "um": 1e-6},
    "time": {"s": 1.0, "ms": 1e-3, "min": 60.0},
    "frequency": {"Hz": 1.0, "mHz": 1e-3, "kHz": 1e3},
    "concentration": {"molar": 1.0, "M": 1.0, "mM": 1e-3, "uM": 1e-6},
    "voltage": {"V": 1.0, "mV": 1e-3},
    "angle": {"rad": 1.0, "deg": 0.017453292519943295},
}


def dimension(unit: str) -> str:
    for name, table in UNITS.items():
        if unit in table:
            return name
    raise ValueError(f"unknown unit {unit!r}")


def factor(unit: str, to: str) -> float:
    if dimension(unit) != dimension(to):
        raise ValueError(f"{unit!r} and {to!r} have different dimensions")
    table = UNITS[dimension(unit)]
    return table[unit] / table[to]


def check_dimensionality(name: str, unit: str, wanted: str) -> None:
    if dimension(unit) != wanted:
        raise ValueError(f"{name} must have the dimension {wanted}")


def with_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    return df.withMetadata(column, {"unit": unit})


def unit_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("unit")


def is_quantified(df: DataFrame, column: str = "value") -> bool:
    return unit_of(df, column) is not None


def to_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    return with_unit(df.withColumn(column, F.col(column) * F.lit(factor(unit_of(df, column), unit))), column, unit)
