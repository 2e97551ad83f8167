"""Checks of the inputs and options of decompositions of two modalities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..core.schema import require


def columns(x: DataFrame, y: DataFrame, sample: str = "sample", feature_x: str = "channel", feature_y: str = "channel") -> None:
    """Both tables have their sample, feature and value columns; raises SchemaError, starts no job."""
    require(x, sample, feature_x, "value")
    require(y, sample, feature_y, "value")


def n_components(n_x: int, n_y: int, n_features: int, k: int | None) -> int:
    """k, or all features for none; the sizes must fit: as many samples in both, and no fewer than features."""
    if n_x != n_y:
        raise ValueError(f"x has {n_x} samples but y has {n_y}")
    if n_x < n_features:
        raise ValueError(f"{n_x} samples do not suffice for {n_features} features")
    if k and k > n_features:
        raise ValueError(f"{k} components are more than {n_features} features")
    return k or n_features


def penalties(reg, name: str = "penalty") -> tuple[float, float]:
    """A penalty for each side, from a number or a pair."""
    if isinstance(reg, int | float):
        return float(reg), float(reg)
    if isinstance(reg, list | tuple) and len(reg) == 2:
        return float(reg[0]), float(reg[1])
    raise ValueError(f"{name} must be a number or a pair, not {reg!r}")


def time_shifts(t_max: float, shifts) -> list:
    """The shifts in ascending order with 0 in front; none may be negative or reach t_max."""
    out = sorted(np.asarray(shifts).tolist())
    if not out or out[0] < 0:
        raise ValueError("time shifts must be given and none may be negative")
    if out[-1] >= t_max:
        raise ValueError(f"the shift {out[-1]} is not inside the record, which ends at {t_max}")
    return out if out[0] == 0 else [type(out[0])(0), *out]


def same_features(fitted: list[str], given: list[str]) -> None:
    """Data to transform has the features that were fitted."""
    if set(fitted) != set(given):
        raise ValueError(f"features differ from the fitted ones: {sorted(set(fitted) ^ set(given))[:5]}")
