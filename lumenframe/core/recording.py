"""A recording: named lazy tables of one measurement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_name(name: str, taken) -> str:
    """name, or name_02, name_03, ... if it is taken."""
    k, out = 2, name
    while out in taken:
        out, k = f"{name}_{k:02d}", k + 1
    return out


def _last(table: dict[str, DataFrame], key: str | None) -> DataFrame:
    if not table:
        raise ValueError("nothing is stored")
    return table[key if key is not None else next(reversed(table))]


def _put(table: dict[str, DataFrame], key: str, value: DataFrame, overwrite: bool) -> None:
    if key in table and not overwrite:
        raise ValueError(f"{key!r} exists")
    table[key] = value


@dataclass
class Recording:
    timeseries: dict[str, DataFrame] = field(default_factory=dict)
    masks: dict[str, DataFrame] = field(default_factory=dict)
    geo3d: DataFrame | None = None
    geo2d: DataFrame | None = None
    stim: DataFrame | None = None
    aux_ts: dict[str, DataFrame] = field(default_factory=dict)
    aux_obj: dict[str, object] = field(default_factory=dict)
    head_model: object | None = None
    meta_data: dict[str, str] = field(default_factory=dict)

    def get_timeseries(self, key: str | None = None) -> DataFrame:
        return _last(self.timeseries, key)

    def set_timeseries(self, key: str, value: DataFrame, overwrite: bool = False) -> None:
        _put(self.timeseries, key, value, overwrite)

    def __getitem__(self, key: str) -> DataFrame:
        return self.timeseries[key]

    def __setitem__(self, key: str, value: DataFrame) -> None:
        self.timeseries[key] = value

    def get_mask(self, key: str | None = None) -> DataFrame:
        return _last(self.masks, key)

    def set_mask(self, key: str, value: DataFrame, overwrite: bool = False) -> None:
        _put(self.masks, key, value, overwrite)

    def get_timeseries_type(self, key: str) -> str:
        for prefix, kind in (("amp", "amplitude"), ("od", "od"), ("conc", "concentration"), ("hrf", "hrf")):
            if key.startswith(prefix):
                return kind
        if (self.timeseries[key].schema["value"].metadata or {}).get("unit") in ("M", "mM", "uM", "molar"):
            return "concentration"
        raise ValueError(f"the type of {key!r} is not known")

    def _distinct(self, column: str) -> list:
        out = None
        for df in self.timeseries.values():
            if column in df.columns:
                mine = df.select(column)
                out = mine if out is None else out.union(mine)
        return [] if out is None else [r[0] for r in out.distinct().orderBy(column).collect()]

    def source_labels(self) -> list[str]:
        return self._distinct("source")

    def detector_labels(self) -> list[str]:
        return self._distinct("detector")

    def wavelengths(self) -> list[float]:
        return self._distinct("wavelength")

    def trial_types(self) -> list[str]:
        """In order of first onset."""
        return [r["trial_type"] for r in self.stim.groupBy("trial_type").agg(F.min("onset").alias("t")).orderBy("t", "trial_type").collect()]


TASKS: dict[str, object] = {}


def task(f):
    """Register a function that works on recordings by its name."""
    if f.__name__ in TASKS:
        raise ValueError(f"a task {f.__name__!r} exists")
    TASKS[f.__name__] = f
    return f
