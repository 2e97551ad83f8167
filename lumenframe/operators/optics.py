"""Optical density and concentrations by the modified Beer-Lambert law."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.schema import trace, trace_keys, validates

TO_PER_MM = math.log(10) / 10


@validates(amplitudes=("value",))
def baseline(amplitudes: DataFrame) -> DataFrame:
    """Mean over time of each trace."""
    return amplitudes.groupBy(*trace_keys(amplitudes)).agg(F.avg("value").alias("baseline"))


@validates(amplitudes=("value",))
def int2od(amplitudes: DataFrame) -> DataFrame:
    """-ln(value / mean over time); a value that is not positive raises when the job runs."""
    good = F.assert_true(F.min("value").over(trace(amplitudes)) > 0, "amplitudes must be positive")
    return amplitudes.withColumn("value", F.coalesce(good.cast("double"), -F.log(F.col("value") / F.avg("value").over(trace(amplitudes)))))


def od2int(od: DataFrame, base: DataFrame) -> DataFrame:
    """baseline * exp(-od); base has the trace keys and baseline."""
    keys = [c for c in base.columns if c != "baseline"]
    return od.join(base, keys).withColumn("value", F.col("baseline") * F.exp(-F.col("value"))).select(*od.columns)


def channel_distances(channels: DataFrame, geo: DataFrame) -> DataFrame:
    """Distance of source and detector of each channel, in the unit of the points."""
    at = lambda p: geo.select(F.col("label").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    d2 = sum(((F.col(f"source_{c}") - F.col(f"detector_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return channels.select("channel", "source", "detector").distinct().join(at("source"), "source").join(at("detector"), "detector").select("channel", "source", "detector", F.sqrt(d2).alias("distance"))


def marked_long(ts: DataFrame, distances: DataFrame, threshold: float) -> DataFrame:
    """ts with long: whether the channel's distance (channel, distance) is the threshold or more; one pass over ts."""
    return ts.join(distances.select("channel", (F.col("distance") >= threshold).alias("long")), "channel")


def split_long_short(ts: DataFrame, geo: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(long, short): channels from the threshold on, and below it. Who needs both tells them apart by marked_long."""
    both = marked_long(ts, channel_distances(ts, geo), threshold)
    return both.where("long").drop("long"), both.where("NOT long").drop("long")


def extinction_coefficients(spectrum: DataFrame, wavelengths: list[float]) -> DataFrame:
    """(chromo, wavelength, coef) per mm and molar, linear between the rows of spectrum (wavelength, HbO, HbR in 1/(cm M)).

    A wavelength outside the table raises when the job runs.
    """
    spark = spectrum.sparkSession
    long = spectrum.select("wavelength", F.expr("stack(2, 'HbO', HbO, 'HbR', HbR) AS (chromo, c)"))
    at = spark.createDataFrame([(float(w),) for w in wavelengths], "at double")
    pairs = F.broadcast(at).join(long)
    low = F.max_by(F.struct("wavelength", "c"), F.when(F.col("wavelength") <= F.col("at"), F.col("wavelength")))
    high = F.min_by(F.struct("wavelength", "c"), F.when(F.col("wavelength") >= F.col("at"), F.col("wavelength")))
    near = pairs.groupBy("chromo", "at").agg(low.alias("lo"), high.alias("hi"))
    inside = F.assert_true((F.col("lo.wavelength") <= F.col("at")) & (F.col("hi.wavelength") >= F.col("at")), "wavelength outside the spectrum")
    step = F.col("hi.wavelength") - F.col("lo.wavelength")
    value = F.when(step == 0, F.col("lo.c")).otherwise(F.col("lo.c") + (F.col("hi.c") - F.col("lo.c")) * (F.col("at") - F.col("lo.wavelength")) / step)
    return near.select("chromo", F.col("at").alias("wavelength"), F.coalesce(inside.cast("double"), value * TO_PER_MM).alias("coef"))


def inverse_coefficients(coef: DataFrame) -> DataFrame:
    """Pseudo-inverse of the small (chromo, wavelength) table, as (chromo, wavelength, inv)."""
    rows = coef.collect()
    chromo, wl = sorted({r["chromo"] for r in rows}), sorted({r["wavelength"] for r in rows})
    e = np.zeros((len(wl), len(chromo)))
    for r in rows:
        e[wl.index(r["wavelength"]), chromo.index(r["chromo"])] = r["coef"]
    inv = np.linalg.pinv(e)
    return coef.sparkSession.createDataFrame([(c, w, float(inv[i, j])) for i, c in enumerate(chromo) for j, w in enumerate(wl)], "chromo string, wavelength double, inv double")


def od2conc(od: DataFrame, distances: DataFrame, dpf: dict[float, float], coef: DataFrame) -> DataFrame:
    """Concentrations in micromolar by chromo; distances (channel, distance in mm)."""
    spark = od.sparkSession
    path = spark.createDataFrame([(float(w), float(v)) for w, v in dpf.items()], "wavelength double, dpf double")
    small = inverse_coefficients(coef).join(path, "wavelength")
    keys = [c for c in od.columns if c not in ("wavelength", "value")]
    each = od.join(F.broadcast(small), "wavelength").join(distances.select("channel", "distance"), "channel")
    return each.groupBy(*keys, "chromo").agg(F.sum(F.col("inv") * F.col("value") / (F.col("distance") * F.col("dpf")) * 1e6).alias("value"))


def conc2od(conc: DataFrame, distances: DataFrame, dpf: dict[float, float], coef: DataFrame) -> DataFrame:
    """Optical density by wavelength of concentrations in micromolar."""
    path = conc.sparkSession.createDataFrame([(float(w), float(v)) for w, v in dpf.items()], "wavelength double, dpf double")
    keys = [c for c in conc.columns if c not in ("chromo", "value")]
    each = conc.join(F.broadcast(coef.join(path, "wavelength")), "chromo").join(distances.select("channel", "distance"), "channel")
    return each.groupBy(*keys, "wavelength").agg(F.sum(F.col("coef") * F.col("value") * 1e-6 * F.col("distance") * F.col("dpf")).alias("value"))


def beer_lambert(amplitudes: DataFrame, distances: DataFrame, dpf: dict[float, float], coef: DataFrame) -> DataFrame:
    return od2conc(int2od(amplitudes), distances, dpf, coef)
