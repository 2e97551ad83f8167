"""Synthetic events, artefacts and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import trace_keys


def spike(time: Column, onset: Column, duration: Column) -> Column:
    """exp(-((t - onset) / d)^2 / 2) with d of at most 5."""
    return F.exp(-0.5 * ((time - onset) / F.least(duration, F.lit(5.0))) ** 2)


def bl_shift(time: Column, onset: Column, duration: Column) -> Column:
    return F.when(time >= onset, 1.0).otherwise(0.0)


ARTIFACTS: dict[str, Callable[[Column, Column, Column], Column]] = {"spike": spike, "bl_shift": bl_shift}


def add_artifact_direct(ts: DataFrame, onset: float, duration: float, kind: str, scale: float = 1.0) -> DataFrame:
    if kind not in ARTIFACTS:
        raise ValueError(f"unknown artefact {kind!r}")
    return ts.withColumn("value", F.col("value") + scale * ARTIFACTS[kind](F.col("time"), F.lit(float(onset)), F.lit(float(duration))))


def artifact_scale(ts: DataFrame, window: int = 120) -> DataFrame:
    """Median of the peak-to-peak range over windows that are centred on every (window / 2)-th sample, per trace.

    Only windows that lie wholly inside the record and have no gap count; a trace without any has no row.
    """
    keys, step = trace_keys(ts), max(window // 2, 1)
    before, after = window // 2, window - 1 - window // 2
    # the windows k * step - before ... k * step + after that hold a sample: three at most
    lowest = F.greatest(F.ceil((F.col("sample") - after) / step), F.lit(0)).cast("long")
    highest = F.floor((F.col("sample") + before) / step).cast("long")
    inside = ts.where("value IS NOT NULL").select(*keys, "value", F.explode(F.filter(F.sequence(lowest, F.greatest(lowest, highest)), lambda k: k <= highest)).alias("_w"))
    ranges = inside.groupBy(*keys, "_w").agg((F.max("value") - F.min("value")).alias("_r"), F.count("*").alias("_n")).where(F.col("_n") == window)
    return ranges.groupBy(*keys).agg(F.percentile("_r", 0.5).alias("scale"))


def add_artifacts(ts: DataFrame, events: DataFrame, scale: float = 1.0, window: int = 120, auto: bool = True) -> DataFrame:
    """ts plus all events (onset, duration, trial_type, channel or NULL for all) that lie inside the record.

    In auto mode an artefact is as high as the trace's median range; values of traces too short to have one
    become NULL. Events are few and broadcast;
    a spike is added to every sample, a baseline shift to those after its onset.
    """
    kinds = [r[0] for r in events.select("trial_type").distinct().limit(len(ARTIFACTS) + 1).collect()]
    for k in kinds:
        if k not in ARTIFACTS:
            raise ValueError(f"unknown artefact {k!r}")
    keys = trace_keys(ts)
    end = Window.partitionBy(*keys)
    e = F.broadcast(events.select(F.col("onset").alias("_on"), F.col("duration").alias("_d"), F.col("trial_type").alias("_k"), F.col("channel").alias("_c")))
    spanned = ts.withColumn("_t0", F.min("time").over(end)).withColumn("_t1", F.max("time").over(end))
    hit = spanned.join(e, (F.col("_c").isNull() | (F.col("_c") == F.col("channel"))) & (F.col("_on") >= F.col("_t0")) & (F.col("_on") + F.col("_d") <= F.col("_t1")), "left")
    shape = F.lit(0.0)
    for k, f in ARTIFACTS.items():
        shape = F.when(F.col("_k") == k, f(F.col("time"), F.col("_on"), F.col("_d"))).otherwise(shape)
    total = hit.groupBy(*keys, "sample", "time").agg(F.first("value").alias("value"), F.sum(shape).alias("_a"))
    if auto:
        total = total.join(artifact_scale(ts, window), keys, "left")
    return total.withColumn("value", F.col("value") + scale * (F.col("scale") if auto else F.lit(1.0)) * F.coalesce("_a", F.lit(0.0))).select(*keys, "sample", "time", "value")


def add_event_timing(events: DataFrame | None, timing: list[tuple], trial_type: str, channels: list[str] | None = None, *, spark=None) -> DataFrame:
    """events and further ones of one type: (onset, duration) or (onset, duration, value), on the channels (None: all)."""
    for x in timing:
        if len(x) not in (2, 3):
            raise ValueError(f"an event is (onset, duration) or (onset, duration, value), not {x!r}")
    rows = [(float(x[0]), float(x[1]), trial_type, float(x[2]) if len(x) == 3 else 1.0, channels) for x in timing]
    session = spark or events.sparkSession
    new = session.createDataFrame(rows, "onset double, duration double, trial_type string, value double, channel array<string>")
    new = new.withColumn("channel", F.explode_outer("channel"))
    return new if events is None else events.unionByName(new, allowMissingColumns=True)


def _on_channels(events: DataFrame, channels: list[str] | None) -> DataFrame:
    """A row of each event for each channel; without channels one of channel NULL, which means all."""
    names = F.array(*[F.lit(c) for c in channels]) if channels else F.array(F.lit(None).cast("string"))
    return events.withColumn("channel", F.explode(names))


def random_events(spark, t_end: float, n: int, types: list[str], channels: list[str] | None = None, seed: int = 0, t_start: float = 0.0) -> DataFrame:
    """n events of a random type, uniform in onset and, from 0.1 up to the record's end, in duration."""
    names = F.array(*[F.lit(t) for t in types])
    base = spark.range(n).select(F.col("id").alias("event_id"), (t_start + F.rand(seed) * (t_end - t_start)).alias("onset"), F.rand(seed + 1).alias("_u"), F.floor(F.rand(seed + 2) * len(types)).cast("int").alias("_k"))
    duration = 0.1 + F.col("_u") * (t_end - F.col("onset") - 0.1)
    return _on_channels(base.select("event_id", "onset", duration.alias("duration"), F.lit(1.0).alias("value"), F.get(names, F.col("_k")).alias("trial_type")), channels)


def random_events_share(spark, t_end: float, share: float, types: list[str], channels: list[str] | None = None, min_dur: float = 0.1, max_dur: float = 0.4, seed: int = 0, t_start: float = 0.0) -> DataFrame:
    """Random events that end inside the record, until their durations reach the share of its time.

    Candidates are drawn for the most events that can be needed; those past the record's end are left
    out and the others are counted in the order of their ids.
    """
    span = t_end - t_start
    if max_dur >= span:
        raise ValueError("events must be shorter than the record")
    need = share * span / min_dur + 1
    most = int((need + 10 * need**0.5 + 10) / (1 - max_dur / span)) + 1
    names = F.array(*[F.lit(t) for t in types])
    drawn = spark.range(most).select(F.col("id").alias("event_id"), (t_start + F.rand(seed) * span).alias("onset"), (min_dur + F.rand(seed + 1) * (max_dur - min_dur)).alias("duration"), F.floor(F.rand(seed + 2) * len(types)).cast("int").alias("_k"))
    inside = drawn.where(F.col("onset") + F.col("duration") < t_end)
    before = F.coalesce(F.sum("duration").over(Window.orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    events = inside.withColumn("_s", before).where(F.col("_s") < share * span)
    return _on_channels(events.select("event_id", "onset", "duration", F.lit(1.0).alias("value"), F.get(names, F.col("_k")).alias("trial_type")), channels)


def stimulus_schedule(spark, t_end: float, types: list[str], min_dur: float, max_dur: float, min_gap: float, max_gap: float, order: str = "alternating", seed: int = 0) -> DataFrame:
    """Events one after another with random durations and gaps, while they end before t_end. order: alternating or random."""
    most = int(t_end / (min_dur + min_gap)) + 1
    base = spark.range(most).select(F.col("id").alias("event_id"), (min_dur + F.rand(seed) * (max_dur - min_dur)).alias("duration"), (min_gap + F.rand(seed + 1) * (max_gap - min_gap)).alias("_gap"))
    w = Window.orderBy("event_id")
    spent = F.sum(F.col("duration") + F.col("_gap")).over(w) - F.col("duration")
    names = F.array(*[F.lit(t) for t in types])
    pick = F.pmod("event_id", F.lit(len(types))) if order == "alternating" else F.floor(F.rand(seed + 2) * len(types))
    return base.withColumn("onset", spent).where(F.col("onset") + F.col("duration") <= t_end).select("event_id", "onset", "duration", F.lit(1.0).alias("value"), F.get(names, pick.cast("int")).alias("trial_type"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, gap: float = 0.0) -> Column:
    return ~((a1 + gap <= b0) | (a0 >= b1 + gap))


def synthetic_hrf(pattern: DataFrame, regressors: DataFrame, stim: DataFrame) -> DataFrame:
    """(channel, ..., sample, value): spatial pattern times response times the largest event value, summed over trial types."""
    top = stim.groupBy(F.concat(F.lit("HRF "), "trial_type").alias("regressor")).agg(F.max("value").alias("_m"))
    keys = [c for c in pattern.columns if c != "value"]
    r = regressors.join(top, "regressor").groupBy("sample").agg(F.sum(F.col("value") * F.col("_m")).alias("_r"))
    return pattern.join(r).select(*keys, "sample", (F.col("value") * F.col("_r")).alias("value"))


def add_chromo_artifacts(od: DataFrame, events: DataFrame, distances: DataFrame, dpf: dict[float, float], coef: DataFrame, **how) -> DataFrame:
    """Artefacts added to the concentrations of od and taken back to optical density."""
    from .optics import conc2od, od2conc

    return conc2od(add_artifacts(od2conc(od, distances, dpf, coef), events, **how), distances, dpf, coef)
