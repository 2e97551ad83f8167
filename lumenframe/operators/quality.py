"""Signal quality: metrics per trace or window, and masks from them (true: clean)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import along_time, spectral, trace, trace_keys
from ..core.scratch import stored


def sampling_rate(ts: DataFrame) -> DataFrame:
    """(trace keys, fs): samples less one over the time they span."""
    return ts.groupBy(*trace_keys(ts)).agg(F.try_divide(F.count("*") - 1, F.max("time") - F.min("time")).alias("fs"))


def snr(amplitudes: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Mean over standard deviation (ddof 0); a constant trace has no ratio and is clean only if nothing can exceed it."""
    out = amplitudes.groupBy(*trace_keys(amplitudes)).agg(F.try_divide(F.avg("value"), F.stddev_pop("value")).alias("snr"))
    return out.withColumn("mask", F.coalesce(F.col("snr") > threshold, F.lit(False)))


def mean_amp(amplitudes: DataFrame, low: float, high: float) -> DataFrame:
    out = amplitudes.groupBy(*trace_keys(amplitudes)).agg(F.avg("value").alias("mean_amp"))
    return out.withColumn("mask", (F.col("mean_amp") > low) & (F.col("mean_amp") < high))


def sd_dist(distances: DataFrame, low: float, high: float) -> DataFrame:
    """(channel, sd_dist rounded to 3 decimals, mask)."""
    d = F.round("distance", 3)
    return distances.select("channel", d.alias("sd_dist"), ((d > low) & (d < high)).alias("mask"))


def measurement_variance(ts: DataFrame, bad_channels: list[str] | None = None, bad_rel_var: float = 1e6, bad_abs_var: float | None = None) -> DataFrame:
    """Variance (ddof 0) per trace; bad or constant channels get a large one: bad_abs_var, or a multiple of the largest good one."""
    own = ts.groupBy(*trace_keys(ts)).agg(F.var_pop("value").alias("variance"))
    bad = (F.col("variance") == 0) | F.col("channel").isin(bad_channels or [])
    top = F.max(F.when(~bad, F.col("variance"))).over(Window.partitionBy(*spectral(ts)))
    fill = F.lit(bad_abs_var) if bad_abs_var is not None else top * bad_rel_var
    return own.withColumn("bad", bad).withColumn("variance", F.when(F.col("bad"), fill).otherwise(F.col("variance"))).drop("bad")


#: Channels of a block, cells that it may have on average, blocks at least (if there are channels for them), and pairs in a batch of the result.
BLOCK_CHANNELS, BLOCK_CELLS, LEAST_BLOCKS, BATCH_PAIRS = 1024, 2_000_000, 8, 1 << 16
PACKED = ("channels", "at", "times", "values")


def _packed_block(dims: list[str]):
    """The cells of a block's channels as one row: its channels, and by cell the channel's place, the time and the value less the channel's mean."""

    def run(key, table: pa.Table) -> pa.Table:
        named = table.column("channel").combine_chunks().dictionary_encode("encode")
        at, v = named.indices.to_numpy(), table.column("value").to_numpy()
        known = np.isfinite(v)
        mean = np.bincount(at[known], v[known], len(named.dictionary)) / np.maximum(np.bincount(at[known], minlength=len(named.dictionary)), 1)
        values = pa.array(v - mean[at], mask=table.column("value").combine_chunks().is_null().to_numpy(zero_copy_only=False))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (named.dictionary, named.indices, table.column("time").combine_chunks(), values)]
        return pa.table([*(pa.array([k.as_py()], table.schema.field(d).type) for d, k in zip([*dims, "_block"], key, strict=True)), *lists], names=[*dims, "_block", *PACKED])

    # grouped functions tell their kind by whole annotations or none
    run.__annotations__ = {}
    return run


def _pair_covariances(dims: list[str], slab: int = 4_000_000):
    """Covariances of the channels of two packed blocks, from sums over slabs of their times; a row and its mirror image if the blocks differ."""

    def sums(row: dict[str, pa.Array], sides: list[str]) -> list[np.ndarray]:
        names = [len(row[s + "channels"]) for s in sides]
        sizes = [len(row[s + "at"]) for s in sides]
        times, t = np.unique(np.concatenate([row[s + "times"].to_numpy(zero_copy_only=False) for s in sides]), return_inverse=True)
        t, parts, width = np.split(t, np.cumsum(sizes)[:-1]), [], max(1, min(slab // sum(names), len(times)))
        for s, own in zip(sides, t, strict=True):
            # a slab's cells lie together
            order = np.argsort(own, kind="stable")
            v = row[s + "values"].to_numpy(zero_copy_only=False)[order]
            missing = row[s + "values"].is_null().to_numpy(zero_copy_only=False)[order]
            wrong = ~missing & ~np.isfinite(v)
            parts.append((row[s + "at"].to_numpy()[order].astype(np.int64), own[order], np.where(missing | wrong, 0.0, v), ~missing, wrong))
        n, sa, sb, sab, met, bad = np.zeros((6, names[0], names[-1]))
        whole = all(known.all() for *_, known, _ in parts)
        for start in range(0, len(times), width):
            grids = []
            for k, (at, own, clean, known, wrong) in zip(names, parts, strict=True):
                cut = slice(*np.searchsorted(own, [start, start + width]))
                cell, held = at[cut] * width + own[cut] - start, k * width
                grid = lambda w, cell=cell, held=held, k=k: np.bincount(cell, w, held).astype(float).reshape(k, width)
                rows = grid(None)
                grids.append((grid(clean[cut]), rows if whole else grid(known[cut]), rows, grid(wrong[cut]) if wrong[cut].any() else None))
            (x, k, rows, nan), (x_, k_, rows_, nan_) = grids[0], grids[-1]
            n += k @ k_.T
            sa += x @ k_.T
            sb += k @ x_.T
            sab += x @ x_.T
            met += 0 if whole else rows @ rows_.T
            for left, right in ((nan, k_), (k, nan_)):
                if left is not None and right is not None:
                    bad += left @ right.T
        return [n, sa, sb, sab, n if whole else met, bad]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lo, hi = (batch.column(f"{s}_block")[r].as_py() for s in ("", "_"))
                row = {c: batch.column(c)[r].values for c in batch.schema.names if c.lstrip("_") in PACKED}
                mine, other = row["channels"], row["_channels"]
                n, sa, sb, sab, met, bad = sums(row, ["", "_"] if lo != hi else [""])
                step = max(1, BATCH_PAIRS // len(other))
                for a in range(0, len(mine), step):
                    some = slice(a, a + step)
                    i, j = np.nonzero(met[some])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        cov = np.where(bad[some] > 0, np.nan, (sab[some] - sa[some] * sb[some] / n[some]) / (n[some] - 1))
                    one = pa.array(cov[i, j], mask=n[some][i, j] < 2)
                    pair = mine.take(pa.array(i + a)), other.take(pa.array(j))
                    label = [pa.repeat(batch.column(d)[r], len(i)) for d in dims]
                    for x, y in (pair, pair[::-1])[: 1 + (lo != hi)]:
                        yield pa.RecordBatch.from_arrays([*label, x, y, one], names=[*dims, "a", "b", "covariance"])

    return run


def measurement_covariance(ts: DataFrame) -> DataFrame:
    """Sample covariance (ddof 1) of each pair of channels, by spectral label; series are joined on time.

    Channels are dealt into blocks by their hash, and a block's series are packed and stored once. Each pair of blocks
    has a task that reads both, so no series is copied for every block that it meets: sums of products over slabs of
    times are matrix products, and the pairs leave in batches. The pairs are the result.
    """
    dims, kinds = spectral(ts), dict(ts.dtypes)
    cells = ts.select(*dims, "channel", "time", F.col("value").cast("double").alias("value")).where(F.col("time").isNotNull())
    for d in dims:
        cells = cells.where(F.col(d).isNotNull())
    size = cells.agg(F.count("*").alias("n"), F.approx_count_distinct("channel").alias("channels")).first()
    channels = max(size["channels"], 1)
    each = max(1, min(BLOCK_CHANNELS, BLOCK_CELLS * channels // max(size["n"], 1), -(-channels // LEAST_BLOCKS)))
    blocks = -(-channels // each)
    label = "".join(f"{d} {kinds[d]}, " for d in dims)
    keyed = cells.withColumn("_block", F.pmod(F.xxhash64("channel"), F.lit(blocks)).cast("int"))
    packed = stored(keyed.groupBy(*dims, "_block").applyInArrow(_packed_block(dims), f"{label}_block int, channels array<{kinds['channel']}>, at array<int>, times array<{kinds['time']}>, values array<double>"))
    one = packed.repartitionById(blocks, "_block")
    two = one.select(*[F.col(c).alias(f"_{c}") for c in one.columns])
    same = functools.reduce(Column.__and__, [F.col(d) == F.col(f"_{d}") for d in dims], F.col("_block") <= F.col("__block"))
    met = one.join(two.hint("shuffle_replicate_nl"), same).drop(*[f"_{d}" for d in dims])
    return met.mapInArrow(_pair_covariances(dims), f"{label}a {kinds['channel']}, b {kinds['channel']}, covariance double")


def gvtd(od: DataFrame, fs: float, wavelength: float | None = None) -> DataFrame:
    """(time, gvtd): root mean square over channels of the first difference, times fs; the first is 0. od is band-passed by the caller."""
    one = od.where(F.col("wavelength") == wavelength) if wavelength is not None else od
    d = one.withColumn("d", F.coalesce(F.col("value") - F.lag("value").over(along_time(one)), F.lit(0.0)))
    return d.groupBy("time").agg((F.sqrt(F.avg(F.col("d") * F.col("d"))) * fs).alias("gvtd"))


def gvtd_threshold(g: DataFrame, kind: str = "default", n_std: float = 10.0) -> DataFrame:
    """One row (threshold). kind: default, histogram_mode, kdensity_mode, parabolic_mode, median, mean or MAD."""
    x = F.col("gvtd")
    if kind in ("median", "mean"):
        centre = g.agg((F.percentile("gvtd", 0.5) if kind == "median" else F.avg("gvtd")).alias("c"))
        return _above(g, centre, n_std)
    if kind == "MAD":
        centre = g.agg(F.percentile("gvtd", 0.5).alias("c"))
        dev = g.join(F.broadcast(centre)).agg(F.percentile(F.abs(x - F.col("c")), 0.5).alias("mad"), F.first("c").alias("c"))
        return dev.select((F.lit(n_std) * F.col("mad")).alias("threshold"))
    if kind == "kdensity_mode":
        return _above(g, g.sparkSession.createDataFrame([(density_mode(g),)], "c double"), n_std)
    stats = g.agg(F.greatest(F.round(F.count("*") / 5), F.lit(1)).cast("int").alias("n"), F.max("gvtd").alias("top"), F.min("gvtd").alias("low"))
    width = F.col("top") / F.col("n")
    binned = g.join(F.broadcast(stats)).withColumn("bin", F.least(F.floor(x / width), F.col("n") - 1))
    hist = binned.groupBy("bin").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("top").alias("top"), F.first("low").alias("low"))
    best = hist.agg(F.max(F.struct("k", (-F.col("bin")).alias("b"))).alias("m"), F.first("n").alias("n"), F.first("top").alias("top"), F.first("low").alias("low"))
    mode = best.select((-F.col("m.b") * F.col("top") / F.col("n") + F.col("top") / F.col("n") / 2).alias("c"), "low", (-F.col("m.b")).alias("bin"), (F.col("top") / F.col("n")).alias("w"))
    if kind == "default":
        return mode.select((2 * F.col("c") - F.col("low")).alias("threshold"))
    if kind == "histogram_mode":
        return _above(g, mode.select("c"), n_std)
    if kind == "parabolic_mode":
        near = hist.join(F.broadcast(mode.select(F.col("bin").alias("at"), "c", "w"))).where(F.abs(F.col("bin") - F.col("at")) <= 1)
        three = near.agg(*[F.coalesce(F.max(F.when(F.col("bin") - F.col("at") == j, F.col("k"))), F.lit(0)).alias(f"y{j + 1}") for j in (-1, 0, 1)], F.first("c").alias("c0"), F.first("w").alias("w"))
        top = F.coalesce(F.try_divide(F.col("y0") - F.col("y2"), 2.0 * (F.col("y0") - 2 * F.col("y1") + F.col("y2"))), F.lit(0.0))
        return _above(g, three.select((F.col("c0") + F.col("w") * top).alias("c")), n_std)
    raise ValueError(f"unknown threshold {kind!r}")


def density_mode(g: DataFrame, points: int = 1000, bins: int = 4096) -> float:
    """Mode of the logarithm's kernel density (Scott's width), back on the scale of gvtd.

    Spark counts the logarithms in fine bins; the density is evaluated over those bounded counts.
    """
    x = g.where("gvtd > 0").select(F.log("gvtd").alias("x"))
    s = x.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.stddev_samp("x").alias("s")).first()
    if not s["n"] or s["a"] == s["b"] or not s["s"]:
        return float(np.exp(s["a"])) if s["n"] else 0.0
    step = (s["b"] - s["a"]) / bins
    rows = x.groupBy(F.least(F.floor((F.col("x") - s["a"]) / step), F.lit(bins - 1)).alias("k")).agg(F.count("*").alias("n")).collect()
    at, weight = np.array([s["a"] + (r["k"] + 0.5) * step for r in rows]), np.array([r["n"] for r in rows], float)
    width, grid = s["s"] * s["n"] ** -0.2, np.linspace(s["a"], s["b"], points)
    density = (np.exp(-0.5 * ((grid[:, None] - at[None]) / width) ** 2) * weight).sum(1)
    return float(np.exp(grid[density.argmax()]))


def _above(g: DataFrame, centre: DataFrame, n_std: float) -> DataFrame:
    """centre plus n_std times the left-sided deviation."""
    d = F.col("gvtd") - F.col("c")
    left = g.join(F.broadcast(centre)).agg(F.sqrt(F.avg(F.when(d < 0, d * d))).alias("s"), F.first("c").alias("c"))
    return left.select((F.col("c") + n_std * F.coalesce("s", F.lit(0.0))).alias("threshold"))


def gvtd_mask(g: DataFrame, threshold: DataFrame) -> DataFrame:
    return g.join(F.broadcast(threshold)).select("time", "gvtd", (F.col("gvtd") < F.col("threshold")).alias("mask"))


def id_motion(od: DataFrame, fs: float, t_motion: float = 0.5, t_mask: float = 1.0, stdev_thresh: float = 50.0, amp_thresh: float = 5.0) -> DataFrame:
    """od with mask in place of value: false within t_mask of a jump larger than the thresholds inside t_motion."""
    k, m, w = round(t_motion * fs), round(t_mask * fs), along_time(od)
    jump = F.greatest(*[F.abs(F.coalesce(F.lead("value", i).over(w) - F.col("value"), F.lit(0.0))) for i in range(1, k + 1)], F.lit(0.0))
    stepped = od.withColumn("_jump", jump).withColumn("_d", F.lead("value").over(w) - F.col("value"))
    sd = F.stddev_pop("_d").over(trace(od))
    art = stepped.withColumn("_art", ((F.col("_jump") > sd * stdev_thresh) | (F.col("_jump") > amp_thresh)).cast("int"))
    return art.withColumn("mask", F.max("_art").over(w.rowsBetween(-m, m)) == 0).drop("_jump", "_d", "_art", "value")


def id_motion_refine(mask: DataFrame, operator: str) -> tuple[DataFrame, DataFrame]:
    """(mask, info): by_channel collapses the spectral dimension, all collapses everything but time.

    info: share and number of artefact runs per channel, or for the whole.
    """
    if operator not in ("by_channel", "all"):
        raise ValueError("operator must be by_channel or all")
    keys = ["channel", "sample", "time"] if operator == "by_channel" else ["sample", "time"]
    out = mask.groupBy(*keys).agg(F.bool_and("mask").alias("mask"))
    who = [k for k in keys if k == "channel"]
    w = Window.partitionBy(*who).orderBy("sample")
    begun = (~F.col("mask")) & F.coalesce(F.lag("mask").over(w), F.lit(True))
    info = out.withColumn("_b", begun.cast("long")).groupBy(*who).agg(F.avg((~F.col("mask")).cast("double")).alias("fraction"), F.sum("_b").alias("n_artifacts"))
    return out, info


def iqr_mask(df: DataFrame, threshold: float) -> Column:
    """Not beyond the quartiles widened by a multiple of their distance, within each trace; the limits and unknown values are clean."""
    q = F.percentile("_x", F.array(F.lit(0.25), F.lit(0.75))).over(trace(df))
    low, high = F.get(q, 0), F.get(q, 1)
    return F.coalesce((F.col("_x") >= low - threshold * (high - low)) & (F.col("_x") <= high + threshold * (high - low)), F.lit(True))


def outliers_std(ts: DataFrame, n: int, threshold: float = 2.0) -> DataFrame:
    """Centred rolling deviation over n samples against its quartiles; ts is taken as it is (kernels.detect_outliers_std filters first)."""
    x = ts.withColumn("_x", F.stddev_pop("value").over(along_time(ts).rowsBetween(-(n // 2), (n - 1) // 2)))
    return x.withColumn("mask", iqr_mask(ts, threshold)).drop("_x", "value")


def outliers_grad(ts: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Central difference (zero beyond the edges) against its quartiles; ts is taken as it is (kernels.detect_outliers_grad filters first)."""
    w = along_time(ts)
    x = ts.withColumn("_x", F.lag("value", 1, 0.0).over(w) - F.lead("value", 1, 0.0).over(w))
    return x.withColumn("mask", iqr_mask(ts, threshold)).drop("_x", "value")


def outliers(ts_std: DataFrame, ts_grad: DataFrame) -> DataFrame:
    """AND of two masks with the same keys."""
    keys = [c for c in ts_std.columns if c != "mask"]
    return ts_std.join(ts_grad.withColumnRenamed("mask", "_m"), keys).withColumn("mask", F.col("mask") & F.col("_m")).drop("_m")


def stimulus_mask(stim: DataFrame, mask: DataFrame) -> DataFrame:
    """(event, channel, mask): whether all samples within [onset, onset + duration) are clean; none: true.

    Events meet samples by the seconds they touch, so the join is on a key.
    """
    events = stim.select(F.col("event_id").alias("event"), "onset", (F.col("onset") + F.col("duration")).alias("stop"))
    bad = mask.where(~F.col("mask")).select("channel", "time", F.floor("time").alias("_s"))
    binned = events.withColumn("_s", F.explode(F.sequence(F.floor("onset"), F.greatest(F.floor("onset"), F.floor("stop")))))
    hit = bad.join(binned, "_s").where((F.col("time") >= F.col("onset")) & (F.col("time") < F.col("stop"))).select("event", "channel").distinct().withColumn("mask", F.lit(False))
    every = mask.select("channel").distinct().join(events.select("event"))
    return every.join(hit, ["event", "channel"], "left").select("event", "channel", F.coalesce("mask", F.lit(True)).alias("mask"))


def repair_amp(amp: DataFrame, median_len: int = 3) -> DataFrame:
    """NULLs interpolated along time, values that are not positive lifted to 1e-18, then a centred median with the edges repeated."""
    w = along_time(amp)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("time", "value"))
    lo, hi = F.last(known, True).over(back), F.first(known, True).over(ahead)
    line = F.when(lo["time"] == hi["time"], lo["value"]).otherwise(lo["value"] + (hi["value"] - lo["value"]) * (F.col("time") - lo["time"]) / (hi["time"] - lo["time"]))
    full = amp.withColumn("value", line).withColumn("value", F.when(F.col("value") <= 0, F.lit(1e-18)).otherwise(F.col("value")))
    half = median_len // 2
    first, last = F.first("value").over(trace(amp).orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("value").over(trace(amp).orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n, i = F.count("*").over(trace(amp)), F.row_number().over(w)
    around = F.collect_list("value").over(w.rowsBetween(-half, median_len - 1 - half))
    padded = F.concat(F.array_repeat(first, F.greatest(F.lit(half + 1) - i, F.lit(0)).cast("int")), around, F.array_repeat(last, F.greatest(i + (median_len - 1 - half) - n, F.lit(0)).cast("int")))
    s = F.sort_array(padded)
    mid = (F.get(s, F.lit((median_len - 1) // 2)) + F.get(s, F.lit(median_len // 2))) / 2
    return full.withColumn("value", mid)
