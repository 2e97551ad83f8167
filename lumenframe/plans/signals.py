"""Queries over time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.schema import build_timeseries, pack
from ..operators import epochs as ep
from ..operators import glm, kernels, masks, optics, quality, simulation, stats, windows
from .common import query, r
from .tables import CHANNELS, COEF, DPF, FS, GEO, STIM, TS, W, WO, channels, geo, spectrum, stim, ts

KEYS = "channel, wavelength"
CELL = "channel, wavelength, sample, time"


def od(spark, d) -> DataFrame:
    return optics.int2od(ts(spark, d))


OD = f"od AS (SELECT {CELL}, -ln(value / avg(value) OVER ({W})) AS value FROM ts)"


@query(f"WITH {TS}, {OD} SELECT {CELL}, {r('value')} FROM od")
def int2od(spark, d):
    return od(spark, d)


@query(f"WITH {TS} SELECT {CELL}, {r('value')} FROM ts")
def od2int_roundtrip(spark, d):
    a = ts(spark, d)
    return optics.od2int(optics.int2od(a), optics.baseline(a))


@query(f"WITH {TS} SELECT {KEYS}, {r('avg(value)', 'baseline')} FROM ts GROUP BY ALL")
def amplitude_baseline(spark, d):
    return optics.baseline(ts(spark, d))


DIST = f"""dist AS (SELECT channel, source, detector, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z)) AS distance
  FROM channels JOIN geo s ON s.label = source JOIN geo t ON t.label = detector)"""


def distances(spark, d):
    return optics.channel_distances(channels(spark, d), geo(spark, d))


@query(f"WITH {GEO}, {CHANNELS}, {DIST} SELECT channel, source, detector, {r('distance')} FROM dist")
def channel_distances(spark, d):
    return distances(spark, d)


@query(f"WITH {GEO}, {CHANNELS}, {DIST} SELECT channel, round(distance, 3) + 0.0 AS sd_dist, round(distance, 3) > 0.05 AND round(distance, 3) < 0.3 AS mask FROM dist")
def sd_dist(spark, d):
    return quality.sd_dist(distances(spark, d), 0.05, 0.3)


@query(f"WITH {TS}, {GEO}, {CHANNELS}, {DIST} SELECT distance >= 0.2 AS long, {CELL}, {r('value')} FROM ts JOIN dist USING (channel)")
def split_long_short(spark, d):
    return optics.marked_long(ts(spark, d), distances(spark, d), 0.2).select("long", "channel", "wavelength", "sample", "time", "value")


@query(f"WITH {COEF} SELECT chromo, wavelength, {r('coef')} FROM coef")
def extinction_coefficients(spark, d):
    return optics.extinction_coefficients(spectrum(spark), [760.0, 850.0])


INV = """det AS (SELECT max(coef) FILTER (WHERE chromo='HbO' AND wavelength=760) AS a, max(coef) FILTER (WHERE chromo='HbR' AND wavelength=760) AS b,
  max(coef) FILTER (WHERE chromo='HbO' AND wavelength=850) AS c, max(coef) FILTER (WHERE chromo='HbR' AND wavelength=850) AS e FROM coef),
inv AS (SELECT 'HbO' AS chromo, 760.0::DOUBLE AS wavelength, e/(a*e-b*c) AS i FROM det UNION ALL SELECT 'HbO', 850.0, -b/(a*e-b*c) FROM det
  UNION ALL SELECT 'HbR', 760.0, -c/(a*e-b*c) FROM det UNION ALL SELECT 'HbR', 850.0, a/(a*e-b*c) FROM det),
dpf AS (SELECT * FROM (VALUES (760.0::DOUBLE, 6.5::DOUBLE), (850.0, 5.75)) AS t(wavelength, dpf))"""
CONC = f"conc AS (SELECT channel, sample, time, chromo, sum(i * value / (distance * 100 * dpf) * 1e6) AS value FROM od JOIN inv USING (wavelength) JOIN dpf USING (wavelength) JOIN dist USING (channel) GROUP BY ALL)"


def millimetres(spark, d):
    return distances(spark, d).where("distance > 0").withColumn("distance", F.col("distance") * 100)


def conc(spark, d):
    coef = optics.extinction_coefficients(spectrum(spark), [760.0, 850.0])
    return optics.od2conc(od(spark, d), millimetres(spark, d), DPF, coef)


POS = "dist AS (SELECT * FROM dist0 WHERE distance > 0)"
OPT = f"{TS}, {OD}, {GEO}, {CHANNELS}, {DIST.replace('dist AS', 'dist0 AS')}, {POS}, {COEF}, {INV}, {CONC}"


@query(f"WITH {OPT} SELECT channel, sample, time, chromo, {r('value')} FROM conc")
def od2conc(spark, d):
    return conc(spark, d)


@query(f"WITH {OPT} SELECT channel, sample, time, wavelength, {r('sum(coef * value * 1e-6 * distance * 100 * dpf)', 'value')} FROM conc JOIN coef USING (chromo) JOIN dpf USING (wavelength) JOIN dist USING (channel) GROUP BY channel, sample, time, wavelength")
def conc2od(spark, d):
    coef = optics.extinction_coefficients(spectrum(spark), [760.0, 850.0])
    return optics.conc2od(conc(spark, d), millimetres(spark, d), DPF, coef)


@query(f"WITH {OPT} SELECT channel, chromo, {r('avg(value)', 'mean')} FROM conc GROUP BY channel, chromo")
def beer_lambert(spark, d):
    coef = optics.extinction_coefficients(spectrum(spark), [760.0, 850.0])
    return optics.beer_lambert(ts(spark, d), millimetres(spark, d), DPF, coef).groupBy("channel", "chromo").agg(F.avg("value").alias("mean"))


SNR = f"snr AS (SELECT {KEYS}, avg(value) / nullif(stddev_pop(value), 0) AS snr FROM ts GROUP BY ALL)"


@query(f"WITH {TS}, {SNR} SELECT {KEYS}, {r('snr')}, coalesce(snr > 1.0, false) AS mask FROM snr")
def snr(spark, d):
    return quality.snr(ts(spark, d), 1.0)


MEAN = f"ma AS (SELECT {KEYS}, avg(value) AS mean_amp, avg(value) > 10 AND avg(value) < 60 AS mask FROM ts GROUP BY ALL)"


@query(f"WITH {TS}, {MEAN} SELECT {KEYS}, {r('mean_amp')}, mask FROM ma")
def mean_amp(spark, d):
    return quality.mean_amp(ts(spark, d), 10, 60)


def two_masks(spark, d):
    a = ts(spark, d)
    return [quality.snr(a, 1.0).drop("snr"), quality.mean_amp(a, 10, 60).drop("mean_amp")]


BOTH = f"{TS}, {SNR}, {MEAN}, m AS (SELECT channel, bool_and(coalesce(snr > 1.0, false)) AS m1 FROM snr GROUP BY 1), n AS (SELECT channel, bool_and(mask) AS m2 FROM ma GROUP BY 1)"


@query(f"WITH {BOTH} SELECT {CELL}, {r('value')} FROM ts JOIN m USING (channel) JOIN n USING (channel) WHERE m1 AND m2")
def prune_all(spark, d):
    return masks.prune(ts(spark, d), two_masks(spark, d), "all")


@query(f"WITH {BOTH} SELECT {CELL}, {r('CASE WHEN m1 OR m2 THEN value END', 'value')} FROM ts JOIN m USING (channel) JOIN n USING (channel)")
def prune_any_nan(spark, d):
    return masks.prune(ts(spark, d), two_masks(spark, d), "any", drop=False)


@query(f"WITH {TS}, {MEAN} SELECT {CELL}, {r('CASE WHEN mask THEN value END', 'value')} FROM ts JOIN ma USING (channel, wavelength)")
def apply_mask_nan(spark, d):
    return masks.apply(ts(spark, d), two_masks(spark, d)[1], "nan")


@query(f"WITH {TS}, {MEAN} SELECT {CELL}, {r('value')} FROM ts JOIN ma USING (channel, wavelength) WHERE mask")
def apply_mask_drop(spark, d):
    return masks.apply(ts(spark, d), two_masks(spark, d)[1], "drop")


@query(f"WITH {TS}, {MEAN} SELECT channel FROM ma GROUP BY 1 HAVING NOT bool_and(mask)")
def masked_elements(spark, d):
    return masks.masked(two_masks(spark, d)[1], "channel")


@query(f"WITH {TS}, v AS (SELECT {KEYS}, var_pop(value) AS variance FROM ts GROUP BY ALL), b AS (SELECT *, variance = 0 OR channel IN ('C1', 'C7') AS bad FROM v) SELECT {KEYS}, {r('CASE WHEN bad THEN 100 * max(CASE WHEN NOT bad THEN variance END) OVER (PARTITION BY wavelength) ELSE variance END', 'variance')} FROM b")
def measurement_variance(spark, d):
    return quality.measurement_variance(ts(spark, d), ["C1", "C7"], 100.0)


FIRST = "short AS (SELECT * FROM ts WHERE sample < 12)"


@query(f"WITH {TS} SELECT x.wavelength, x.channel AS a, y.channel AS b, {r('covar_samp(x.value, y.value)', 'covariance')} FROM ts x JOIN ts y USING (wavelength, time) GROUP BY 1, 2, 3")
def measurement_covariance(spark, d):
    return quality.measurement_covariance(ts(spark, d))


GV = f"dd AS (SELECT time, coalesce(value - lag(value) OVER ({WO}), 0) AS d FROM od), g AS (SELECT time, sqrt(avg(d * d)) * 10 AS gvtd FROM dd GROUP BY 1)"


def gv(spark, d):
    return quality.gvtd(od(spark, d), FS)


@query(f"WITH {TS}, {OD}, {GV} SELECT time, {r('gvtd')} FROM g")
def gvtd_raw(spark, d):
    return gv(spark, d)


@query(f"""WITH {TS}, {OD}, {GV}, md AS (SELECT quantile_cont(gvtd, 0.5) AS c, avg(gvtd) AS m FROM g)
SELECT 'median' AS kind, round(c + 10 * coalesce((SELECT sqrt(avg((gvtd-c)*(gvtd-c))) FROM g WHERE gvtd < c), 0) + 1.3e-8, 6) AS threshold FROM md
UNION ALL SELECT 'mean', round(m + 10 * coalesce((SELECT sqrt(avg((gvtd-m)*(gvtd-m))) FROM g WHERE gvtd < m), 0) + 1.3e-8, 6) FROM md
UNION ALL SELECT 'MAD', round(10 * (SELECT quantile_cont(abs(gvtd - c), 0.5) FROM g) + 1.3e-8, 6) FROM md""")
def gvtd_thresholds(spark, d):
    out = None
    for kind in ("median", "mean", "MAD"):
        one = quality.gvtd_threshold(gv(spark, d), kind).select(F.lit(kind).alias("kind"), "threshold")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TS}, {OD}, {GV}, s AS (SELECT greatest(round(count(*) / 5.0), 1) AS n, max(gvtd) AS top, min(gvtd) AS low FROM g),
h AS (SELECT least(floor(gvtd / (top / n)), n - 1) AS bin, count(*) AS k FROM g, s GROUP BY 1), b AS (SELECT bin FROM h ORDER BY k DESC, bin LIMIT 1),
t AS (SELECT 2 * (bin * top / n + top / n / 2) - low AS threshold FROM b, s) SELECT time, {r('gvtd')}, gvtd < threshold AS mask FROM g, t""")
def gvtd_mask(spark, d):
    g = gv(spark, d)
    return quality.gvtd_mask(g, quality.gvtd_threshold(g))


MOTION = f"""j AS (SELECT {CELL}, greatest({', '.join(f'abs(coalesce(lead(value, {i}) OVER ({WO}) - value, 0))' for i in range(1, 6))}, 0) AS jump, lead(value) OVER ({WO}) - value AS d FROM od),
sd AS (SELECT *, stddev_pop(d) OVER ({W}) AS s FROM j), art AS (SELECT *, coalesce(jump > s * 2 OR jump > 3, jump > 3)::INT AS a FROM sd),
mo AS (SELECT {CELL}, max(a) OVER ({WO} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 0 AS mask FROM art)"""


def motion(spark, d):
    return quality.id_motion(od(spark, d), FS, stdev_thresh=2.0, amp_thresh=3.0)


@query(f"WITH {TS}, {OD}, {MOTION} SELECT {CELL}, mask FROM mo")
def id_motion(spark, d):
    return motion(spark, d)


@query(f"""WITH {TS}, {OD}, {MOTION}, c AS (SELECT channel, sample, time, bool_and(mask) AS mask FROM mo GROUP BY ALL),
b AS (SELECT *, (NOT mask AND coalesce(lag(mask) OVER (PARTITION BY channel ORDER BY sample), true))::BIGINT AS begun FROM c)
SELECT channel, {r('avg((NOT mask)::INT)', 'fraction')}, sum(begun)::BIGINT AS n_artifacts FROM b GROUP BY channel""")
def id_motion_refine(spark, d):
    return quality.id_motion_refine(motion(spark, d), "by_channel")[1]


@query(f"""WITH {TS}, {OD}, {MOTION}, n AS (SELECT *, coalesce((mask <> lag(mask) OVER ({WO}))::INT, 0) AS new FROM mo), k AS (SELECT *, sum(new) OVER ({WO}) AS run FROM n)
SELECT {KEYS}, min(sample) AS start, max(sample) + 1 AS stop, any_value(mask) AS mask FROM k GROUP BY {KEYS}, run""")
def segments(spark, d):
    return windows.segments(motion(spark, d))


RUNS = f"n AS (SELECT o.{CELL.replace(', ', ', o.')}, o.value, mask, coalesce((mask <> lag(mask) OVER (PARTITION BY o.channel, o.wavelength ORDER BY o.sample))::INT, 0) AS new FROM od o JOIN mo USING (channel, wavelength, sample)), k AS (SELECT *, sum(new) OVER ({WO}) AS run FROM n)"


@query(f"""WITH {TS}, {OD}, {MOTION}, {RUNS}, c AS (SELECT * FROM k WHERE mask), e AS (SELECT {KEYS}, abs(lead(value, 3) OVER (PARTITION BY {KEYS}, run ORDER BY sample) - value) AS d FROM c)
SELECT {KEYS}, {r('quantile_cont(d, 0.5)', 'threshold')} FROM e GROUP BY {KEYS}""")
def delta_threshold(spark, d):
    return windows.delta_threshold(od(spark, d), motion(spark, d), 3)


@query(f"""WITH {TS}, {OD}, {MOTION}, {RUNS}, sg AS (SELECT {KEYS}, run, abs(avg(value)) / (stddev_pop(value) + 1e-16) AS r FROM k WHERE mask GROUP BY ALL HAVING count(*) > 5),
p AS (SELECT {KEYS}, avg(r) AS s FROM sg GROUP BY ALL), w AS (SELECT {KEYS}, abs(avg(value)) / (stddev_pop(value) + 1e-16) AS w FROM od GROUP BY ALL HAVING count(*) > 1)
SELECT {KEYS}, {r('coalesce(s, w)', 'snr')} FROM w LEFT JOIN p USING (channel, wavelength)""")
def segment_snr(spark, d):
    x = od(spark, d)
    long = x.groupBy("channel", "wavelength").count().where("count > 1").select("channel", "wavelength")
    x = x.join(long, ["channel", "wavelength"], "left_semi")
    return windows.segment_snr(x, windows.segments(motion(spark, d)), FS, 0.5)


def iqr(expr: str, k: float) -> str:
    return f"x AS (SELECT {CELL}, {expr} AS x FROM ts), q AS (SELECT {KEYS}, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM x GROUP BY ALL) SELECT {CELL}, coalesce(x >= lo - {k} * (hi - lo) AND x <= hi + {k} * (hi - lo), true) AS mask FROM x JOIN q USING (channel, wavelength)"


@query(f"WITH {TS}, {iqr(f'stddev_pop(value) OVER ({WO} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 2)}")
def outliers_std(spark, d):
    return quality.outliers_std(ts(spark, d), 5, 2)


@query(f"WITH {TS}, {iqr(f'lag(value, 1, 0) OVER ({WO}) - lead(value, 1, 0) OVER ({WO})', 1.5)}")
def outliers_grad(spark, d):
    return quality.outliers_grad(ts(spark, d))


@query(f"""WITH {TS}, {OD}, {MOTION}, {STIM}, bad AS (SELECT DISTINCT channel, event_id AS event FROM mo, stim WHERE NOT mask AND time >= onset AND time < onset + duration)
SELECT event_id AS event, c.channel, b.channel IS NULL AS mask FROM stim CROSS JOIN (SELECT DISTINCT channel FROM mo) c LEFT JOIN bad b ON b.channel = c.channel AND b.event = event_id""")
def stimulus_mask(spark, d):
    return quality.stimulus_mask(stim(spark, d), motion(spark, d))


@query(f"""WITH {TS}, p AS (SELECT {CELL}, value, coalesce(lag(value) OVER ({WO}), value) AS a, coalesce(lead(value) OVER ({WO}), value) AS b FROM (SELECT {CELL}, CASE WHEN value <= 0 THEN 1e-18 ELSE value END AS value FROM ts))
SELECT {CELL}, {r('greatest(least(a, value), least(greatest(a, value), b))', 'value')} FROM p""")
def repair_amp(spark, d):
    return quality.repair_amp(ts(spark, d), 3)


@query(f"WITH {TS} SELECT {KEYS}, {r('(count(*) - 1) / nullif(max(time) - min(time), 0)', 'fs')} FROM ts GROUP BY ALL")
def sampling_rate(spark, d):
    return quality.sampling_rate(ts(spark, d))


@query(f"WITH {TS} SELECT {CELL}, {r('value')} FROM (SELECT {CELL}, value - lag(value) OVER ({WO}) AS value FROM ts) WHERE value IS NOT NULL")
def time_diff(spark, d):
    return windows.diff(ts(spark, d))


@query(f"WITH {TS} SELECT {CELL}, s AS shift, {r('CASE s WHEN 0 THEN value WHEN 2 THEN lag(value, 2, 0) OVER w ELSE lag(value, 5, 0) OVER w END', 'value')} FROM ts CROSS JOIN (VALUES (0), (2), (5)) AS t(s) WINDOW w AS (PARTITION BY channel, wavelength, s ORDER BY sample)")
def temporal_embedding(spark, d):
    return windows.temporal_embedding(ts(spark, d), [0, 2, 5])


@query(f"WITH {TS} SELECT {CELL}, {r(f'0.25 * lead(value, 1, 0) OVER ({WO}) + 0.5 * value + 0.25 * lag(value, 1, 0) OVER ({WO})', 'value')} FROM ts")
def convolve(spark, d):
    return windows.convolve(ts(spark, d), [0.25, 0.5, 0.25])


@query(f"WITH {TS} SELECT {CELL}, {r(f'(value - avg(value) OVER ({W})) / CASE WHEN stddev_pop(value) OVER ({W}) = 0 THEN 1 ELSE stddev_pop(value) OVER ({W}) END', 'value')} FROM ts")
def standardize(spark, d):
    return windows.standardize(ts(spark, d))


@query(f"WITH {TS}, c AS (SELECT {CELL}, value - avg(value) OVER ({W}) AS value FROM ts) SELECT {CELL}, {r(f'value - 0.5 * lag(value, 1, 0) OVER ({WO}) - 0.2 * lag(value, 2, 0) OVER ({WO})', 'value')} FROM c")
def ar_filter_fixed(spark, d):
    return windows.ar_filter(ts(spark, d), [0.5, 0.2])


@query(f"WITH {TS}, p AS (SELECT {KEYS}, 1 / (1 + count(*) * var_pop(value)) AS p FROM ts GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY p, channel, wavelength) AS i, count(*) OVER () AS n FROM p) SELECT {KEYS}, {r('p')}, {r('least(1, min(p * n / i) OVER (ORDER BY p, channel, wavelength ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'q')} FROM k")
def benjamini_hochberg(spark, d):
    p = ts(spark, d).groupBy("channel", "wavelength").agg((1 / (1 + F.count("*") * F.var_pop("value"))).alias("p"))
    return stats.benjamini_hochberg(p)


@query(f"WITH {TS}, m AS (SELECT {KEYS}, quantile_cont(value, 0.5) AS m FROM ts GROUP BY ALL) SELECT {KEYS}, {r('quantile_cont(abs(value - m), 0.5)', 'mad')} FROM ts JOIN m USING (channel, wavelength) GROUP BY {KEYS}")
def mad(spark, d):
    return stats.mad(ts(spark, d))


@query(f"WITH {TS} SELECT {KEYS}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.75)', 'q75')} FROM ts GROUP BY {KEYS}")
def quantiles(spark, d):
    return stats.quantiles(ts(spark, d))


@query(f"WITH {TS} SELECT channel, sample, time, {r('sqrt(sum(value * value))', 'value')} FROM ts GROUP BY channel, sample, time")
def norm(spark, d):
    return stats.norm(ts(spark, d), "wavelength")


@query(f"WITH {TS}, g AS (SELECT wavelength, time, avg(value) AS g FROM ts GROUP BY ALL), b AS (SELECT {CELL}, value, g, sum(value * g) OVER ({W}) / sum(g * g) OVER ({W}) AS beta FROM ts JOIN g USING (wavelength, time)) SELECT {CELL}, {r('value - beta * g', 'value')} FROM b")
def global_component_k0(spark, d):
    return stats.global_component(ts(spark, d))


@query(f"WITH {TS}, s AS (SELECT {KEYS}, min(time) AS a, max(time) AS b FROM ts GROUP BY ALL) SELECT {KEYS}, coalesce(least(floor((time - a) / nullif(b - a, 0) * 4), 3), 0)::BIGINT AS bin, {r('avg(value)', 'mean')}, {r('var_pop(value)', 'variance')} FROM ts JOIN s USING (channel, wavelength) GROUP BY ALL")
def binned_statistics(spark, d):
    return stats.binned(ts(spark, d), 4)


EPOCHS = f"""e0 AS (SELECT {CELL}, value, row_number() OVER ({WO}) - 1 AS i, count(*) OVER ({W}) AS n, lag(time) OVER ({WO}) AS tp, lead(time) OVER ({WO}) AS tn, lead(value) OVER ({WO}) AS vn FROM ts),
e1 AS (SELECT *, coalesce((tp + time) / 2, time - (tn - time) / 2) AS lo, coalesce((tn + time) / 2, time + (time - tp) / 2) AS hi FROM e0),
mid AS (SELECT DISTINCT {KEYS}, event_id AS epoch, onset, trial_type FROM e1 JOIN stim ON onset >= lo AND onset < hi WHERE i - 3 >= 0 AND i + 10 < n),
grid AS (SELECT {KEYS}, epoch, trial_type, k::INT AS rel_idx, round(k * 0.1::DOUBLE, 3) AS reltime, onset + round(k * 0.1::DOUBLE, 3) AS q FROM mid, (SELECT unnest(range(-3, 11)) AS k)),
hit AS (SELECT g.*, e.time AS t, e.value AS v, e.tn, e.vn FROM grid g JOIN e1 e ON e.channel = g.channel AND e.wavelength = g.wavelength AND (q >= e.time OR e.i = 0) AND (q < e.tn OR e.i = e.n - 2) AND e.tn IS NOT NULL),
epochs AS (SELECT {KEYS}, epoch, trial_type, rel_idx, reltime, v + (q - t) * (vn - v) / (tn - t) AS value FROM hit)"""
EP = f"{TS}, {STIM}, {EPOCHS}"


def epoch_table(spark, d):
    return ep.to_epochs(ts(spark, d), stim(spark, d), 0.3, 1.0, FS)


@query(f"WITH {EP} SELECT {KEYS}, epoch, trial_type, rel_idx, reltime, {r('value')} FROM epochs")
def epochs_interp(spark, d):
    return epoch_table(spark, d)


BASED = f"based AS (SELECT * REPLACE (value - avg(value) FILTER (WHERE reltime < 0) OVER (PARTITION BY {KEYS}, epoch, trial_type) AS value) FROM epochs)"


@query(f"WITH {EP}, {BASED} SELECT {KEYS}, epoch, trial_type, rel_idx, reltime, {r('value')} FROM based")
def epoch_baseline(spark, d):
    return ep.baseline_correct(epoch_table(spark, d))


@query(f"WITH {EP}, {BASED} SELECT {KEYS}, trial_type, reltime, {r('avg(value)', 'value')}, count(value) AS n FROM based GROUP BY {KEYS}, trial_type, reltime")
def block_average(spark, d):
    return ep.block_average(ep.baseline_correct(epoch_table(spark, d)))


@query(f"WITH {EP} SELECT {KEYS}, epoch, trial_type, {r('avg(value) FILTER (WHERE reltime BETWEEN 0 AND 0.8)', 'mean')}, {r('min(value) FILTER (WHERE reltime BETWEEN 0 AND 1)', 'min')}, {r('max(value) FILTER (WHERE reltime BETWEEN 0 AND 1)', 'max')} FROM epochs GROUP BY {KEYS}, epoch, trial_type")
def epoch_features(spark, d):
    return ep.features(epoch_table(spark, d), 0.8, 1.0)


@query(f"WITH {STIM} SELECT trial_type, count(*) AS n FROM (SELECT CASE trial_type WHEN 'T0' THEN 'rest' ELSE trial_type END AS trial_type FROM stim) GROUP BY 1")
def rename_events(spark, d):
    return ep.rename_events(stim(spark, d), {"T0": "rest"}).groupBy("trial_type").agg(F.count("*").alias("n"))


@query(f"WITH {TS} SELECT {CELL}, {r('value')} FROM ts")
def pack_unpack(spark, d):
    return build_timeseries(pack(ts(spark, d)))


TIMES = "times AS (SELECT DISTINCT sample, time FROM ts)"


def times(spark, d):
    return ts(spark, d).select("sample", "time").distinct()


@query(f"WITH {TS}, {TIMES}, n AS (SELECT count(*) AS n FROM times) SELECT sample, 'Drift ' || k AS regressor, {r('pow((sample + 1)::DOUBLE / n, k)', 'value')} FROM times, n, (SELECT unnest(range(0, 4)) AS k)")
def drift_regressors(spark, d):
    return glm.drift_regressors(times(spark, d).select("sample"), 3)


ON = f"""b AS (SELECT event_id, trial_type, onset, duration, value AS v, min(sample) AS s0 FROM stim JOIN (SELECT sample, time FROM times) t ON time >= onset GROUP BY ALL),
h AS (SELECT sample, trial_type, arg_max(v, event_id) AS value FROM times JOIN b ON sample = s0 OR (sample > s0 AND time < onset + duration) GROUP BY ALL),
onset_array AS (SELECT sample, trial_type, coalesce(h.value, 0) AS value FROM times CROSS JOIN (SELECT DISTINCT trial_type FROM stim) LEFT JOIN h USING (sample, trial_type))"""


@query(f"WITH {TS}, {TIMES}, {STIM}, {ON} SELECT sample, trial_type, {r('value')} FROM onset_array")
def stim_array(spark, d):
    return glm.stim_array(times(spark, d), stim(spark, d))


@query(f"WITH {TS}, x AS (SELECT {KEYS}, value, (sample + 1)::DOUBLE / count(*) OVER ({W}) AS x FROM ts) SELECT {KEYS}, {r('regr_intercept(value, x)', 'intercept')}, {r('regr_slope(value, x)', 'slope')} FROM x GROUP BY {KEYS}")
def glm_ols_drift(spark, d):
    return glm.fit_line(ts(spark, d))


@query(f"WITH {TS}, x AS (SELECT {CELL}, value, (sample + 1)::DOUBLE / count(*) OVER ({W}) AS x FROM ts), f AS (SELECT {KEYS}, regr_intercept(value, x) AS a, regr_slope(value, x) AS b FROM x GROUP BY ALL) SELECT {KEYS}, sample, {r('a + b * x', 'value')} FROM x JOIN f USING (channel, wavelength) WHERE b IS NOT NULL")
def glm_predict(spark, d):
    x = ts(spark, d)
    line = glm.fit_line(x).where("slope IS NOT NULL").select("channel", "wavelength", F.expr("stack(2, 'one', intercept, 'x', slope) AS (regressor, param)"))
    n = x.groupBy("channel", "wavelength").agg(F.count("*").alias("n"))
    design = x.join(n, ["channel", "wavelength"]).select("channel", "wavelength", "sample", F.expr("stack(2, 'one', 1.0D, 'x', (sample + 1) / n) AS (regressor, value)"))
    return glm.predict(design, line)


@query(f"WITH {TS} SELECT wavelength, sample, {r('avg(value)', 'value')}, 'short' AS regressor FROM ts GROUP BY wavelength, sample")
def average_short_channels(spark, d):
    return glm.average_short_channels(ts(spark, d))


@query(f"WITH {TS}, c AS (SELECT a.channel, b.channel AS short_channel, wavelength, corr(a.value, b.value) AS c FROM ts a JOIN ts b USING (wavelength, sample) WHERE b.channel IN ('C3', 'C5', 'C8') GROUP BY ALL), m AS (SELECT channel, short_channel, max(c) AS c FROM c GROUP BY ALL) SELECT channel, arg_max(short_channel, c) AS short_channel, {r('max(c)', 'corr')} FROM m GROUP BY channel")
def max_corr_short(spark, d):
    x = ts(spark, d)
    return glm.max_corr_short_channel(x, x.where(F.col("channel").isin("C3", "C5", "C8")))


@query(f"WITH {TS} SELECT {CELL}, {r('value + 2 * exp(-0.5 * pow((time - 1.5) / 0.3, 2))', 'value')} FROM ts")
def add_spike(spark, d):
    return simulation.add_artifact_direct(ts(spark, d), 1.5, 0.3, "spike", 2.0)


@query(f"WITH {TS} SELECT {CELL}, {r('value + CASE WHEN time >= 1.5 THEN 3 ELSE 0 END', 'value')} FROM ts")
def add_bl_shift(spark, d):
    return simulation.add_artifact_direct(ts(spark, d), 1.5, 0.0, "bl_shift", 3.0)


@query(f"""WITH {TS}, w AS (SELECT range AS k FROM range(0, (SELECT max(sample) // 4 + 2 FROM ts))),
g AS (SELECT {KEYS}, k, max(value) - min(value) AS g FROM ts JOIN w ON sample BETWEEN k * 4 - 4 AND k * 4 + 3 GROUP BY {KEYS}, k HAVING count(*) = 8) SELECT {KEYS}, {r('quantile_cont(g, 0.5)', 'scale')} FROM g GROUP BY {KEYS}""")
def artifact_scale(spark, d):
    return simulation.artifact_scale(ts(spark, d), 8)


@query()
def freq_filter(spark, d):
    return kernels.freq_filter(ts(spark, d), FS, 0.1, 2.0)


@query()
def detect_outliers(spark, d):
    return kernels.detect_outliers(ts(spark, d), FS, 1.0)


@query()
def sci(spark, d):
    return kernels.sci(kernels.cardiac(ts(spark, d), FS), FS, 0.8, 0.5)


@query()
def psp(spark, d):
    return kernels.psp(kernels.cardiac(ts(spark, d), FS), FS, 0.8, 0.03)


@query()
def tddr(spark, d):
    return kernels.tddr(ts(spark, d), FS)


@query()
def motion_correct_wavelet(spark, d):
    return kernels.motion_correct_wavelet(ts(spark, d))


@query()
def motion_correct_spline_sg(spark, d):
    x = ts(spark, d)
    return kernels.motion_correct_spline_sg(x, quality.outliers_grad(x), FS, 0.01, 0.9)


@query()
def ampd(spark, d):
    return kernels.ampd(ts(spark, d))


@query()
def resample(spark, d):
    return kernels.resample(ts(spark, d), 4.0)


@query()
def fit_ar_coefs(spark, d):
    return kernels.fit_ar_coefs(ts(spark, d), 4)


@query()
def split_frequency_bands(spark, d):
    return kernels.split_frequency_bands(ts(spark, d), FS)


def design(spark, d):
    from ..functions.basis import Gamma

    t = times(spark, d)
    return glm.join_designs(glm.drift_regressors(t.select("sample"), 1), glm.hrf_regressors(t, stim(spark, d), Gamma(0.0, 1.0), FS))


@query()
def hrf_regressors(spark, d):
    return design(spark, d)


@query()
def glm_ols(spark, d):
    return glm.coefficients(glm.fit(ts(spark, d), design(spark, d)))


@query()
def glm_ar_irls(spark, d):
    return glm.coefficients(glm.fit(ts(spark, d), design(spark, d), "ar_irls", 4))


@query()
def glm_glsar(spark, d):
    return glm.coefficients(glm.fit(ts(spark, d), design(spark, d), "glsar", 3))


@query()
def glm_gls(spark, d):
    return glm.coefficients(glm.fit(ts(spark, d), design(spark, d), "gls"))


def line(spark, d):
    """A constant, the sample over 64, and its square."""
    x = F.col("sample") / 64
    rows = times(spark, d).select("sample", F.explode(F.array(*[F.struct(F.lit(n).alias("regressor"), v.cast("double").alias("value")) for n, v in (("a", F.lit(1.0)), ("b", x), ("c", x * x))])).alias("r"))
    return rows.select("sample", "r.*")


NORMAL = f"""m AS (SELECT {KEYS}, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM (SELECT {KEYS}, sample / 64.0::DOUBLE AS x, value AS y FROM ts) GROUP BY {KEYS} HAVING count(*) > 6),
inv AS (SELECT *, s2*s4-s3*s3 AS c00, s2*s3-s1*s4 AS c01, s1*s3-s2*s2 AS c02, n*s4-s2*s2 AS c11, s1*s2-n*s3 AS c12, n*s2-s1*s1 AS c22, n*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS det FROM m),
b AS (SELECT *, (c00*t0+c01*t1+c02*t2)/det AS b0, (c01*t0+c11*t1+c12*t2)/det AS b1, (c02*t0+c12*t1+c22*t2)/det AS b2 FROM inv),
e AS (SELECT {KEYS}, sum(pow(value - b0 - b1 * sample / 64.0 - b2 * sample * sample / 4096.0, 2)) AS ssr FROM ts JOIN b USING (channel, wavelength) GROUP BY {KEYS}),
se AS (SELECT b.*, ssr / (n - 3) AS v FROM b JOIN e USING (channel, wavelength))"""
LINE_SQL = f"""WITH {TS}, {NORMAL} SELECT {KEYS}, u.regressor AS regressor, round(u.param + 1.3e-8, 5) + 0.0 AS param, round(u.bse + 1.3e-8, 5) + 0.0 AS bse
FROM (SELECT {KEYS}, unnest([{{'regressor': 'a', 'param': b0, 'bse': sqrt(v*c00/det)}}, {{'regressor': 'b', 'param': b1, 'bse': sqrt(v*c11/det)}}, {{'regressor': 'c', 'param': b2, 'bse': sqrt(v*c22/det)}}]) AS u FROM se)"""


def fitted_line(spark, d, noise):
    """Coefficients and their errors of traces of more than six samples."""
    x = ts(spark, d)
    long = x.groupBy("channel", "wavelength").count().where("count > 6").drop("count")
    c = glm.coefficients(glm.fit(x.join(long, ["channel", "wavelength"]), line(spark, d), noise))
    five = lambda k: (F.round(F.col(k) + 1.3e-8, 5) + F.lit(0.0)).alias(k)
    return c.select("channel", "wavelength", "regressor", five("param"), five("bse"))


@query(LINE_SQL)
def glm_ols_line(spark, d):
    return fitted_line(spark, d, "ols")


@query(LINE_SQL)
def glm_rls_line(spark, d):
    """Sample by sample; the last estimate and its error are those of the normal equations."""
    return fitted_line(spark, d, "rls")


@query(f"""WITH {TS}, m AS (SELECT {KEYS}, sample, count(*) OVER w AS n, avg(sample + 1) OVER w AS mx, regr_slope(value, sample + 1) OVER w AS slope, avg(value) OVER w AS my FROM ts WINDOW w AS ({WO}))
SELECT {KEYS}, sample, u.regressor AS regressor, round(u.param + 1.3e-8, 5) + 0.0 AS param FROM (SELECT {KEYS}, sample, unnest([{{'regressor': 'one', 'param': my - slope * mx}}, {{'regressor': 'x', 'param': slope}}]) AS u FROM m WHERE n > 1)""")
def glm_recursive_path(spark, d):
    """Constant and slope after each sample of every trace."""
    rows = F.explode(F.array(F.struct(F.lit("one").alias("regressor"), F.lit(1.0).alias("value")), F.struct(F.lit("x").alias("regressor"), (F.col("sample") + 1).cast("double").alias("value"))))
    path = glm.recursive_coefficients(ts(spark, d), times(spark, d).select("sample", rows.alias("r")).select("sample", "r.*"))
    return path.select("channel", "wavelength", "sample", "regressor", (F.round(F.col("param") + 1.3e-8, 5) + F.lit(0.0)).alias("param"))
