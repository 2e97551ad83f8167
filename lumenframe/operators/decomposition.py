"""Principal components, canonical correlation and source power decompositions.

Spark computes the Gram matrices (channels squared); numpy decomposes those small matrices on the
driver and Spark projects the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import multimodal_checks as checks
from .windows import standardize

#: Channels up to which a Gram matrix may come to the driver.
MAX_CHANNELS = 4096
#: Samples whose vectors a task multiplies at once.
TOGETHER = 512


def _labels(ts: DataFrame) -> list[str]:
    out = [r[0] for r in ts.select("channel").distinct().orderBy("channel").limit(MAX_CHANNELS + 1).collect()]
    if len(out) > MAX_CHANNELS:
        raise ValueError(f"more than {MAX_CHANNELS} channels")
    return out


def _vectors(ts: DataFrame, name: str) -> DataFrame:
    return ts.groupBy("sample").agg(F.collect_list(F.struct("channel", "value")).alias("c")).select("sample", F.col("c.channel").alias(f"{name}_at"), F.col("c.value").alias(name))


def _outer(rows: list, cols: list):
    """Sums over a task's samples of the products of two vectors given by cells; pairs that never meet are left out."""

    def matrix(cells: pa.ListArray, at: pa.ListArray, labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.asarray(at.offsets).astype(np.int64)
        i = np.repeat(np.arange(len(at)), np.diff(ends))
        k = pc.index_in(at.values.slice(ends[0], ends[-1] - ends[0]), value_set=labels).to_numpy(zero_copy_only=False)
        v = cells.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
        x, n = np.zeros((len(at), len(labels))), np.zeros((len(at), len(labels)))
        some = ~np.isnan(v)
        np.add.at(x, (i[some], k[some]), v[some])
        np.add.at(n, (i[some], k[some]), 1)
        return x, n

    def run(batches):
        left, right, g, n = pa.array(rows), pa.array(cols), np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
        # some samples at a time, so that a task's matrices do not grow with its batches
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            x, nx = matrix(batch.column("x"), batch.column("x_at"), left)
            y, ny = matrix(batch.column("y"), batch.column("y_at"), right)
            g += x.T @ y
            n += nx.T @ ny
        a, b = np.nonzero(n)
        if len(a):
            yield pa.RecordBatch.from_arrays([left.take(pa.array(a)), right.take(pa.array(b)), pa.array(g[a, b])], names=["a", "b", "g"])

    return run


def cross_gram(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b, g): sum over samples of x[a] * y[b]; (channel, sample, value) tables.

    Each sample's channels travel as one vector and a task adds up outer products (checked size), so a
    row is shuffled once, not once per channel. Null and NaN values are left out; repeated cells add up.
    """
    rows, cols = _labels(x), _labels(y)
    kinds = dict(x.dtypes)["channel"], dict(y.dtypes)["channel"]
    value = lambda df: df.select("sample", "channel", F.col("value").cast("double").alias("value")).where(F.col("channel").isNotNull())
    both = _vectors(value(x), "x").join(_vectors(value(y), "y"), "sample").drop("sample")
    sums = both.mapInArrow(_outer(rows, cols), f"a {kinds[0]}, b {kinds[1]}, g double")
    return sums.groupBy("a", "b").agg(F.sum("g").alias("g"))


def dense(g: DataFrame, rows: list[str], cols: list[str]) -> np.ndarray:
    out, r, c = np.zeros((len(rows), len(cols))), {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(cols)}
    for x in g.collect():
        out[r[x["a"]], c[x["b"]]] = x["g"]
    return out


def oriented(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def weights_table(spark, labels: list[str], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(c, k, float(w[i, k])) for i, c in enumerate(labels) for k in range(w.shape[1])], "channel string, component int, weight double")


def project(ts: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample, component, value)."""
    return ts.join(weights, "channel").groupBy("sample", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def pca(ts: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(weights, share of variance) of the k leading components of centred channels."""
    labels = _labels(ts)
    centred = ts.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("channel")))
    lam, v = np.linalg.eigh(dense(cross_gram(centred, centred), labels, labels))
    lam, v = lam[::-1], v[:, ::-1]
    return weights_table(ts.sparkSession, labels, oriented(v[:, :k])), lam[:k] / max(lam.sum(), 1e-300)


def remove_components(ts: DataFrame, k: float) -> DataFrame:
    """ts less its leading components: k of them, or as few as reach the share k of variance."""
    labels = _labels(ts)
    full, share = pca(ts, len(labels))
    n = int(k) if k >= 1 else min(int(np.searchsorted(np.cumsum(share), k)) + 1, len(labels) - 1)
    w = full.where(F.col("component") < n)
    mean = ts.groupBy("channel").agg(F.avg("value").alias("_m"))
    centred = ts.join(mean, "channel").withColumn("value", F.col("value") - F.col("_m"))
    parts = project(centred.drop("_m"), w).join(w, "component").groupBy("channel", "sample").agg(F.sum(F.col("value") * F.col("weight")).alias("_p"))
    return ts.join(parts, ["channel", "sample"]).withColumn("value", F.col("value") - F.col("_p")).select(*ts.columns)


def _power(s: np.ndarray) -> np.ndarray:
    lam, u = np.linalg.eigh(s)
    return u @ np.diag(np.maximum(lam, 1e-10) ** -0.5) @ u.T


def _soft(v: np.ndarray, penalty: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - penalty / 2, 0)


def cca(x: DataFrame, y: DataFrame, k: int = 1, l1: float | tuple[float, float] = (0, 0), l2: float | tuple[float, float] = (0, 0), pls: bool = False, rounds: int = 1000, tol: float = 1e-6, laplacians: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(weights of x, weights of y, singular values) of standardised series on common samples.

    l1 makes it sparse, l2 ridge (elastic net with both), laplacians replace the identity of the
    ridge, pls leaves out the whitening. A single l1 or l2 serves both sides.
    """
    checks.columns(x, y)
    l1, l2 = checks.penalties(l1, "l1"), checks.penalties(l2, "l2")
    x, y = standardize(x.select("channel", "sample", "value")), standardize(y.select("channel", "sample", "value"))
    lx, ly = _labels(x), _labels(y)
    if k > min(len(lx), len(ly)):
        raise ValueError(f"{k} components are more than {min(len(lx), len(ly))} features")
    n = max(x.select("sample").distinct().count() - 1, 1)
    cxy, cxx, cyy = dense(cross_gram(x, y), lx, ly) / n, dense(cross_gram(x, x), lx, lx) / n, dense(cross_gram(y, y), ly, ly) / n
    ix, iy = laplacians or (np.eye(len(lx)), np.eye(len(ly)))
    ax, ay = (np.eye(len(lx)), np.eye(len(ly))) if pls else (_power(cxx + l2[0] * ix), _power(cyy + l2[1] * iy))
    m, us, vs, ss = ax @ cxy @ ay, [], [], []
    for _ in range(k):
        u, s, vt = np.linalg.svd(m)
        u, v, sigma = u[:, 0], vt[0], s[0]
        if any(l1):
            for _ in range(rounds):
                old = u
                u = _soft(m @ v, l1[0])
                u /= np.linalg.norm(u) or 1
                v = _soft(m.T @ u, l1[1])
                v /= np.linalg.norm(v) or 1
                if np.abs(u - old).max() < tol:
                    break
            sigma = u @ m @ v
        m = m - sigma * np.outer(u, v)
        sign = -1 if u[np.abs(u).argmax()] < 0 else 1
        us.append(sign * u)
        vs.append(sign * v)
        ss.append(sigma)
    spark = x.sparkSession
    return weights_table(spark, lx, ax @ np.array(us).T), weights_table(spark, ly, ay @ np.array(vs).T), np.array(ss)


def spoc(x: DataFrame, z: DataFrame, bins: int) -> tuple[DataFrame, np.ndarray]:
    """Filters whose band power follows z (bin, value): generalised eigenvectors of weighted bin covariances."""
    labels = _labels(x)
    span = x.agg(F.min("sample").alias("a"), F.max("sample").alias("b"))
    binned = x.join(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("sample") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int"))
    zs = z.select("bin", ((F.col("value") - F.avg("value").over(Window.partitionBy())) / F.stddev_pop("value").over(Window.partitionBy())).alias("z"))
    a = binned.select("bin", "sample", F.col("channel").alias("a"), F.col("value").alias("va"))
    b = binned.select("sample", F.col("channel").alias("b"), F.col("value").alias("vb"))
    cov = a.join(b, "sample").groupBy("bin", "a", "b").agg(F.covar_samp("va", "vb").alias("c")).join(F.broadcast(zs), "bin")
    g = cov.groupBy("a", "b").agg(F.avg("c").alias("g"), F.avg(F.col("c") * F.col("z")).alias("h")).persist()
    c, cz = dense(g.select("a", "b", "g"), labels, labels), dense(g.select("a", "b", F.col("h").alias("g")), labels, labels)
    g.unpersist()
    half = _power(c)
    lam, u = np.linalg.eigh(half @ cz @ half)
    return weights_table(x.sparkSession, labels, oriented((half @ u)[:, ::-1])), lam[::-1]


def temporally_embedded_cca(x: DataFrame, y: DataFrame, shifts: list[int], **how):
    """CCA of time-lagged copies of x with y; a lagged copy's channel is <channel>@<shift>."""
    from .windows import temporal_embedding

    n = (x.agg(F.max("sample")).first()[0] or 0) + 1
    e = temporal_embedding(x.select("channel", "sample", "value"), checks.time_shifts(n, shifts))
    return cca(e.select(F.concat_ws("@", "channel", F.col("shift").cast("string")).alias("channel"), "sample", "value"), y, **how)


def optimal_shift(embedded: DataFrame, y: DataFrame) -> DataFrame:
    """(component, shift, corr): the lag of largest |correlation| with y. embedded: component, shift, sample, value."""
    c = embedded.join(y.select("component", "sample", F.col("value").alias("_y")), ["component", "sample"]).groupBy("component", "shift").agg(F.corr("value", "_y").alias("corr"))
    return c.groupBy("component").agg(F.max_by(F.struct("shift", "corr"), F.struct(F.abs("corr").alias("a"), (-F.col("shift")).alias("s"))).alias("m")).select("component", "m.shift", "m.corr")


def shift_by_optimal(x: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each component advanced by its shift, zero at the tail."""
    moved = x.join(F.broadcast(shifts.select("component", "shift")), "component")
    later = moved.select("component", (F.col("sample") - F.col("shift")).alias("sample"), F.col("value").alias("_v"))
    return x.join(later, ["component", "sample"], "left").select("component", "sample", F.coalesce("_v", F.lit(0.0)).alias("value"))


def bandpower(x: DataFrame, weights: DataFrame, bins: int) -> DataFrame:
    """(component, bin, value): variance of each standardised projection in equal bins of samples."""
    p = project(x, weights)
    w = Window.partitionBy("component")
    sd = F.stddev_pop("value").over(w)
    z = p.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))
    at = F.least(F.floor((F.col("sample") - F.min("sample").over(w)) / (F.max("sample").over(w) - F.min("sample").over(w)) * bins), F.lit(bins - 1)).cast("int")
    return z.withColumn("bin", at).groupBy("component", "bin").agg(F.var_pop("value").alias("value"))


def complement(w: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what is orthogonal to the columns of w."""
    return np.linalg.svd(w, full_matrices=True)[0][:, np.linalg.matrix_rank(w) :]


def _follow(cov: np.ndarray, ys: np.ndarray, shifts: tuple[int, ...], restarts: int, rounds: int, tol: float, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(filter of x, filter of y, weights of the lags, correlation): one component, the best of some starts."""
    half, bins, best = _power(cov.mean(0)), len(cov), None
    for _ in range(restarts):
        w, last = rng.normal(size=cov.shape[1]), -np.inf
        for _ in range(rounds):
            power = np.einsum("i,tij,j->t", w, cov, w)
            lagged = np.column_stack([np.r_[np.zeros(s), power[: bins - s]] for s in shifts])
            lagged = (lagged - lagged.mean(0)) / np.where(lagged.std(0) == 0, 1, lagged.std(0))
            u, s, vt = np.linalg.svd(_power(lagged.T @ lagged / bins) @ (lagged.T @ ys / bins) @ _power(ys.T @ ys / bins))
            wt, wy = _power(lagged.T @ lagged / bins) @ u[:, 0], _power(ys.T @ ys / bins) @ vt[0]
            target = ys @ wy
            weighted = sum(k * np.tensordot(np.r_[target[g:], np.zeros(g)], cov, 1) for k, g in zip(wt, shifts, strict=True)) / bins
            lam, e = np.linalg.eigh(half @ weighted @ half)
            w = half @ e[:, np.abs(lam).argmax()]
            if abs(s[0] - last) < tol:
                break
            last = s[0]
        if best is None or last > best[3]:
            best = (w, wy, wt, float(last))
    return best


def mspoc_components(x: DataFrame, y: DataFrame, bins: int, k: int, shifts: tuple[int, ...] = (0,), restarts: int = 2, rounds: int = 200, tol: float = 1e-5, seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """(weights of x, weights of y, weights of the lags by component, correlations) of k components.

    The power of a projection of x in each bin, at several lags, is to follow a projection of y
    (one sample per bin). Spark computes the covariances by bin; the alternation of a one-component
    correlation analysis and an eigenvector is on the driver. Each further component is sought where
    the filters are orthogonal to those before.
    """
    checks.columns(x, y)
    shifts = tuple(checks.time_shifts(bins, shifts))
    lx, ly = _labels(x), _labels(y)
    if not 1 <= k <= min(len(lx), len(ly)):
        raise ValueError(f"{k} components do not fit {len(lx)} and {len(ly)} features")
    span = x.agg(F.min("sample").alias("a"), F.max("sample").alias("b"))
    binned = x.join(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("sample") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int"))
    a = binned.select("bin", "sample", F.col("channel").alias("a"), F.col("value").alias("va"))
    b = binned.select("sample", F.col("channel").alias("b"), F.col("value").alias("vb"))
    cov = np.zeros((bins, len(lx), len(lx)))
    at = {c: i for i, c in enumerate(lx)}
    for r in a.join(b, "sample").groupBy("bin", "a", "b").agg(F.covar_samp("va", "vb").alias("c")).collect():
        cov[r["bin"], at[r["a"]], at[r["b"]]] = r["c"] or 0.0
    ys = np.zeros((bins, len(ly)))
    for r in y.where(F.col("sample") < bins).collect():
        ys[r["sample"], ly.index(r["channel"])] = r["value"]
    ys = (ys - ys.mean(0)) / np.where(ys.std(0) == 0, 1, ys.std(0))
    rng, bx, by = np.random.default_rng(seed), np.eye(len(lx)), np.eye(len(ly))
    wx, wy, wt, corr = [], [], [], []
    for _ in range(k):
        u, v, lags, c = _follow(np.einsum("ia,tij,jb->tab", bx, cov, bx, optimize=True), ys @ by, shifts, restarts, rounds, tol, rng)
        wx.append(bx @ u)
        wy.append(by @ v)
        wt.append(lags)
        corr.append(c)
        bx, by = complement(np.array(wx).T), complement(np.array(wy).T)
    spark = x.sparkSession
    return weights_table(spark, lx, oriented(np.array(wx).T)), weights_table(spark, ly, np.array(wy).T), np.array(wt), np.array(corr)


def mspoc(x: DataFrame, y: DataFrame, bins: int, shifts: tuple[int, ...] = (0,), **how) -> tuple[DataFrame, DataFrame, np.ndarray, float]:
    """(weights of x, weights of y, weights of the lags, correlation) of the leading component."""
    wx, wy, wt, corr = mspoc_components(x, y, bins, 1, shifts, **how)
    return wx, wy, wt[0], float(corr[0])
