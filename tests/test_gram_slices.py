import numpy as np
import pyarrow as pa

from lumenframe.operators import decomposition


def test_products_of_a_batch_are_formed_some_samples_at_a_time(monkeypatch):
    rng, made = np.random.default_rng(1), []
    labels, n = ["a", "b", "c"], 2000
    v = rng.normal(size=(n, 3))
    v[5, 1] = np.nan
    at, x = pa.array([labels] * n), pa.array(v.tolist())
    batch = pa.RecordBatch.from_arrays([at, x, at, x], names=["x_at", "x", "y_at", "y"])
    zeros = np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: made.append(np.prod(shape)) or zeros(shape, *a, **k))
    got = {(r["a"], r["b"]): r["g"] for out in decomposition._outer(labels, labels)([batch.slice(0, 700), batch.slice(700)]) for r in out.to_pylist()}
    assert max(made) <= 3 * decomposition.TOGETHER
    want = np.nan_to_num(v).T @ np.nan_to_num(v)
    assert all(abs(got[p, q] - want[i, j]) < 1e-9 for i, p in enumerate(labels) for j, q in enumerate(labels))
