"""Reduction, neighbours and clusters against NumPy."""

import numpy as np

from tremolo.operators import embedding


def _vectors(spark, x):
    odd = [(-1, None), (-2, [float("nan")] * x.shape[1])]
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + odd, "id long, x array<double>").repartition(5)


def test_principal_components(spark):
    x = np.random.default_rng(1).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axis = vt[:2].T * np.sign(vt[:2].T[np.abs(vt[:2].T).argmax(0), np.arange(2)])
    found = embedding.principal_components(_vectors(spark, x), 2).collect()
    assert len(found) == 200
    for r in found:
        assert np.allclose(r["scores"], (x[r["id"]] - x.mean(0)) @ axis, atol=1e-6)
        assert np.allclose(r["explained"], (s**2 / (s**2).sum())[:2])
    assert embedding.principal_components(_vectors(spark, x).limit(0)).count() == 0


def test_nearest_neighbours(spark):
    x = np.random.default_rng(2).normal(size=(150, 4))
    x[10] = x[20]
    df = _vectors(spark, x)
    found = {}
    for r in embedding.nearest_neighbours(df.where("id % 10 = 0"), df, k=6, block=40).collect():
        found.setdefault(r["id"], {})[r["place"]] = (r["neighbour"], r["distance"])
    assert set(found) == set(range(0, 150, 10))
    for i, near in found.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(150), d))[:6]
        assert [near[p + 1][0] for p in range(6)] == order.tolist() and np.allclose([near[p + 1][1] for p in range(6)], d[order])


def test_k_means(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.3 + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0])])
    found = embedding.k_means(_vectors(spark, x), 3, seed=4).collect()
    c = np.zeros(120, int)
    for r in found:
        c[r["id"]] = r["cluster"]
    centres = np.array([x[c == k].mean(0) if (c == k).any() else np.full(3, 99.0) for k in range(3)])
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    assert (d.argmin(1) == c).all()  # a fixed point of the algorithm
    assert all(abs(r["distance"] - d[r["id"], r["cluster"]]) < 1e-6 for r in found)
