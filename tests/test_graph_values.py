"""Graph kernels on graphs whose values are known, and on random ones against other formulas."""

import math

import numpy as np
import pytest

from tremolo.functions import graph_kernels as g
from tremolo.operators import graph


def _rng():
    return np.random.default_rng(0)


def _run(kernel, a, **params):
    return getattr(g, kernel)(a.astype(float), np.arange(len(a)), _rng(), **params)


def _star(n):
    a = np.zeros((n, n))
    a[0, 1:] = a[1:, 0] = 1
    return a


def _path(n):
    return np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)


def _cliques(k):
    a = np.zeros((2 * k, 2 * k))
    a[:k, :k] = a[k:, k:] = 1
    np.fill_diagonal(a, 0)
    a[0, k] = a[k, 0] = 1
    return a


def _random(n=18, p=0.3, seed=1):
    rng = np.random.default_rng(seed)
    a = np.triu((rng.random((n, n)) < p) * rng.integers(1, 6, (n, n)), 1).astype(float)
    a[np.arange(n - 1), np.arange(1, n)] = 1 + np.arange(n - 1) % 3  # connected
    return a + a.T


def test_distances_and_efficiency():
    i, j, d, steps = _run("distance_wei", _path(6) * 2)
    assert all(x == abs(a - b) / 2 and s == abs(a - b) for a, b, x, s in zip(i, j, d, steps, strict=True))
    n = 7
    assert abs(_run("global_efficiency", _star(n))[0][0] - (2 * (n - 1) + (n - 1) * (n - 2) / 2) / (n * (n - 1))) < 1e-12
    assert abs(_run("global_efficiency", _path(3) * 4, weighted=True)[0][0] - (4 * 4 + 2 * 2) / 6) < 1e-12
    assert np.allclose(_run("local_efficiency", _cliques(5))[1][1:5], 1) and np.allclose(_run("local_efficiency", _star(5))[1], 0)
    mean, _, radius, diameter = (x[0] for x in _run("characteristic_path", _path(5)))
    assert (mean, radius, diameter) == (2.0, 2, 4)
    cycle = np.roll(np.eye(6), 1, axis=1)
    assert set(_run("edge_range", cycle + cycle.T)[2]) == {5}


def test_betweenness_counts_every_shortest_path():
    assert np.allclose(_run("betweenness", _star(6))[1], [20, 0, 0, 0, 0, 0])
    assert np.allclose(_run("betweenness", _path(4))[1], [0, 4, 4, 0])
    a = _random()
    for weighted in (False, True):
        cost = np.where(a > 0, 1 / np.maximum(a, 1e-300) if weighted else 1.0, np.inf)
        n = len(a)
        wanted = np.zeros(n)
        d = cost.copy()
        np.fill_diagonal(d, 0)
        for k in range(n):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])

        def count(s, t, near=cost, far=d):
            """All shortest paths from s to t, as lists of inner nodes."""
            if s == t:
                return [[]]
            return [([v] if v != t else []) + rest for v in range(n) if abs(near[s, v] + far[v, t] - far[s, t]) < 1e-9 for rest in count(v, t)]

        for s in range(n):
            for t in range(n):
                if s != t:
                    ways = count(s, t)
                    for way in ways:
                        wanted[way] += 1 / len(ways)
        assert np.allclose(_run("betweenness", a, weighted=weighted)[1], wanted)


def test_centralities_against_linear_algebra():
    a = _random()
    n = len(a)
    b = (a > 0).astype(float)
    v = _run("eigenvector_centrality", a)[1]
    assert np.allclose(a @ v, (v @ a @ v) * v, atol=1e-9) and (v >= 0).all()
    r = _run("pagerank", a)[1]
    for _ in range(500):
        r2 = 0.15 / n + 0.85 * (a / a.sum(0)) @ r
    assert np.allclose(r2, r, atol=1e-9) and abs(r.sum() - 1) < 1e-12
    total, term = np.eye(n), np.eye(n)
    for k in range(1, 60):
        term = term @ b / k
        total = total + term
    assert np.allclose(_run("subgraph_centrality", a)[1], np.diag(total), rtol=1e-9)
    i, j, steps = _run("mean_first_passage", a)
    p = a / a.sum(1, keepdims=True)
    for t in (0, 5):
        rest = [k for k in range(n) if k != t]
        wanted = np.linalg.solve(np.eye(n - 1) - p[np.ix_(rest, rest)], np.ones(n - 1))
        assert np.allclose([steps[k] for k in range(len(i)) if j[k] == t], wanted)
    assert abs(_run("diffusion_efficiency", a)[0][0] - np.mean(1 / np.array(steps))) < 1e-12


def test_walks_paths_and_routes():
    a = _random()
    b = (a > 0).astype(float)
    assert np.allclose(_run("walks", a, q=3)[1], [b.sum(), (b @ b).sum(), (b @ b @ b).sum()])
    cycle = np.roll(np.eye(4), 1, axis=1)
    k, paths, cycles, _ = _run("paths", cycle)
    assert (list(k), list(paths), list(cycles)) == ([1, 2, 3, 4], [4, 4, 4, 0], [0, 0, 0, 4])
    i, j, bits = _run("search_information", _path(4))
    found = {(x, y): z for x, y, z in zip(i, j, bits, strict=True)}
    assert abs(found[(0, 3)] - 2) < 1e-9 and abs(found[(0, 1)]) < 1e-9 and abs(found[(1, 3)] - 2) < 1e-9


@pytest.mark.parametrize("kernel", ["louvain", "spectral_modularity", "consensus"])
def test_communities_of_two_cliques(kernel):
    a = _cliques(6)
    out = _run(kernel, a)
    c = np.array(out[1])
    assert len(set(c[:6])) == len(set(c[6:])) == 1 and c[0] != c[6]
    if kernel != "consensus":
        two_m, inside = a.sum(), 30
        assert np.allclose(out[2], 2 * (inside / two_m - ((inside + 1) / two_m) ** 2))


def test_cliques_cores_and_backbones():
    ids, community = _run("clique_communities", _cliques(5), size=4)[:2]
    by = {}
    for i, c in zip(ids, community, strict=True):
        by.setdefault(c, set()).add(int(i))
    assert sorted(map(sorted, by.values())) == [list(range(5)), list(range(5, 10))]
    a = _random()
    left = np.array(_run("s_core", a, s=8.0)[1])
    assert (a[np.ix_(left, left)].sum(1) >= 8).all()
    i, j, w, tree = _run("backbone", a, avgdeg=3)
    assert sum(tree) == len(a) - 1 and len(w) == max(int(3 * len(a) / 2), len(a) - 1)
    lap = np.zeros_like(a)
    for x, y, t in zip(i, j, tree, strict=True):
        if t:
            lap[x, y] = lap[y, x] = -1
    np.fill_diagonal(lap, -lap.sum(1))
    assert abs(np.linalg.det(lap[1:, 1:]) - 1) < 1e-6  # one spanning tree


def test_null_models_keep_what_they_promise():
    a = _random()
    for params in ({}, {"directed": True}, {"connected": True}, {"lattice": True}):
        i, j, w, _ = _run("rewired", a, **params)
        r = np.zeros_like(a)
        r[i, j] = w
        assert ((r != 0).sum(1) == (a != 0).sum(1)).all() and ((r != 0).sum(0) == (a != 0).sum(0)).all()
        assert sorted(w) == sorted(a[a != 0])
        if not params.get("directed"):
            assert (r == r.T).all()
    sign = a * np.where((np.add.outer(np.arange(len(a)), np.arange(len(a))) % 3) == 0, -1, 1)
    i, j, w = _run("null_model_signed", sign)
    assert (np.sort(w) <= sign.max()).all() and (np.array(w) < 0).sum() <= (sign < 0).sum()
    for kind in ("random", "lattice", "ring", "toeplitz", "fractal", "even"):
        i, j = _run("generated", np.zeros((20, 20)), kind=kind, k=40)
        assert len(set(zip(i, j, strict=True))) == 40 and (np.array(i) != np.array(j)).all()
    i, j = _run("generated", np.zeros((20, 20)), kind="ring", k=40)
    assert max(min(abs(x - y), 20 - abs(x - y)) for x, y in zip(i, j, strict=True)) == 1


def test_directed_and_signed_clustering_against_products(spark):
    rng = np.random.default_rng(5)
    n = 14
    a = (rng.random((n, n)) < 0.35) * rng.integers(1, 9, (n, n)).astype(float)
    np.fill_diagonal(a, 0)
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id long")
    s, b = np.cbrt(a) + np.cbrt(a.T), (a > 0).astype(float)
    t = np.diag(s @ s @ s) / 2
    k = (b + b.T).sum(1)
    pairs = k * (k - 1) - 2 * np.diag(b @ b)
    found = {r["id"]: r["c"] for r in graph.clustering_wd(edges=edges, nodes=nodes).collect()}
    assert all(abs(found[u] - (t[u] / pairs[u] if t[u] else 0)) < 2e-6 for u in range(n))
    assert abs(graph.transitivity_wd(edges=edges, nodes=nodes).first()["t"] - t.sum() / pairs.sum()) < 2e-6
    w = np.triu(a, 1) * np.where(rng.random((n, n)) < 0.4, -1, 1)
    w = w + w.T
    i, j = np.nonzero(w)
    signed = spark.createDataFrame([(int(x), int(y), float(w[x, y])) for x, y in zip(i, j, strict=True)], "src long, dst long, w double")
    found = {r["id"]: (r["c_pos"], r["c_neg"]) for r in graph.clustering_sign(edges=signed, nodes=nodes).collect()}
    for at, part in enumerate((np.maximum(w, 0), np.maximum(-w, 0))):
        c, k = np.cbrt(part), (part > 0).sum(1)
        three = np.diag(c @ c @ c)
        for u in range(n):
            assert math.isclose(found[u][at], three[u] / (k[u] * (k[u] - 1)) if k[u] > 1 else 0, abs_tol=2e-6)
