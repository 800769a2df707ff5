"""Kernels by blocks of sources against plain loops, through Spark."""

import time
import tracemalloc

import numpy as np
import pytest
from tests.test_graph_values import _random

from tremolo.functions import source_kernels
from tremolo.operators import graph


def _given(spark, a):
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([("x", int(p), int(q), float(a[p, q])) for p, q in zip(i, j, strict=True)], "g string, src long, dst long, w double")
    return edges, spark.createDataFrame([("x", k) for k in range(len(a))], "g string, id long")


def _found(spark, a, kernel, schema, **params):
    return [r[1:] for r in graph.by_sources(*_given(spark, a), kernel, schema, **params).collect()]


def _lengths(a, weighted):
    d = np.where(a > 0, 1 / np.maximum(a, 1e-300) if weighted else 1.0, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(a)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def _through(a, weighted):
    """Shares of shortest paths through nodes and arcs, counted path by path."""
    d, n = _lengths(a, weighted), len(a)
    cost = np.where(a > 0, 1 / np.maximum(a, 1e-300) if weighted else 1.0, np.inf)
    node, edge = np.zeros(n), np.zeros((n, n))

    def ways(s, t):
        if s == t:
            return [[t]]
        return [[s, *rest] for v in range(n) if abs(cost[s, v] + d[v, t] - d[s, t]) < 1e-9 for rest in ways(v, t)]

    for s in range(n):
        for t in range(n):
            found = ways(s, t) if s != t else []
            for way in found:
                node[way[1:-1]] += 1 / len(found)
                for x, y in zip(way, way[1:], strict=False):
                    edge[x, y] += 1 / len(found)
    return node, edge


def _total(rows, n):
    out = np.zeros((n,) * (len(rows[0]) - 1))
    for *at, x in rows:
        out[tuple(at)] += x
    return out


def test_distance_wei(spark):
    a = _random(14)
    a[3] = a[:, 3] = 0  # a node of its own
    d = _lengths(a, True)
    got = {(x, y): (z, h) for x, y, z, h in _found(spark, a, "distance_wei", "g string, a long, b long, d double, hops double")}
    assert set(got) == {(x, y) for x in range(14) for y in range(14) if x != y and np.isfinite(d[x, y])}
    assert all(abs(z - d[k]) < 1e-9 and h >= 1 for k, (z, h) in got.items())
    path = np.diag(np.full(4, 2.0), 1)
    path[0, 4] = 0.5  # as long as the four edges of 1/2: the path of fewest edges counts
    assert dict((r[1], r[3]) for r in _found(spark, path, "distance_wei", "g string, a long, b long, d double, hops double") if r[0] == 0)[4] == 1


def test_global_efficiency_wei(spark):
    a = _random(14)
    total = sum(r[0] for r in _found(spark, a, "inverse_distances", "g string, inverse double, nodes long"))
    d = _lengths(a, True)
    assert abs(total - sum(1 / d[x, y] for x in range(14) for y in range(14) if x != y)) < 1e-9


def test_betweenness_wei(spark):
    a = _random(14)
    got = _total(_found(spark, a, "betweenness", "g string, id long, x double", weighted=True), 14)
    assert np.allclose(got, _through(a, True)[0])


def test_betweenness(spark):
    a = _random(14)
    got = _total(_found(spark, a, "betweenness", "g string, id long, x double", weighted=False), 14)
    assert np.allclose(got, _through(a, False)[0])


def test_edge_betweenness(spark):
    a = _random(14)
    got = _total(_found(spark, a, "edge_betweenness", "g string, a long, b long, x double", weighted=False), 14)
    assert np.allclose(got, _through(a, False)[1])


def test_edge_betweenness_wei(spark):
    a = _random(14)
    got = _total(_found(spark, a, "edge_betweenness", "g string, a long, b long, x double", weighted=True), 14)
    assert np.allclose(got, _through(a, True)[1])


@pytest.mark.parametrize("n, far", [(3, 2), (4, 3), (9, 8), (12, 11)])
def test_edge_range(spark, n, far):
    cycle = np.roll(np.eye(n), 1, axis=1)
    assert set(r[2:] for r in _found(spark, cycle + cycle.T, "edge_range", "g string, a long, b long, d double, shortcut boolean")) == {(far, far > 2)}


def test_characteristic_path_of_a_graph_too_large_for_a_matrix(spark):
    n = 60_000  # a matrix of 29 GB; a star: two steps between leaves
    star = spark.range(1, n).selectExpr("'x' AS g", "0L AS src", "id AS dst", "1D AS w")
    edges = star.unionByName(star.selectExpr("g", "dst AS src", "src AS dst", "w"))
    schema = "g string, reached long, total long, inverse double, low double, high double, nodes long"
    got = graph.by_sources(edges, spark.range(n).selectExpr("'x' AS g", "id"), "hop_statistics", schema)
    reached, total, low, high = got.selectExpr("sum(reached)", "sum(total)", "min(low)", "max(high)").first()
    assert (reached, total, low, high) == (n * (n - 1), 2 * (n - 1) + 2 * (n - 1) * (n - 2), 1, 2)


def _star(spark, n):
    """Edges and nodes of a star whose matrix would take 8 n * n bytes."""
    arm = spark.range(1, n).selectExpr("'x' AS g", "0L AS src", "id AS dst", "1D AS w")
    return arm.unionByName(arm.selectExpr("g", "dst AS src", "src AS dst", "w")), spark.range(n).selectExpr("'x' AS g", "id")


def test_walks_of_a_graph_too_large_for_a_matrix(spark):
    n = 60_000
    got = graph.by_sources(*_star(spark, n), "walks", "g string, steps long, walks double", whole=True, loops=True)
    m = n - 1
    assert [r["walks"] for r in got.orderBy("steps").collect()] == [2 * m, m * m + m, 2 * m * m, m**3 + m * m]


def test_eigenvector_of_a_graph_too_large_for_a_matrix(spark):
    n = 60_000
    got = dict(r[1:] for r in graph.by_sources(*_star(spark, n), "eigenvector_centrality", "g string, id long, c double", whole=True, loops=True).collect())
    assert len(got) == n and abs(got[0] - 0.5**0.5) < 1e-6 and abs(got[7] - (0.5 / (n - 1)) ** 0.5) < 1e-6


def test_paths_of_a_graph_too_large_for_a_matrix(spark):
    n = 60_000
    got = graph.by_sources(*_star(spark, n), "paths", "g string, edges long, paths double, cycles double, share double", whole=True, q=3)
    m = n - 1
    assert [r[2:4] for r in got.orderBy("edges").collect()] == [(2 * m, 0), (m * (m - 1), 2 * m), (0, 0)]


def test_latticised_on_a_graph_too_large_for_a_matrix(spark):
    n = 60_000
    half = spark.range(0, n, 100).selectExpr("'x' AS g", "id AS src", "(id + 30100) % 60000 AS dst", "1D AS w").where("src < dst")
    edges = half.unionByName(half.selectExpr("g", "dst AS src", "src AS dst", "w"))
    got = graph.by_sources(edges, spark.range(n).selectExpr("'x' AS g", "id"), "latticised", "g string, a long, b long, w double, swaps long", whole=True, seeded=True)
    before, after = (sorted(r[0] for r in x.collect()) for x in (edges.select("src"), got.select("a")))
    assert before == after and got.first()["swaps"] > 0


def test_subgraph_centrality(spark):
    a = _random(14)
    val, vec = np.linalg.eigh((a > 0) * 1.0)
    got = dict(_found(spark, a, "subgraph_centrality", "g string, id long, c double", loops=True))
    assert np.allclose([got[k] for k in range(14)], (vec**2) @ np.exp(val))


def test_hop_pairs_are_not_joined(spark, capsys):
    a = _random(14)
    edges, nodes = (x.drop("g") for x in _given(spark, a))
    found = graph.hop_distances(edges, nodes)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    d = _lengths(a, False)
    assert {(r["a"], r["b"]): r["d"] for r in found.collect()} == {(x, y): d[x, y] for x in range(14) for y in range(14)}


class _Counted:
    """A generator that counts its calls."""

    def __init__(self):
        self.rng, self.calls = np.random.default_rng(3), 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.rng, name)


def test_latticised_draws_in_blocks():
    n = 400
    a = np.triu(np.random.default_rng(1).random((n, n)) < 0.05, 1) * np.random.default_rng(2).integers(1, 9, (n, n)).astype(float)
    a = a + a.T
    u, v = np.nonzero(a)
    rng = _Counted()
    i, j, w, done = next(source_kernels.latticised(source_kernels.Arcs(n, u, v, a[u, v]), np.arange(n), np.arange(n), rng))
    r = np.zeros_like(a)
    r[i, j] = w
    assert len(i) == len(u) and (r == r.T).all() and ((r != 0).sum(1) == (a != 0).sum(1)).all() and (np.diag(r) == 0).all()
    assert (np.sort(w) == np.sort(a[u, v])).all() and done[0] > len(u)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    d = np.minimum(d, n - d)
    assert (d * r).sum() < 0.5 * (d * a).sum()
    assert rng.calls < len(u)  # several for each link and round before


def test_paths_are_counted_without_a_set_for_each_node():
    n, m = 4000, 100_000
    rng = np.random.default_rng(4)
    name = np.unique(np.r_[rng.integers(0, n * n, m), np.arange(1, n), np.arange(1, n) * n])  # node 0 links with all, both ways
    name = name[name // n != name % n]
    u, v = name // n, name % n
    g = source_kernels.Arcs(n, u, v, np.ones(len(u)))
    tracemalloc.start()
    _, found, cycles, _ = next(source_kernels.paths(g, np.arange(n), np.arange(n), 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    b = np.zeros((n, n), np.float32)
    b[u, v] = 1
    two = b @ b
    assert cycles == [0, np.trace(two), (two * b.T).sum(dtype=float)]
    assert found[1] == two.sum(dtype=float) - np.trace(two)
    assert peak < 24e6


def test_hop_pairs_come_by_node_with_all_sources_of_a_block():
    n = 300  # a line with a hub of 150 leaves at its end: distances of up to eight bits
    u, v = np.r_[np.arange(149), np.full(151, 149)], np.r_[np.arange(1, 150), np.arange(149, 300)]
    g = source_kernels.Arcs(n, np.r_[u, v], np.r_[v, u], np.ones(2 * len(u)))
    a, b, d = (np.concatenate(x) for x in zip(*source_kernels.hop_pairs(g, np.arange(n), np.arange(n)), strict=True))
    assert len(a) == n * n and np.array_equal(np.lexsort((a, b)), np.arange(n * n))  # by distance first before
    place = np.minimum(np.arange(n), 150)
    far = np.where((a >= 150) & (b >= 150), 2, np.abs(place[a] - place[b]))
    assert np.array_equal(d, np.where(a == b, 0, far))


class _ByRows:
    """Addition that can't go down columns run by run."""

    reduce = staticmethod(np.add.reduce)

    def __call__(self, x, y):
        return np.add(x, y)


def test_wide_values_move_along_arcs_by_whole_rows():
    n = 500
    rng = np.random.default_rng(6)
    b = rng.random((n, n)) < 0.05
    b[:, 7] = True  # a head of 499 arcs
    np.fill_diagonal(b, False)
    u, v = np.nonzero(b)
    x = rng.integers(0, 1000, (n, 20)).astype(float)
    found = source_kernels.Arcs(n, u, v, np.ones(len(u))).pull(x, _ByRows(), np.zeros_like(x))
    assert np.array_equal(found, b.T.astype(float) @ x)


@pytest.mark.parametrize("weighted", [False, True])
def test_betweenness_along_a_long_line_passes_each_arc_once(weighted):
    n = 2000
    u, v = np.r_[np.arange(n - 1), np.arange(1, n)], np.r_[np.arange(1, n), np.arange(n - 1)]
    g = source_kernels.Arcs(n, u, v, np.full(len(u), 2.0))
    began = time.time()
    (ids, found), = source_kernels.betweenness(g, np.arange(n), np.arange(n), weighted=weighted)
    (a, b, shared), = source_kernels.edge_betweenness(g, np.arange(n), np.arange(n), weighted=weighted)
    assert time.time() - began < 60  # a sweep over all arcs and sources for each edge of a path before
    assert np.allclose(found, 2 * ids * (n - 1 - ids))
    low = np.minimum(a, b) + 1
    assert np.allclose(shared, low * (n - low))


def test_weighted_betweenness_where_lengths_differ_a_thousandfold():
    rng = np.random.default_rng(7)
    a = (rng.random((12, 12)) < 0.4) * 10.0 ** rng.integers(-3, 4, (12, 12))
    np.fill_diagonal(a, 0)
    u, v = np.nonzero(a)
    node, edge = source_kernels.brandes(source_kernels.Arcs(12, u, v, a[u, v]), np.arange(12), True)
    want, arcs = _through(a, True)
    g = source_kernels.Arcs(12, u, v, a[u, v])
    assert np.allclose(node, want) and np.allclose(edge, arcs[g.u, g.v])


def test_weighted_distances_along_a_long_line_pass_each_arc_once():
    n = 3000
    u, v = np.r_[np.arange(n - 1), np.arange(1, n)], np.r_[np.arange(1, n), np.arange(n - 1)]
    g = source_kernels.Arcs(n, u, v, np.full(len(u), 2.0))
    began = time.time()
    total = sum(x[0][0] for x in source_kernels.inverse_distances(g, np.arange(n), np.arange(n)))
    assert time.time() - began < 40
    far = np.arange(1, n)
    assert abs(total / (2 * ((n - far) / (far / 2)).sum()) - 1) < 1e-9
    rows = source_kernels.distance_wei(g, np.arange(n), np.arange(0, n, 100))
    assert all(np.allclose(d, np.abs(a - b) / 2) and np.array_equal(hops, np.abs(a - b)) for a, b, d, hops in rows)
