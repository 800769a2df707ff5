"""Operators against values worked out apart from their SQL: closed forms, NumPy, plain loops."""

import math
from collections import Counter, deque

import numpy as np
import pytest

from tremolo.functions import graph_kernels
from tremolo.operators import bursts, cohort, connectivity, graph, spikes


def _spikes(spark, trains):
    return spark.createDataFrame([(rec, unit, int(t)) for (rec, unit), ts in trains.items() for t in ts], "rec string, unit long, tick long")


def test_tiling_of_two_trains_and_of_units_that_share_no_recording(spark):
    a, b = [1_000_000, 2_000_000, 3_000_000], [1_020_000, 2_500_000, 3_040_000]
    df = _spikes(spark, {("r", 1): a, ("r", 2): b, ("s", 3): a, ("t", 4): a})
    found = connectivity.tiling_coefficient(spikes=df, dt=50_000, stop=10_000_000).collect()
    assert [(r["rec"], r["a"], r["b"]) for r in found] == [("r", 1, 2)]
    ta = tb = 0.3 / 10
    pa = pb = 2 / 3
    assert abs(found[0]["sttc"] - 0.5 * ((pa - tb) / (1 - tb * pa) + (pb - ta) / (1 - ta * pb))) < 1e-6
    # Without a given stop the recording ends with the second of its last spike: 4 s.
    t = 0.3 / 4
    short = connectivity.tiling_coefficient(spikes=df, dt=50_000).collect()
    assert abs(short[0]["sttc"] - (pa - t) / (1 - t * pa)) < 1e-6


def test_dunn_index_takes_each_candidates_own_n(spark):
    rng = np.random.default_rng(3)
    ticks = np.sort(rng.choice(100_000, 300, replace=False))
    candidates = spark.createDataFrame([(n, 900) for n in (3, 4, 7)], "n int, threshold int")
    found = {r["n"]: r["dunn"] for r in bursts.dunn_threshold(stream=_spikes(spark, {("r", 1): ticks}), candidates=candidates).collect()}
    for n in (3, 4, 7):
        span = ticks[n - 1 :] - ticks[: -(n - 1)]
        low, high = span[span <= 900], span[span > 900]
        wanted = (high.min() - low.max()) / max(np.ptp(low), np.ptp(high)) if len(low) and len(high) else 0.0
        assert abs(found[n] - wanted) < 1e-8
    assert len(set(found.values())) > 1


def _burst_case(spark):
    rng = np.random.default_rng(8)
    trains, rows = {}, {}
    for rec in ("r", "s"):
        ticks = np.unique(np.concatenate([rng.integers(0, 4_000_000, 60), *[c + rng.integers(0, 40_000, 12) for c in rng.integers(0, 4_000_000, 9)]]))
        for k, t in enumerate(ticks):
            trains.setdefault((rec, k % 5), []).append(t)
        rows[rec] = ticks
    stream = _spikes(spark, trains)
    found = bursts.gap_bursts(stream=stream, gap=9_000, n=4)
    return rows, stream, found, {rec: sorted((r["burst"], r["t_start"], r["t_end"]) for r in found.collect() if r["rec"] == rec) for rec in rows}


def test_spikes_in_and_between_bursts(spark):
    rows, stream, found, own = _burst_case(spark)
    got = {(r["rec"], r["burst"]): (r["inside"], r["gap_before"]) for r in bursts.burst_spike_counts(bursts=found, stream=stream).collect()}
    for rec, ticks in rows.items():
        before = -1
        assert len(own[rec]) > 3
        for k, start, end in own[rec]:
            assert got.pop((rec, k)) == (((ticks > start) & (ticks < end)).sum(), ((ticks > before) & (ticks < start)).sum())
            before = end
        assert got.pop((rec, 0), (0, 0)) == (0, (ticks > before).sum())
    assert not got


def test_burst_features_against_loops(spark):
    rows, stream, found, own = _burst_case(spark)
    got = {(r["rec"], r["name"]): r["middle"] for r in bursts.burst_features(bursts=found, stream=stream, bin=5_000).collect()}
    for rec, ticks in rows.items():
        rise, rate = [], []
        for _, start, end in own[rec]:
            count = Counter(((t - start) // 5_000) for t in ticks if start <= t <= end)
            top = max(count.values())
            rise.append(min(k for k, v in count.items() if v == top) * 5_000 / 1e6)
            rate.append(top / 5 * (1e6 / 5_000))
        for name, v in (("rise", rise), ("peak_rate", rate), ("duration", [(e - s) / 1e6 for _, s, e in own[rec]])):
            v = np.array(v)
            far = abs(v - np.median(v))
            assert abs(got[(rec, name)] - np.median(v[far <= 3 * 1.4826 * np.median(far)])) < 2e-5


def test_rates_divide_by_the_recordings_own_length(spark):
    df = _spikes(spark, {("r", 1): [0, 500_000, 1_000_000, 7_400_000], ("s", 1): [10, 20, 30]})
    found = {r["rec"]: r["firing_rate"] for r in spikes.activity_features(spikes=df).collect()}
    assert found == {"r": 0.5, "s": 3.0}


def test_input_matrix_takes_its_scale_from_training_rows(spark):
    x = [1.0, 2.0, 4.0, 100.0, None]
    train = [True, True, True, False, False]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(x, train, strict=True))], "id int, x double, train boolean")
    found = {r["id"]: r["v"] for r in cohort.input_matrix(rows=df).collect()}
    v = np.array([1.0, 2.0, 4.0])
    z = (np.array([1.0, 2.0, 4.0, 100.0, 0.0]) - v.mean()) / v.std(ddof=1)
    assert all(abs(found[k] - z[k] / abs(z[:3]).max()) < 1e-5 for k in range(5))


def _graph(seed, n=24, p=0.25):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < p, 1) * rng.integers(1, 5, (n, n)).astype(float)
    a[0, 1:] = 1.0  # a hub
    a[:, n - 1] = 0.0  # and a node alone
    a[n - 1] = 0.0
    return a + a.T


def _edges(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "src long, dst long, w double"), spark.createDataFrame([(k,) for k in range(len(a))], "id long")


def test_triangles_against_matrix_products(spark):
    a = _graph(1)
    edges, nodes = _edges(spark, a)
    b, c = (a > 0).astype(float), np.cbrt(a)
    k = b.sum(0)
    pairs = np.where(k > 1, k * (k - 1), 1)
    found = {r["id"]: (r["c_bin"], r["c_wei"]) for r in graph.clustering(edges=edges, nodes=nodes).collect()}
    for u in range(len(a)):
        wanted = (np.diag(b @ b @ b)[u] / pairs[u], np.diag(c @ c @ c)[u] / pairs[u]) if k[u] > 1 else (0, 0)
        assert np.allclose(found[u], wanted, atol=2e-6)
    t = graph.transitivity(edges=edges).first()
    assert abs(t["t_bin"] - np.trace(b @ b @ b) / (k * (k - 1)).sum()) < 2e-6 and abs(t["t_wei"] - np.trace(c @ c @ c) / (k * (k - 1)).sum()) < 2e-6


def test_hop_distances_of_a_path_and_a_random_graph(spark):
    path = np.diag(np.ones(39), 1)
    for a in (path + path.T, _graph(2, p=0.05)):
        edges, nodes = _edges(spark, a)
        wanted = {}
        for s in range(len(a)):
            d, line = {s: 0}, deque([s])
            while line:
                u = line.popleft()
                for v in np.flatnonzero(a[u]).tolist():
                    if v not in d:
                        d[v] = d[u] + 1
                        line.append(v)
            wanted |= {(s, v): x for v, x in d.items()}
        assert {(r["a"], r["b"]): r["d"] for r in graph.hop_distances(edges, nodes).collect()} == wanted


def test_core_of_a_large_graph_leaves_no_node_that_gains():
    rng = np.random.default_rng(6)
    n = 400
    strength = rng.random(n)
    a = (rng.random((n, n)) < np.outer(strength, strength)).astype(float)
    np.fill_diagonal(a, 5.0)  # links to itself don't count
    _, core = graph_kernels.core_periphery(a, np.arange(n), rng)
    w = a - np.diag(np.diag(a))
    b = w - w.mean()
    b = b + b.T
    q = lambda c: b[np.ix_(c == 1, c == 1)].sum() - b[np.ix_(c == 0, c == 0)].sum()
    best = q(core)
    assert 0 < core.sum() < n
    for u in range(n):
        moved = core.copy()
        moved[u] = 1 - moved[u]
        assert q(moved) <= best + 1e-9


def test_ccg_pair_at_the_edges_of_bins_and_windows(spark):
    df = _spikes(spark, {("r", 1): [0, 20, 1000], ("r", 2): [10, 30, 1010]})
    found = Counter()
    for r in connectivity.ccg_counts(spikes=df, bin=20, half=50, width=1010).collect():
        if (r["a"], r["b"]) == (1, 2):
            found[r["lag_bin"]] += r["n"]
    wanted = Counter()
    for x in (0, 20, 1000):
        for y in (10, 30, 1010):
            gap = y - x
            if gap <= 20 * 50.5 if x < y else -gap < 20 * 50.5:
                wanted[int(-math.floor(0.5 + (x - y) / 20))] += 1
    assert found == wanted


def test_tables_side_by_side(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.25)], "unit long, rec string, f double")
    b = spark.createDataFrame([("x", 2, 7), ("y", 2, 8)], "rec string, unit long, g long")
    found = cohort.join_features([a, b], ["unit", "rec"]).select("unit", "rec", "f", "g").collect()
    assert {tuple(r) for r in found} == {(1, "x", 0.5, None), (2, "x", 0.25, 7), (2, "y", None, 8)}
    with pytest.raises(ValueError, match="f"):
        cohort.join_features([a, a], ["unit", "rec"])
