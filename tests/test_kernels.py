"""Kernels and rounds on hand-sized inputs."""

import numpy as np

from tremolo.functions.bursts import isi_n_bursts
from tremolo.functions.connectivity import poisson_cdf, poisson_inv, tiling
from tremolo.operators import bursts, connectivity, graph


def test_isi_n_bursts_of_a_tight_group():
    t = np.array([0, 50, 100, 150, 200, 201, 202, 203, 300, 350, 400, 450], dtype=float)
    found = isi_n_bursts(t, 4, 5)
    assert [(a, b) for a, b, _ in found] == [(200, 203)]


def test_poisson_quantile_inverts_the_distribution():
    for mean in (0.5, 3.0, 40.0):
        k = poisson_inv(0.99, mean)
        assert poisson_cdf(k, mean) >= 0.99 > poisson_cdf(k - 1, mean)


def test_tiling_operator_against_brute_force(spark):
    rng = np.random.default_rng(4)
    trains = {u: np.sort(rng.choice(10_000, 40, replace=False)) for u in range(4)}
    rows = [("r", u, int(t)) for u, ts in trains.items() for t in ts]
    df = spark.createDataFrame(rows, "rec string, unit long, tick long")
    found = connectivity.tiling_coefficient(spikes=df, dt=50, stop=10_000).collect()
    assert len(found) == 6
    for r in found:
        assert abs(r["sttc"] - tiling(trains[r["a"]].astype(float), trains[r["b"]].astype(float), 50, 0, 10_000)) < 1e-5


def test_core_numbers_of_a_clique_with_a_tail(spark):
    arcs = [(a, b) for a in range(4) for b in range(4) if a != b] + [(3, 4), (4, 3), (4, 5), (5, 4)]
    found = {r["id"]: r["coreness"] for r in graph.core_numbers(spark.createDataFrame(arcs, "src long, dst long")).collect()}
    assert found == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}


def test_components_of_a_long_path_and_an_isolated_node(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(32)], "id long")
    found = {r["id"]: (r["component"], r["size"]) for r in graph.connected_components(edges, nodes).collect()}
    assert found == {**{i: (0, 31) for i in range(31)}, 31: (31, 1)}


def test_gap_bursts_are_sessions(spark):
    df = spark.createDataFrame([("r", t, 1) for t in (0, 1, 2, 3, 100, 200, 201, 202, 203, 204)], "rec string, tick long, unit long")
    found = [(r["t_start"], r["t_end"], r["n"]) for r in bursts.gap_bursts(stream=df, gap=10, n=4).orderBy("burst").collect()]
    assert found == [(0, 3, 4), (200, 204, 5)]
