"""Grown graphs and passage times against plain forms, and that large ones end soon."""

import time

import numpy as np

from tremolo.functions import graph_kernels as g
from tremolo.functions import source_kernels


def _plain_growth(n, k, rng, eta=-1.0, gamma=0.5):
    i, j = np.triu_indices(n, 1)
    d = np.minimum(j - i, n - (j - i)) ** eta
    b = np.zeros((n, n))
    for _ in range(k):
        deg, both = b.sum(1), b @ b
        match = (both / np.maximum(1, deg[:, None] + deg[None, :] - both))[i, j] + 0.01
        p = np.where(b[i, j] > 0, 0, d * match**gamma)
        x = rng.choice(len(i), p=p / p.sum())
        b[i[x], j[x]] = b[j[x], i[x]] = 1
    return b


def test_generative_model_draws_as_if_all_weights_were_made_anew():
    for seed in range(5):
        x, y = g.generative_model(np.zeros((16, 16)), np.arange(16), np.random.default_rng(seed), k=40)
        assert np.array_equal(np.stack(np.nonzero(np.triu(_plain_growth(16, 40, np.random.default_rng(seed))))), [x, y])
    assert len(g.generative_model(np.zeros((7, 7)), np.arange(7), np.random.default_rng(1), k=99)[0]) == 21
    began = time.time()
    assert len(g.generative_model(np.zeros((1500, 1500)), np.arange(1500), np.random.default_rng(1), k=600)[0]) == 600
    assert time.time() - began < 60  # some 190 s with all weights made anew


def test_ks_energy_of_a_graph_of_thousands_of_edges():
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((700, 700)) < 0.03, 1) * 1.0
    began = time.time()
    e = [x[0] for x in g.ks_energy(a + a.T, np.arange(700), rng)]
    assert e[0] == max(e[1:]) and 0 < e[0] <= 1
    assert time.time() - began < 60  # 7,000 steps of over 30 ms before


def test_diffusion_efficiency_by_elimination(monkeypatch):
    n = 9
    a = np.ones((n, n)) - np.eye(n)  # every passage takes n - 1 steps on average
    for name in ("eig", "pinv"):
        monkeypatch.setattr(np.linalg, name, None)
    assert abs(g.diffusion_efficiency(a, np.arange(n), None)[0][0] - 1 / (n - 1)) < 1e-12
    cycle = np.roll(np.eye(n), 1, axis=1)
    assert abs(g.diffusion_efficiency(cycle, np.arange(n), None)[0][0] - np.mean(1 / np.arange(1, n))) < 1e-9


def test_louvain_leaves_out_empty_communities(monkeypatch):
    widths, least = [], np.argmax
    monkeypatch.setattr(np, "argmax", lambda x: widths.append(len(x)) or least(x))
    k = np.repeat(np.arange(8), 12)
    a = (k[:, None] == k[None, :]) * 1.0 - np.eye(96)
    ci = g.louvain_partition(a + 0.001, np.random.default_rng(0), 1.0)
    assert all((ci[k == c] == ci[k == c][0]).all() for c in range(8)) and len(set(ci)) == 8
    assert widths[:96] == [96] * 96 and widths[100] < 48


def test_generative_model_without_a_matrix_of_all_nodes():
    n = 60_000  # a matrix of 29 GB
    none = source_kernels.Arcs(n, *np.zeros((2, 0), int), np.zeros(0))
    (x, y), = source_kernels.generative_model(none, np.arange(n) + 7, np.arange(n), np.random.default_rng(1), k=60)
    assert len(set(zip(x.tolist(), y.tolist(), strict=True))) == 60 and (x < y).all() and x.min() >= 7
    a = np.zeros((16, 16))
    (x, y), = source_kernels.generative_model(g.arcs(a), np.arange(16), np.arange(16), np.random.default_rng(4), k=40)
    assert np.array_equal(np.stack(np.nonzero(np.triu(_plain_growth(16, 40, np.random.default_rng(4))))), [x, y])
