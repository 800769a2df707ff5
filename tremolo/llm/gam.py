"""Generalised additive model with pairwise interactions, boosted cyclically (NumPy only).

Every feature is cut into bins. In rounds over all features, a tree of at most three leaves on
one feature is fitted to the gradient of the log loss and added to that feature's lookup table.
Then pairs of features are ranked by how far a four-leaf tree on their two axes lowers the
loss, and the best ones get lookup tables of two dimensions in the same way. A score is the
logistic function of an intercept and one table value for each feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


@dataclass
class Gam:
    """Bin edges, one lookup table for each feature, and for each chosen pair a 2-D table."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p}
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles where there are more than ``bins`` values."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values for each bin of the best tree with up to two cuts, taken one by one."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1], ridge) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge) - _gain(cg[-1], ch[-1], ridge)
            gain[(ch[:-1] < least) | (ch[-1] - ch[:-1] < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts both axes of a grid once."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    m, n = g.shape
    if m < 2 or n < 2:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[1:m, 1:n]
        top, left = c[1:m, n:], c[m:, 1:n]
        return [a, top - a, left - a, c[m, n] - top - left + a]

    gain = sum(_gain(a, b, ridge) for a, b in zip(four(cg), four(ch), strict=True)) - _gain(cg[m, n], ch[m, n], ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, n)), (slice(i + 1, m), slice(0, j + 1)), (slice(i + 1, m), slice(j + 1, n))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, pair_bins: int = 12, n_pairs: int = 8, pair_rounds: int = 60, ridge: float = 1.0, least: float = 0.5) -> Gam:
    """Fits labels y (0 or 1). With no rows or one class the model is a constant."""
    n, d = x.shape
    mean = min(max((y.sum() + 0.5) / (n + 1.0), 1e-4), 1 - 1e-4)
    model = Gam(float(np.log(mean / (1 - mean))), [_edges(x[:, j], bins) if n else np.zeros(0) for j in range(d)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, j], pair_bins) if n else np.zeros(0) for j in range(d)]
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    margin = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            size = len(model.tables[j])
            if size < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), ridge, least)
            model.tables[j] += step
            margin += step[at[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), ridge)[0], -i, -j) for i, j in combinations(range(d), 2)), reverse=True)
    model.pairs = [(-i, -j) for gain, i, j in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), ridge)[1]
            model.pair_tables[k] += step
            margin += step[coarse[i], coarse[j]]
    return model
