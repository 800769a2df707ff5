"""Correlogram statistics (NumPy only)."""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt

import numpy as np


def poisson_cdf(k: float, mean: float) -> float:
    """P(X <= k) of a Poisson variable; a normal tail beyond a mean of 500."""
    if k < 0:
        return 0.0
    if mean <= 0:
        return 1.0
    if mean > 500:
        return 0.5 * (1 + erf((k + 0.5 - mean) / sqrt(2 * mean)))
    return min(1.0, sum(exp(j * log(mean) - mean - lgamma(j + 1)) for j in range(int(k) + 1)))


def poisson_pmf(k: float, mean: float) -> float:
    if k < 0:
        return 0.0
    return exp(k * log(mean) - mean - lgamma(k + 1)) if mean > 0 else float(k == 0)


def poisson_inv(p: float, mean: float) -> int:
    """The least k with P(X <= k) >= p."""
    k = max(0, int(mean - 10 * sqrt(max(mean, 1))))
    while k and poisson_cdf(k, mean) >= p:
        k = max(0, k - 50)
    while poisson_cdf(k, mean) < p:
        k += 1
    return k


def hollow_window(spread: int, hollow: float = 0.6) -> np.ndarray:
    """Gaussian of ``spread`` bins, six spreads long, its middle lowered, of sum one."""
    x = np.arange(-3 * spread, 3 * spread + 1)
    w = np.exp(-0.5 * (x / spread) ** 2)
    w[3 * spread] *= 1 - hollow
    return w / w.sum()


def hollow_gaussian_test(counts: np.ndarray, spread: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(p-value, expected) of each bin: the counts convolved with the hollow window, ends mirrored;
    p is the Poisson tail with half the mass of the count itself."""
    w = hollow_window(spread)
    c = min(len(w), len(counts) - 1)
    padded = np.r_[counts[:c][::-1], counts, counts[::-1][:c]]
    expected = np.maximum(np.convolve(padded, w, "same")[c : c + len(counts)], 1e-12)
    p = np.array([1 - poisson_cdf(n - 1, m) - 0.5 * poisson_pmf(n, m) for n, m in zip(counts, expected, strict=True)])
    return p, expected


def link_candidates(counts: np.ndarray, half: int = 50, alpha: float = 0.001, spread: int = 5) -> np.ndarray:
    """Of each row of ``counts`` whether ``significant_links`` may give a link: behind zero lag a
    count whose probability is within the level, or an expectation that could miss a count."""
    c = min(6 * spread + 1, counts.shape[1] - 1)
    unit = np.eye(counts.shape[1])
    padded = np.hstack([unit[:, :c][:, ::-1], unit, unit[:, ::-1][:, :c]])
    w = hollow_window(spread)
    post = slice(half + 1, half + 5)
    kernel = np.array([np.convolve(row, w, "same")[c : c + len(unit)] for row in padded])[:, post]
    n, m = counts[:, post], np.maximum(counts @ kernel, 1e-12)
    level = alpha / 10 * (1 + 1e-6)  # for rounding
    factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, max(2, int(n.max(initial=0)) + 1))))]
    high = (n > 0) & (n * np.log(m) - m - factorial[n.astype(int)] <= np.log(level))
    return (high | (m >= -np.log(level))).any(axis=1)


def least_counts(half: int = 50, alpha: float = 0.001, spread: int = 5) -> tuple[float, int]:
    """Counts of a pair, and counts in one bin behind zero lag, of which one is reached by every row that
    ``link_candidates`` passes: an expectation is at most the sum of all counts, and a bin's own
    counts add to its expectation, so that one or two of them are no surprise."""
    level = alpha / 10 * (1 + 1e-6)
    w = hollow_window(spread)
    own, n = float(w[3 * spread]), 1
    while n * log(n * own) - n * own - lgamma(n + 1) > log(level) * 0.99:
        n += 1
    return -0.99 * log(level) / max(1.0, 2 * float(w.max())), n


def significant_links(counts: np.ndarray, half: int = 50, alpha: float = 0.001, spread: int = 5, near: tuple[float, float] = (0.8, 4.0)) -> int:
    """+1 for an excitatory, -1 for an inhibitory, 0 for no link from a to b: some bin behind zero
    lag lies beyond the bound around its expectation (Bonferroni over ten bins), and the extreme
    behind zero beats what the bins before zero allow."""
    _, expected = hollow_gaussian_test(counts, spread)
    level = alpha / 10
    post = np.arange(half + 1, half + 5)
    pre = np.arange(half - 4, half + 1)
    high = np.array([poisson_inv(1 - level, expected[k]) for k in post])
    low = np.array([poisson_inv(level, expected[k]) for k in post])
    sign = 0
    if (counts[post] > high).any() and counts[post].max() > poisson_inv(1 - alpha, counts[pre].max()):
        sign = 1
    if (counts[post] < low).any() and counts[post].min() < poisson_inv(alpha, counts[pre].mean()):
        sign = -1
    return sign


def tiling(a: np.ndarray, b: np.ndarray, dt: float, start: float, stop: float) -> float:
    """Spike-time tiling coefficient of two sorted trains, by brute force over pairs."""
    if not len(a) or not len(b):
        return float("nan")

    def cover(t: np.ndarray) -> float:
        edges, total, end = sorted((max(start, x - dt), min(stop, x + dt)) for x in t), 0.0, start
        for lo, hi in edges:
            total += max(0.0, hi - max(lo, end))
            end = max(end, hi)
        return total / (stop - start)

    pa = np.mean([np.abs(b - x).min() <= dt for x in a])
    pb = np.mean([np.abs(a - x).min() <= dt for x in b])
    ta, tb = cover(a), cover(b)
    return 0.5 * ((pa - tb) / (1 - tb * pa) + (pb - ta) / (1 - ta * pb))
