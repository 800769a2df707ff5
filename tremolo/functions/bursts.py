"""Burst kernels (NumPy only)."""

from __future__ import annotations

import numpy as np


def isi_n_bursts(t: np.ndarray, n: int, isi_n: float) -> list[tuple]:
    """(first time, last time, spikes) of bursts: runs of spikes that lie in some span of ``n``
    spikes no longer than ``isi_n``. A run is split where the span ending at a spike is too long
    and the run already has ``n`` spikes; a run that ends with fewer is dropped, but one still
    open at the end stays."""
    size = len(t)
    if size < n or n < 2:
        return []
    span = t[n - 1 :] - t[: size - n + 1]  # span[k] covers spikes k .. k+n-1
    least = np.full(size, np.inf)
    for k in range(n):
        least[n - 1 : size - n + 1] = np.minimum(least[n - 1 : size - n + 1], span[k : k + max(0, size - 2 * n + 2)])
    bursts: list[list[int]] = []
    running = False
    for i in range(n - 1, size):
        hit = least[i] <= isi_n
        if not running:
            if hit:
                bursts.append([i])
                running = True
        elif not hit:
            running = False
            if len(bursts[-1]) < n:
                bursts.pop()
        elif t[i] - t[i - n + 1] > isi_n and len(bursts[-1]) >= n:
            bursts.append([i])
        else:
            bursts[-1].append(i)
    return [(t[b[0]], t[b[-1]], len(b)) for b in bursts]


def lowess(y: np.ndarray, span: int) -> np.ndarray:
    """Locally weighted linear fit over ``span`` neighbours with tricube weights."""
    y = np.asarray(y, float)
    m = len(y)
    out = np.empty(m)
    span = max(2, min(span, m))
    for i in range(m):
        a = min(max(0, i - span // 2), m - span)
        x = np.arange(a, a + span) - i
        w = (1 - (np.abs(x) / (np.abs(x).max() + 1e-12)) ** 3).clip(0) ** 3 + 1e-12
        mx, my = np.average(x, weights=w), np.average(y[a : a + span], weights=w)
        v = np.average((x - mx) ** 2, weights=w)
        slope = np.average((x - mx) * (y[a : a + span] - my), weights=w) / v if v > 0 else 0.0
        out[i] = my - slope * mx
    return out


def find_peaks(y: np.ndarray) -> list[tuple[int, float, float]]:
    """(position, height, prominence) of inner local maxima, plateaus by their first sample."""
    y = np.asarray(y, float)
    out = []
    i = 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i] > y[i - 1] and j < len(y) - 1 and y[j + 1] < y[i]:
            higher = np.flatnonzero(y[:i] > y[i])
            left = y[(higher[-1] if len(higher) else 0) : i + 1].min()
            higher = np.flatnonzero(y[j + 1 :] > y[i])
            right = y[j : (j + 1 + higher[0] if len(higher) else len(y))].min()
            out.append((i, float(y[i]), float(y[i] - max(left, right))))
        i = j + 1
    return out


def valley_threshold(isi_ms: np.ndarray, step: float = 0.025, low: float = -3.0, high: float = 2.0, span: int = 15) -> float:
    """Milliseconds at the valley between the two most prominent peaks of the smoothed histogram
    of log intervals; 0 with fewer than two peaks."""
    edges = 10.0 ** np.arange(low, high + step / 2, step) * 1000
    count = np.histogram(isi_ms, edges)[0]
    smooth = lowess(count / max(1, count.sum()), span)
    peaks = sorted(find_peaks(smooth), key=lambda p: (-p[2], p[0]))[:2]
    if len(peaks) < 2:
        return 0.0
    a, b = sorted(p[0] for p in peaks)
    return float(edges[a + int(np.argmin(smooth[a : b + 1]))])


def triangle_threshold(counts: np.ndarray, side: str = "L") -> int:
    """Bin furthest from the chord between the top bin and the first (L) or last (R) used bin."""
    counts = np.asarray(counts, float)
    used = np.flatnonzero(counts)
    if not len(used):
        return 0
    top = int(np.argmax(counts))
    end = int(used[0] if side == "L" else used[-1])
    if top == end:
        return end
    x = np.arange(min(top, end), max(top, end) + 1)
    chord = counts[end] + (counts[top] - counts[end]) * (x - end) / (top - end)
    return int(x[np.argmax(chord - counts[x])])


def prune_burst(t: np.ndarray, start: float, stop: float, isi_n: float, bins: int = 200, min_width: float = 0.005) -> tuple[float, float]:
    """Burst limits drawn in to where the smoothed cumulative activity bends, from both sides;
    the old limits stay if the new ones are out of order or outside them."""
    pad = max(isi_n, (stop - start) / 2)
    a, b = start - pad, stop + pad
    inside = t[(t >= a) & (t <= b)]
    k = int(min(bins, max(1, (b - a) // min_width)))
    if k < 5 or not len(inside):
        return start, stop
    n, edges = np.histogram(inside, k, (a, b))
    s = np.maximum(lowess(n, max(3, k // 10)), 0)
    new_a = edges[triangle_threshold(np.cumsum(s), "L")]
    new_b = edges[k - triangle_threshold(np.cumsum(s[::-1]), "L")]
    ok = new_a < new_b and new_a >= a and new_b <= b and ((inside >= new_a) & (inside <= new_b)).sum() > 1
    return (float(max(new_a, start)), float(min(new_b, stop))) if ok and max(new_a, start) < min(new_b, stop) else (start, stop)
