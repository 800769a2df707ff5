"""Correlogram counts of sorted spike trains (NumPy only).

All spikes of a recording stand in one order of time; partners of a spike are a range of it. The
rows of a unit come from its own spikes alone, so units can be dealt out and nothing is summed up
between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

PAIRS = 1 << 20  # spike pairs of a step


class Trains:
    """Spikes as recording, unit (both numbers from 0) and tick, in order of recording and tick."""

    def __init__(self, rec: np.ndarray, unit: np.ndarray, tick: np.ndarray):
        order = np.lexsort((unit, tick, rec))
        self.unit, self.tick = unit[order].astype(np.int32), tick[order]
        self.n_units = int(unit.max()) + 1 if len(unit) else 0
        self.bounds = np.searchsorted(rec[order], np.arange(int(rec.max()) + 2 if len(rec) else 1))


def counts(t: Trains, mine: np.ndarray, bin: float, half: int, apart: bool = True) -> Iterator[tuple]:  # noqa: A002
    """(recording, a, b, lag bin, n) of the units ``mine`` as a, a pair's rows together; summed over
    recordings, which are then 0, unless ``apart``, and then by lag before b, which takes less room
    in files. The window behind a spike is open, that before it closed, half-bin ties round down."""
    own = np.flatnonzero(mine[t.unit]) if len(t.unit) else np.zeros(0, int)
    rec = np.searchsorted(t.bounds, own, "right") - 1
    low, high = np.zeros(len(own), int), np.zeros(len(own), int)
    reach = bin * (half + 0.5)
    for r in range(len(t.bounds) - 1):
        at, ticks = np.flatnonzero(rec == r), t.tick[t.bounds[r] : t.bounds[r + 1]]
        low[at] = np.searchsorted(ticks, t.tick[own[at]] - reach, "right") + t.bounds[r]
        high[at] = np.searchsorted(ticks, t.tick[own[at]] + reach, "right") + t.bounds[r]
    order = np.lexsort((t.unit[own], rec)) if apart else np.argsort(t.unit[own], kind="stable")
    own, rec, low, high = (x[order] for x in (own, rec, low, high))
    group = (rec if apart else 0) * t.n_units + t.unit[own].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    ends = np.r_[0, np.cumsum(high - low)]
    stops = np.r_[starts[1:], len(own)]
    lags, k = 2 * half + 1, 0

    def tally(part: slice) -> tuple[np.ndarray, np.ndarray]:
        n = high[part] - low[part]
        o = np.repeat(own[part], n)
        s = np.arange(len(o)) + np.repeat(low[part] - (np.cumsum(n) - n), n)
        lag = (half - np.floor(0.5 + (t.tick[o] - t.tick[s]) / float(bin))).astype(np.int64)
        name = np.repeat(np.cumsum(np.r_[0, group[part][1:] != group[part][:-1]]), n)
        key = (name * t.n_units + t.unit[s]) * lags + lag if apart else (name * lags + lag) * t.n_units + t.unit[s]
        return np.unique(key[o != s], return_counts=True)

    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends[stops], ends[starts[k]] + PAIRS, "right")))
        at, last = int(starts[k]), int(stops[stop - 1])
        key, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < last:  # a unit of more pairs than a step has takes several, and its counts are added up
            to = min(last, max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1)) if stop == k + 1 else last
            more, n = tally(slice(at, to))
            if len(key):
                more, where = np.unique(np.r_[key, more], return_inverse=True)
                n = np.bincount(where, np.r_[found, n]).astype(np.int64)
            key, found, at = more, n, to
        pair, last = np.divmod(key, lags if apart else t.n_units)
        name, first = np.divmod(pair, t.n_units if apart else lags)
        b, lag = (first, last) if apart else (last, first)
        which = group[starts[k:stop]][name]
        yield which // t.n_units, which % t.n_units, b, (lag - half).astype(np.int32), found
        k = stop


def grid(t: Trains, mine: np.ndarray, bin: float, half: int) -> Iterator[tuple]:  # noqa: A002
    """(recording, a, b, lag bin, n, rate) of the units ``mine`` as a with all units of their
    recordings, zeros included; rates are rounded to nine digits, halves up."""
    lags = 2 * half + 1
    present = [np.unique(t.unit[lo:hi], return_counts=True) for lo, hi in zip(t.bounds, t.bounds[1:], strict=False)]

    def full(r: int, a: int, b: np.ndarray, lag: np.ndarray, n: np.ndarray) -> tuple:
        units, spikes = present[r]
        out = np.zeros(len(units) * lags, np.int64)
        out[np.searchsorted(units, b) * lags + lag + half] = n
        scale = int(spikes[np.searchsorted(units, a)]) * bin / 1e6
        rates = np.array([float(Decimal(repr(x / scale)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x in range(int(out.max()) + 1)])
        return np.full(len(out), r), np.full(len(out), a), np.repeat(units, lags), np.tile(np.arange(-half, half + 1, dtype=np.int32), len(units)), out, rates[out]

    left = {(r, int(a)) for r, (units, _) in enumerate(present) for a in units[mine[units]]}
    for rec, a, b, lag, n in counts(t, mine, bin, half):
        if not len(rec):
            continue
        cut = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (a[1:] != a[:-1])])
        for lo, hi in zip(cut, np.r_[cut[1:], len(rec)], strict=True):
            left.discard((int(rec[lo]), int(a[lo])))
            yield full(int(rec[lo]), int(a[lo]), b[lo:hi], lag[lo:hi], n[lo:hi])
    none = np.zeros(0, np.int64)
    for r, a in sorted(left):
        yield full(r, a, none, none, none)


def likely(t: Trains, mine: np.ndarray, bin: float, half: int, total: float, near: float) -> Iterator[tuple]:  # noqa: A002
    """The rows of ``counts`` of pairs of two units with at least ``total`` counts, or ``near`` of them in
    the four bins behind zero lag: pairs are counted without lags first."""
    own = np.flatnonzero(mine[t.unit]) if len(t.unit) else np.zeros(0, int)
    rec = np.searchsorted(t.bounds, own, "right") - 1
    edge = np.zeros((4, len(own)), int)
    reach = bin * (half + 0.5)
    for r in range(len(t.bounds) - 1):
        at, ticks = np.flatnonzero(rec == r), t.tick[t.bounds[r] : t.bounds[r + 1]]
        o = t.tick[own[at]]
        for k, (far, side) in enumerate(((-reach, "right"), (reach, "right"), (0.5 * bin, "left"), (4.5 * bin, "right"))):
            edge[k, at] = np.searchsorted(ticks, o + far, side) + t.bounds[r]
    order = np.lexsort((t.unit[own], rec))
    own, rec, edge = own[order], rec[order], edge[:, order]
    unit = t.unit[own]
    starts = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (unit[1:] != unit[:-1])][: len(own)])

    def partners(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the spikes and of their partners, some at a time."""
        ends, k = np.r_[0, np.cumsum(high - low)], 0
        while k < len(low):
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] + PAIRS, "right")) - 1)
            n = high[k:stop] - low[k:stop]
            yield np.repeat(np.arange(k, stop), n), np.arange(ends[k], ends[stop]) + np.repeat(low[k:stop] - ends[k:stop], n)
            k = stop

    for lo, hi in zip(starts, np.r_[starts[1:], len(own)][: len(starts)], strict=True):
        low, high, after, until = edge[:, lo:hi]
        may = np.zeros(t.n_units, bool)
        for least, a, b in ((total, low, high), (near, after, until)):
            if (b - a).sum() >= least:
                may |= sum(np.bincount(t.unit[s], minlength=t.n_units) for _, s in partners(a, b)) >= least
        may[unit[lo]] = False
        if not may.any():
            continue
        key = []
        for o, s in partners(low, high):
            on = may[t.unit[s]]
            o, s = own[lo:hi][o[on]], s[on]
            key.append(t.unit[s].astype(np.int64) * (2 * half + 1) + half - np.floor(0.5 + (t.tick[o] - t.tick[s]) / float(bin)).astype(np.int64))
        key, n = np.unique(np.concatenate(key), return_counts=True)
        b, lag = np.divmod(key, 2 * half + 1)
        yield np.full(len(b), rec[lo]), np.full(len(b), unit[lo]), b, (lag - half).astype(np.int32), n
