"""Robust-pruned flat graph of one shard and range-expanding greedy search (NumPy only).

Vectors are rows of norm one; distance is 1 - cosine. The pruned lists are short; links back to
a row are all kept, so that a hub that many rows point to leads to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Graph:
    """Out-neighbours of every row, one list behind the other."""

    start: np.ndarray
    size: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(src: np.ndarray, to: np.ndarray, n: int) -> Graph:
        """The graph of links, each once."""
        flat = np.unique(src * n + to)
        size = np.bincount(flat // max(n, 1), minlength=n)
        return Graph(np.cumsum(size) - size, size, flat % max(n, 1))

    def links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, neighbour) of every neighbour of ``rows``."""
        size = self.size[rows]
        k = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        return k, self.near[self.start[rows][k] + place]


def medoid(unit: np.ndarray) -> int:
    return int(np.argmax(unit @ unit.mean(0)))


def robust_prune(unit: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row the candidates ``cand`` (-1: none; similarities ``sims``) that no chosen one is
    clearly nearer to, ``degree`` at most: a candidate leaves if alpha times its distance to a
    chosen neighbour is at most its distance to the node."""
    by = np.argsort(np.where(cand >= 0, -sims, np.inf), axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
    # A candidate that stands twice has equal similarities, so the second one stands behind.
    near = unit[np.maximum(cand, 0)]
    between = 1.0 - near @ near.transpose(0, 2, 1)
    alive = cand >= 0
    chosen = np.zeros(cand.shape, bool)
    room = np.full(len(cand), degree)
    for k in range(cand.shape[1]):
        take = alive[:, k] & (room > 0)
        chosen[:, k] = take
        room -= take
        gone = (alpha * between[:, k, :] <= 1.0 - sims) | (cand == cand[:, k : k + 1])
        alive &= ~(take[:, None] & gone)
    place = np.cumsum(chosen, axis=1) - 1
    out = np.full((len(cand), degree), -1, np.int64)
    r, c = np.nonzero(chosen)
    out[r, place[r, c]] = cand[r, c]
    return out


def beam(unit: np.ndarray, graph: Graph, queries: np.ndarray, starts: np.ndarray, threshold: float, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search with a beam of ``width`` rows from each query's ``starts``; in every round the
    ``step`` best rows that are not expanded yet are. Returns two tables (query x row): rows met,
    and rows met whose similarity is ``threshold`` or more, in the beam or not."""
    n, m, every = len(unit), len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((m, n), bool)
    inside = np.zeros((m, n), bool)
    cand = starts.astype(np.int64)
    sims = np.einsum("mkd,md->mk", unit[cand], queries)
    seen[every, cand] = True
    inside[every, cand] = sims >= threshold
    done = np.zeros(cand.shape, bool)
    while True:
        open_ = np.where(done, -np.inf, sims)
        take = min(step, open_.shape[1])
        best = np.argpartition(-open_, take - 1, axis=1)[:, :take]
        r, c = np.nonzero(np.isfinite(np.take_along_axis(open_, best, 1)))
        if not len(r):
            return seen, inside
        c = best[r, c]
        done[r, c] = True
        k, v = graph.links(cand[r, c])
        # Two expanded rows may hold the same neighbour: one of them is enough.
        flat = np.unique(r[k] * n + v)
        flat = flat[~seen.ravel()[flat]]
        r, v = flat // n, flat % n
        value = dots(unit, v, queries, r)
        seen[r, v] = True
        inside[r, v] = value >= threshold
        size = np.bincount(r, minlength=m)
        c = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        more_v = np.full((m, size.max(initial=0)), -1, np.int64)
        more_s = np.full(more_v.shape, -np.inf, unit.dtype)
        more_v[r, c], more_s[r, c] = v, value
        cand, sims, done = np.concatenate([cand, more_v], 1), np.concatenate([sims, more_s], 1), np.concatenate([done, more_v < 0], 1)
        if cand.shape[1] > width:
            keep = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            cand, sims, done = (np.take_along_axis(x, keep, 1) for x in (cand, sims, done))


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, piece: int = 65536) -> np.ndarray:
    """Products of rows i of a with rows j of b, in pieces."""
    return np.concatenate([np.einsum("kd,kd->k", a[i[s : s + piece]], b[j[s : s + piece]]) for s in range(0, max(1, len(i)), piece)])


def build(unit: np.ndarray, degree: int = 16, candidates: int = 32, alpha: float = 1.2, thin: int = 8, block: int = 512) -> Graph:
    """The graph of the rows of ``unit``. Each row's nearest rows are pruned robustly, then its
    nearest of every ``thin``-th row of a shuffled order, of every ``thin``-squared-th and so on:
    links of every length. Links are laid both ways. Vectors are compared with all others of the
    shard here, so the caller bounds a shard's rows."""
    n = len(unit)
    order = np.random.default_rng(11).permutation(n)
    scales = [np.arange(n)]
    while len(scales[-1]) > candidates:
        scales.append(np.sort(order[: -(-len(scales[-1]) // thin)]))
    src, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, block):
        rows = np.arange(at, min(n, at + block))
        for scale in scales:
            sims = unit[rows] @ unit[scale].T
            sims[rows[:, None] == scale[None, :]] = -np.inf
            take = min(candidates, len(scale))
            near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            value = np.take_along_axis(sims, near, 1)
            chosen = robust_prune(unit, np.where(np.isfinite(value), scale[near], -1), value, degree if len(scale) == n else degree // 4, alpha)
            r, c = np.nonzero(chosen >= 0)
            src.append(rows[r])
            to.append(chosen[r, c])
    a, b = np.concatenate(src), np.concatenate(to)
    return Graph.of(np.r_[a, b], np.r_[b, a], n)


def range_search(unit: np.ndarray, graph: Graph, queries: np.ndarray, entry: int, threshold: float, width: int = 32, block: int = 128):  # noqa: ANN201
    """Yields (query rows, rows found) in blocks: pairs with a similarity of ``threshold`` or more
    (a row with itself left out) that greedy search finds from the entry and from the query's own
    place, and that expanding every row in range, and the rows in range that this meets in turn,
    adds until none is new."""
    n = len(unit)
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        own = unit[q]
        seen, inside = beam(unit, graph, own, np.column_stack([np.full(len(q), entry), np.where(q == entry, (q + 1) % n, q)]), threshold, width)
        r, v = np.nonzero(inside)
        while len(r):
            k, w = graph.links(v)
            flat = np.unique(r[k] * n + w)
            flat = flat[~seen.ravel()[flat]]
            r, v = flat // n, flat % n
            seen[r, v] = True
            fine = dots(unit, v, own, r) >= threshold
            r, v = r[fine], v[fine]
            inside[r, v] = True
        inside[np.arange(len(q)), q] = False
        r, v = np.nonzero(inside)
        yield q[r], v
