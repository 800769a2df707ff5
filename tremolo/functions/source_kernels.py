"""Kernels over the arcs of one graph for a block of its nodes as sources (NumPy only).

Arcs stand sorted by their heads, so that a value moves along all arcs by one gather and one
``reduceat``; work and memory go by arcs times sources, never by nodes squared. Blocks are
independent: partial sums of all blocks give the values of the whole graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 1 << 21  # arcs times sources of one gather


class Arcs:
    """Arcs ``u -> v`` of weight ``w`` among ``n`` nodes; zeros are left out, and loops if not said."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, loops: bool = False):
        keep = (w != 0) & (loops | (u != v))
        order = np.lexsort((u[keep], v[keep]))
        self.n = n
        self.u, self.v, self.w = (x[keep][order] for x in (u, v, w))
        self.heads, first = np.unique(self.v, return_index=True)
        self.first = np.r_[first, len(self.v)]
        self._tails: tuple[np.ndarray, np.ndarray] | None = None

    def tails(self) -> tuple[np.ndarray, np.ndarray]:
        """The arcs by tail: where those of each node begin, and where each of them stands here."""
        if self._tails is None:
            order = np.lexsort((self.v, self.u))
            self._tails = np.r_[0, np.cumsum(np.bincount(self.u, minlength=self.n))], order
        return self._tails

    def pull(self, x: np.ndarray, op: np.ufunc, out: np.ndarray, term=None) -> np.ndarray:  # noqa: ANN001
        """``out[v]`` = ``op`` over the arcs into v of ``term(x[u], arcs)``, where v has any."""
        heads, first = self.heads, self.first
        most = max(1, CELLS // max(1, x.shape[1]))
        at = 0
        while at < len(heads):
            stop = max(at + 1, int(np.searchsorted(first, first[at] + most, "right")) - 1)
            arcs = slice(int(first[at]), int(first[stop]))
            got = x[self.u[arcs]]
            out[heads[at:stop]] = _runs(op, got if term is None else term(got, arcs), first[at:stop] - first[at])
            at = stop
        return out

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Words of bits or-ed over the arcs into each node; arcs from nodes without bits are passed by."""
        out = np.zeros_like(x)
        on = np.flatnonzero(x.any(1)[self.u])
        if not len(on):
            return out
        v = self.v[on]
        cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        out[v[cut]] = _runs(np.bitwise_or, x, cut, self.u[on])
        return out


def _runs(op: np.ufunc, x: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """``op`` over the runs of rows of ``x`` (of ``x[at]``) that begin at ``first``, whole rows at a time:
    the second of each run, the third of those that have one, and so on, while there are 64
    runs; then the rows left of each. ``reduceat`` goes down the columns, which is slow for wide rows."""
    if at is None and x.shape[1] < 8:
        return op.reduceat(x, first, axis=0)
    take = (lambda k: x[k]) if at is None else (lambda k: x[at[k]])
    size = np.diff(np.r_[first, len(x if at is None else at)])
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[order]
    got, turn, most = take(first), 1, max(1, CELLS // max(1, x.shape[1]))
    while (m := int(np.searchsorted(-size, -turn, "left"))) >= 64:
        got[:m] = op(got[:m], take(first[:m] + turn))
        turn += 1
    for k in range(m):
        for low in range(int(first[k]) + turn, int(first[k] + size[k]), most):
            got[k] = op(got[k], op.reduce(take(slice(low, min(low + most, int(first[k] + size[k])))), axis=0))
    out = np.empty_like(got)
    out[order] = got
    return out


def levels(g: Arcs, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth first from all sources at once, 64 of them to a word: each distance over 0 with the
    bits of the nodes (rows) that the sources (bits) reach there first."""
    k = np.arange(len(sources))
    front = np.zeros((g.n, (len(sources) + 63) // 64), np.uint64)
    front[sources, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    seen, step = front.copy(), 0
    while True:
        step += 1
        front = g.reach(front) & ~seen
        if not front.any():
            return
        seen |= front
        yield step, front


def met(front: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (source, node) of the set bits, some rows at a time."""
    rows = np.flatnonzero(front.any(1))
    for at in range(0, len(rows), max(1, CELLS // max(1, k))):
        part = rows[at : at + max(1, CELLS // max(1, k))]
        node, source = np.nonzero(np.unpackbits(front[part].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :k])
        yield source, part[node]


def _along(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of lists of ``size`` that begin at ``first``, one list after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _once(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each key once; ``mark`` is room for a number by key."""
    k = np.arange(len(key), dtype=mark.dtype)
    mark[key] = k
    return key[mark[key] == k]


def spans(g: Arcs, sources: np.ndarray) -> np.ndarray:
    """Shortest distances over lengths 1 / weight of positive arcs: sources by nodes. Nodes wait
    until the nearest that waits is a few arcs behind them, so that most are passed once."""
    first, order = g.tails()
    use = g.w[order] > 0
    head, length = g.v[order][use], 1.0 / g.w[order][use]
    first = np.r_[0, np.cumsum(use)][first]
    n, k, many = g.n, len(sources), np.diff(first)
    d = np.full(k * n, np.inf)
    near = np.arange(k) * n + sources
    d[near] = 0
    waits, mark = np.zeros(k * n, bool), np.zeros(k * n, np.int32)
    step = 4 * float(np.median(length)) if len(length) else 0.0
    while len(near):
        far = d[near]
        now = far <= far.min() + step
        at, far, near = near[now], far[now], near[~now]
        waits[at] = False
        node = at % n
        size = many[node]
        arcs = _along(first[node], size)
        to, new = np.repeat(at - node, size) + head[arcs], np.repeat(far, size) + length[arcs]
        less = np.flatnonzero(new < d[to])
        to = to[less]
        np.minimum.at(d, to, new[less])
        to = _once(to[~waits[to]], mark)
        waits[to] = True
        near = np.r_[near, to]
    return d.reshape(k, n)


def fewest(g: Arcs, sources: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Fewest edges of a path as short as ``d`` says: sources by nodes. Of paths that are equal but
    for rounding, the one of fewest edges counts."""
    n, k = g.n, len(sources)
    steps = np.full(k * n, np.inf)
    mark = np.zeros(k * n, np.int32)
    _, tail, head = _tight(g, d, 1e-12)
    ends = np.r_[0, np.cumsum(np.bincount(tail, minlength=k * n))]
    at, step = np.arange(k) * n + sources, 0
    while len(at):
        steps[at] = step
        size = ends[at + 1] - ends[at]
        to = head[_along(ends[at], size)]
        at, step = _once(to[np.isinf(steps[to])], mark), step + 1
    return steps.reshape(k, n)


def hop_rows(g: Arcs, sources: np.ndarray) -> np.ndarray:
    """Hop distances, sources by nodes; -1 where there is no path."""
    k = np.arange(len(sources))
    seen = np.zeros((g.n, (len(sources) + 63) // 64), np.uint64)
    seen[sources, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    planes: list[np.ndarray] = []
    for step, front in levels(g, sources):
        seen |= front
        planes += [np.zeros_like(seen) for _ in range(step.bit_length() - len(planes))]
        for bit, plane in enumerate(planes):
            if step >> bit & 1:
                plane |= front
    planes.append(~seen)  # all bits set, -1, where a source isn't met
    d = np.empty((len(k), g.n), np.int16 if len(planes) < 16 else np.int32)
    rows = max(1, CELLS // 8 // len(k))
    for low in range(0, g.n, rows):
        part = np.zeros((len(seen[low : low + rows]), len(k)), d.dtype)
        for bit, plane in enumerate(planes):
            was = np.unpackbits(plane[low : low + rows].astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(k))
            part |= was.astype(d.dtype) << bit if bit + 1 < len(planes) else -was.astype(d.dtype)
        d[:, low : low + rows] = part.T
    return d


def _tight(g: Arcs, d: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs on shortest paths by source and tail: their numbers in ``g.tails()``, tails and heads as
    places in ``d``, which holds whole numbers for arcs of length one."""
    order = g.tails()[1]
    u, v, w = g.u[order], g.v[order], g.w[order]
    with np.errstate(divide="ignore"):
        length = np.where(w > 0, 1.0 / np.where(w > 0, w, 1), np.inf)
    found = []
    for row in d:
        a, b = row[u], row[v]
        with np.errstate(invalid="ignore"):
            found.append(np.flatnonzero((np.abs(a + length - b) < room) & (b > a) if d.dtype == float else (a + 1 == b) & (a >= 0)))
    base = np.repeat(np.arange(len(d)) * g.n, [len(x) for x in found])
    arcs = np.concatenate(found)
    return arcs, u[arcs] + base, v[arcs] + base


def _depths(g: Arcs, d: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A number for each place in ``d`` that grows along arcs on shortest paths."""
    if d.dtype != float:
        return np.maximum(d, 0).ravel()
    least = 0.49 / g.w.max(initial=1e-300)  # half of the shortest arc
    most = d.max(where=np.isfinite(d), initial=0)
    if most < 4096 * least:
        return np.where(np.isfinite(d), d, 0).ravel() // least
    depth, left, mark = np.zeros(d.size, np.int64), np.bincount(head, minlength=d.size), np.zeros(d.size, np.int32)
    ends = np.r_[0, np.cumsum(np.bincount(tail, minlength=d.size))]
    at, step = np.flatnonzero((left == 0) & (np.diff(ends) > 0)), 0
    while len(at):
        depth[at] = step
        to = head[_along(ends[at], ends[at + 1] - ends[at])]
        np.subtract.at(left, to, 1)
        at, step = _once(to[left[to] == 0], mark), step + 1
    return depth


def brandes(g: Arcs, sources: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Betweenness of nodes and of the arcs of ``g``, from the shortest paths that start in
    ``sources``. Counts of paths go along the arcs that lie on shortest paths in the order of
    their distance, dependencies the same way back: each such arc is passed once."""
    node, edge = np.zeros(g.n), np.zeros(len(g.u))
    many = max(64, min(512, (1 << 26) // max(1, g.n)) // 64 * 64)
    few = max(1, CELLS // max(1, g.n))
    for at in range(0, len(sources), many):
        part = sources[at : at + many]
        hops = None if weighted else hop_rows(g, part)
        for low in range(0, len(part), few):
            now = part[low : low + few]
            x, y = _dependencies(g, now, spans(g, now) if weighted else hops[low : low + few])
            node += x
            edge += y
    return node, edge


def _dependencies(g: Arcs, sources: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = g.n, len(sources)
    arcs, tail, head = _tight(g, d, 1e-9)
    depth = _depths(g, d, tail, head)[head]
    order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
    arcs, tail, head, depth = arcs[order], tail[order], head[order], depth[order]
    cut = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]])
    waves = [slice(a, b) for a, b in zip(cut, [*cut[1:], len(depth)], strict=True)]
    start = np.arange(k) * n + sources
    sigma, delta, flow = np.zeros(k * n), np.zeros(k * n), np.zeros(len(arcs))
    sigma[start] = 1
    for now in waves:
        np.add.at(sigma, head[now], sigma[tail[now]])
    share = sigma[tail] / sigma[head]
    for now in reversed(waves):
        flow[now] = share[now] * (1 + delta[head[now]])
        np.add.at(delta, tail[now], flow[now])
    delta[start] = 0
    edge = np.zeros(len(g.u))
    edge[g.tails()[1]] = np.bincount(arcs, flow, len(g.u))
    return delta.reshape(k, n).sum(0), edge


# Queries: columns from the arcs, the ids of all nodes and the sources of a block. -----------------


def blocks(g: Arcs, sources: np.ndarray, most: int = 256, cells: int = 1 << 25) -> Iterator[np.ndarray]:
    """Sources in blocks for which arcs and nodes times sources stay in bounds."""
    size = max(1, min(most, cells // max(1, len(g.u) + g.n)))
    size -= size % 64 if size > 64 else 0
    return (sources[at : at + size] for at in range(0, len(sources), size))


def distance_wei(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    for part in blocks(g, sources, cells=4 * CELLS):
        d = spans(g, part)
        steps = fewest(g, part, d)
        d[np.arange(len(part)), part] = np.inf
        source, node = np.nonzero(np.isfinite(d))
        yield ids[part[source]], ids[node], d[source, node], steps[source, node]


def inverse_distances(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    """Sum of inverse weighted distances from the sources, and the nodes of the graph."""
    total = 0.0
    for part in blocks(g, sources, cells=4 * CELLS):
        d = spans(g, part)
        d[np.arange(len(part)), part] = np.inf
        total += (1.0 / d).sum()
    yield [total], [len(sources)]


def hop_statistics(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    """Pairs reached, sums of their distances and of the inverse, least and largest eccentricity."""
    reached, total, inverse = 0, 0, 0.0
    low, high = np.inf, 0
    for part in blocks(g, sources, 1024, 1 << 29):
        ecc = np.zeros(len(part))
        for step, front in levels(g, part):
            n = int(np.bitwise_count(front).sum())
            reached, total, inverse = reached + n, total + n * step, inverse + n / step
            any_ = np.bitwise_or.reduce(front, axis=0)
            ecc[np.unpackbits(any_.astype("<u8").view(np.uint8), bitorder="little")[: len(part)] > 0] = step
        low, high = min(low, ecc.min()), max(high, ecc.max())
    yield [reached], [total], [inverse], [float(low)], [float(high)], [len(sources)]


def hop_pairs(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    """Hop distances to all nodes reached, the source itself included. The distances of a block stand
    in planes, a bit of the number in each, and are read out once, by node: then the sources of a
    block come round again and again, which takes little room in files."""
    size = max(64, min(1024, (1 << 27) // max(1, g.n)) // 64 * 64)
    for at in range(0, len(sources), size):
        part = sources[at : at + size]
        k = np.arange(len(part))
        seen = np.zeros((g.n, (len(part) + 63) // 64), np.uint64)
        seen[part, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        planes: list[np.ndarray] = []
        for step, front in levels(g, part):
            seen |= front
            planes += [np.zeros_like(seen) for _ in range(step.bit_length() - len(planes))]
            for bit, plane in enumerate(planes):
                if step >> bit & 1:
                    plane |= front

        def bits(x: np.ndarray) -> np.ndarray:
            return np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(k))  # noqa: B023

        rows = max(1, CELLS // 8 // len(part))
        for low in range(0, g.n, rows):
            now = slice(low, low + rows)
            node, source = np.nonzero(bits(seen[now]))
            d = np.zeros((len(seen[now]), len(part)), np.int32)
            for bit, plane in enumerate(planes):
                d |= bits(plane[now]).astype(np.int32) << bit
            yield ids[part][source], ids[now][node], d[node, source]


def betweenness(g: Arcs, ids: np.ndarray, sources: np.ndarray, weighted: bool = False) -> Iterator[tuple]:
    yield ids, brandes(g, sources, weighted)[0]


def edge_betweenness(g: Arcs, ids: np.ndarray, sources: np.ndarray, weighted: bool = False) -> Iterator[tuple]:
    yield ids[g.u], ids[g.v], brandes(g, sources, weighted)[1]


def edge_range(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    """Distance between the ends of each arc that starts in a source once it is taken out; over 2
    it is a shortcut. Most arcs have a node between their ends; of the others, frontiers from
    both ends meet."""
    out: list[list[int]] = [[] for _ in range(g.n)]
    into: list[list[int]] = [[] for _ in range(g.n)]
    for x, y in zip(g.u.tolist(), g.v.tolist(), strict=True):
        out[x].append(y)
        into[y].append(x)
    tails = [set(x) for x in out]
    heads = [set(x) for x in into]
    rows = []
    for i in sources.tolist():
        for j in out[i]:
            if not tails[i].isdisjoint(heads[j]):
                rows.append((i, j, 2.0))
                continue
            # The arc itself is left out: j is no first step from i, i no last step to j.
            left, right = tails[i] - {j}, heads[j] - {i}
            seen_l, seen_r, d = left | {i}, right | {j}, 2
            while left and right and left.isdisjoint(right):
                if len(left) <= len(right):
                    left = set().union(*(tails[x] for x in left)) - seen_l
                    seen_l |= left
                else:
                    right = set().union(*(heads[x] for x in right)) - seen_r
                    seen_r |= right
                d += 1
            rows.append((i, j, float(d) if left and right else np.inf))
    i, j, d = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    yield ids[i], ids[j], d, d > 2


# Kernels of a whole graph: the sources are all its nodes. -----------------------------------------

def walks(g: Arcs, ids: np.ndarray, sources: np.ndarray, q: int = 4) -> Iterator[tuple]:
    """Walks of 1 to q steps between all nodes."""
    x, out = np.ones((g.n, 1)), []
    for _ in range(q):
        x = g.pull(x, np.add, np.zeros_like(x))
        out.append(float(x.sum()))
    yield list(range(1, q + 1)), out


def eigenvector_centrality(g: Arcs, ids: np.ndarray, sources: np.ndarray, dense: int = 2000, basis: int = 100, tol: float = 1e-10) -> Iterator[tuple]:
    """Absolute values of the leading eigenvector of the symmetric part, by restarted Lanczos with
    whole reorthogonalisation; up to ``dense`` nodes by a decomposition."""
    both = Arcs(g.n, np.r_[g.u, g.v], np.r_[g.v, g.u], np.r_[g.w, g.w] / 2, loops=True)
    if g.n <= dense:
        a = np.zeros((g.n, g.n))
        np.add.at(a, (both.u, both.v), both.w)
        yield ids, np.abs(np.linalg.eigh(a)[1][:, -1])
        return
    times = lambda x: np.bincount(both.v, both.w * x[both.u], g.n)
    x = np.random.default_rng(0).random(g.n) + 0.5
    for _ in range(1000):
        x /= np.linalg.norm(x)
        q, alpha, beta = [x], [], []
        while True:
            y = times(q[-1])
            alpha.append(float(y @ q[-1]))
            at = np.array(q)
            for _ in range(2):
                y = y - at.T @ (at @ y)
            norm = float(np.linalg.norm(y))
            if len(q) == min(basis, g.n) or norm <= 1e-14 * max(1.0, abs(alpha[0])):
                break
            beta.append(norm)
            q.append(y / norm)
        val, vec = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        x = at.T @ vec[:, -1]
        if np.linalg.norm(times(x) - val[-1] * x) <= tol * max(abs(val[0]), abs(val[-1]), 1e-300):
            yield ids, np.abs(x) / np.linalg.norm(x)
            return
    raise RuntimeError("the leading eigenvector did not converge")


def _shared(n: int, a: np.ndarray, b: np.ndarray, one: tuple, two: tuple) -> int:
    """Sum over the arcs (a, b) of the nodes that stand in list a of ``one`` and in list b of ``two``;
    lists are (starts, nodes), and arcs sorted by a. Lists a are marked, some at a time."""
    size = np.diff(two[0])[b]
    ends = np.r_[0, np.cumsum(size)]
    nodes, first = np.unique(a, return_index=True)
    first = np.r_[first, len(a)]
    width = max(1, CELLS // max(1, n))
    mark, at, found = np.zeros(width * n, bool), 0, 0

    def along(lists: tuple, which: np.ndarray, length: np.ndarray) -> np.ndarray:
        return lists[1][np.arange(length.sum()) + np.repeat(lists[0][which] - (np.cumsum(length) - length), length)]

    while at < len(nodes):
        stop = min(at + width, max(at + 1, int(np.searchsorted(ends[first], ends[first[at]] + CELLS, "right")) - 1), len(nodes))
        part, arcs = nodes[at:stop], slice(int(first[at]), int(first[stop]))
        length = np.diff(one[0])[part]
        marked = np.repeat(np.arange(len(part)) * n, length) + along(one, part, length)
        mark[marked] = True
        row = np.repeat(np.arange(len(part)), np.diff(first[at : stop + 1])) * n
        found += int(np.count_nonzero(mark[np.repeat(row, size[arcs]) + along(two, b[arcs], size[arcs])]))
        mark[marked] = False
        at = stop
    return found


def paths(g: Arcs, ids: np.ndarray, sources: np.ndarray, q: int = 3) -> Iterator[tuple]:
    """Simple paths and cycles by number of edges up to q, and the share of cycles; up to three edges
    by degrees and triangles, without walking them."""
    found, cycles = [0] * (max(q, 3) + 1), [0] * (max(q, 3) + 1)
    if q <= 3:
        order = np.lexsort((g.v, g.u))
        leaves, comes = np.bincount(g.u, minlength=g.n), np.bincount(g.v, minlength=g.n)
        out, into = (np.r_[0, np.cumsum(leaves)], g.v[order]), (np.r_[0, np.cumsum(comes)], g.u)
        name, turned = g.u[order] * g.n + g.v[order], g.v * g.n + g.u  # both sorted
        both = np.isin(name, turned, assume_unique=True, kind="sort") if len(name) else np.zeros(0, bool)
        back = np.bincount(g.u[order][both], minlength=g.n)  # neighbours both ways
        # Walks of two and three edges less those that meet a node again; a triangle is three closed
        # walks. From each arc the shorter list is looked up in the longer one, which is marked.
        low = leaves[g.v[order]] <= comes[g.u[order]]
        high = leaves[g.v] > comes[g.u]
        triangles = _shared(g.n, g.u[order][low], g.v[order][low], into, out) + _shared(g.n, g.v[high], g.u[high], out, into)
        found[1] = len(g.u)
        cycles[2] = int(back.sum())
        found[2] = int((comes * leaves).sum()) - cycles[2]
        cycles[3] = triangles
        found[3] = int((comes[g.u] * leaves[g.v]).sum()) - int((back * leaves).sum()) - int((comes * back).sum()) + cycles[2] - triangles
    else:
        near: list[list[int]] = [[] for _ in range(g.n)]
        for x, y in zip(g.u.tolist(), g.v.tolist(), strict=True):
            near[x].append(y)
        stack = [(s, (s,)) for s in range(g.n)]
        while stack:
            v, seen = stack.pop()
            for u in near[v]:
                if u == seen[0] and len(seen) > 1:
                    cycles[len(seen)] += 1
                elif u not in seen:
                    found[len(seen)] += 1
                    if len(seen) < q:
                        stack.append((u, (*seen, u)))
    k = list(range(1, q + 1))
    yield k, [float(found[x]) for x in k], [float(cycles[x]) for x in k], [cycles[x] / (cycles[x] + found[x]) if cycles[x] + found[x] else 0.0 for x in k]


def latticised(g: Arcs, ids: np.ndarray, sources: np.ndarray, rng=None, iterations: int = 5) -> Iterator[tuple]:  # noqa: ANN001
    """Degree-preserving rewiring of an undirected graph that only accepts swaps that don't lengthen
    edges on the ring of nodes. Swaps are drawn in blocks and judged at once; one by one, on the
    links as they are then, go those that may be accepted and those of a link that may have moved;
    where another link moves, the rest of the block is judged anew."""
    n = g.n
    once = np.flatnonzero(g.u < g.v)
    once = once[np.lexsort((g.v[once], g.u[once]))]
    i, j, w = g.u[once], g.v[once], g.w[once]
    k, done = len(i), 0
    tries = int(round(n * k / max(1, n * (n - 1)))) + 1
    there = set((i * n + j).tolist())

    def ring(x, y):  # noqa: ANN001, ANN202
        d = abs(x - y)
        return np.minimum(d, n - d)

    def short(x: int, y: int) -> int:
        return min(abs(x - y), n - abs(x - y))

    # A round ends with a swap, or after so many draws in vain; ``past`` draws of it are over.
    rounds, past = iterations * k if k > 1 else 0, 0
    maybe = np.zeros(k, bool)
    draws: list[np.ndarray] = [np.zeros(0, int)] * 3
    while rounds > 0:
        size = len(draws[0])
        if not size:
            size = min(max(64, int(k**0.5)), rounds * tries - past)
            draws = [rng.integers(0, k, size), rng.integers(0, k, size), rng.random(size) < 0.5]
        x, y, turn = draws
        p, q, u, v, a, b = i[x], j[x], np.where(turn, j[y], i[y]), np.where(turn, i[y], j[y]), w[x], w[y]
        fits = (p != u) & (p != v) & (q != u) & (q != v) & (ring(p, q) * a + ring(u, v) * b >= ring(p, v) * a + ring(u, q) * b)
        maybe[x[fits]] = maybe[y[fits]] = True
        look = np.flatnonzero(maybe[x] | maybe[y])
        sure = maybe[x[look]] & maybe[y[look]]
        maybe[x[fits]] = maybe[y[fits]] = False
        moved: dict[int, tuple[int, int]] = {}
        start = -past
        for at, known, x, y, turn, p, q, u, v, a, b, fit in zip(*(c.tolist() for c in (look, sure, *(c[look] for c in (x, y, turn, p, q, u, v, a, b, fits)))), strict=True):
            if x in moved or y in moved:
                p, q = moved.get(x, (p, q))
                if y in moved:
                    u, v = moved[y][::-1] if turn else moved[y]
                fit = not (p == u or p == v or q == u or q == v) and short(p, q) * a + short(u, v) * b >= short(p, v) * a + short(u, q) * b
            if not fit:
                continue
            new, other = (p * n + v if p < v else v * n + p), (u * n + q if u < q else q * n + u)
            if new in there or other in there:
                continue
            rounds -= (at - start) // tries
            if rounds <= 0:
                break
            there.remove(p * n + q if p < q else q * n + p)
            there.remove(u * n + v if u < v else v * n + u)
            there.add(new)
            there.add(other)
            moved[x], moved[y] = (p, v), (u, q)
            done, rounds, start = done + 1, rounds - 1, at + 1
            if not known:
                size = at + 1
                break
        if moved:
            links, ends = np.array(list(moved)), np.array(list(moved.values()))
            i[links], j[links] = ends[:, 0], ends[:, 1]
        rounds, past = rounds - (size - start) // tries, (size - start) % tries
        draws = [c[size:] for c in draws]
    src, dst, w = np.r_[i, j], np.r_[j, i], np.r_[w, w]
    order = np.lexsort((dst, src))
    yield ids[src[order]], ids[dst[order]], w[order], np.full(len(order), done)


def grown(n: int, rng: np.random.Generator, eta: float, gamma: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges added one by one with probability distance^eta times matching^gamma (ring distances). An
    edge only changes the weights of pairs with one of its ends, or of one end and a neighbour of
    the other: the rows and columns of its ends. A pair is drawn by row, then in the row. Weights
    are held of nodes with edges alone; all others go by distance."""
    far = np.arange(n)
    d = np.maximum(1, np.minimum(far, n - far)) ** float(eta)  # by difference of places
    plain = d * 0.01**gamma
    rows = np.r_[0.0, np.cumsum(plain[1:])][::-1].copy() if n else np.zeros(0)
    deg, near = np.zeros(n), {}
    slot, ends = np.full(n, -1), np.zeros(0, int)  # of nodes with edges
    held = np.zeros((0, n))

    def weights(z: int) -> np.ndarray:
        if slot[z] >= 0:
            return held[slot[z]]
        out = plain[np.abs(far - z)]
        out[ends] = held[: len(ends), z]
        return out

    for _ in range(min(k, n * (n - 1) // 2)):
        while True:
            cdf = np.cumsum(rows)
            u = rng.random() * cdf[-1]
            x = min(int(np.searchsorted(cdf, u, "right")), n - 1)
            line = np.cumsum(weights(x)[x + 1 :])
            if len(line) and line[-1] > 0:
                break
            rows[x] = 0  # nothing was left of the row but rounding
        y = x + 1 + int(np.searchsorted(line, min(u - (cdf[x] - rows[x]), np.nextafter(line[-1], 0)), "right"))
        for z, other in ((x, y), (y, x)):
            near.setdefault(z, []).append(other)
            deg[z] += 1
        for z in (x, y):
            both = np.bincount(np.concatenate([near[v] for v in near[z]]), minlength=n)  # paths of two edges
            new = d[np.abs(far - z)] * (both / np.maximum(1, deg[z] + deg - both) + 0.01) ** gamma
            new[near[z]] = 0
            rows[:z] += new[:z] - weights(z)[:z]
            if slot[z] < 0:
                slot[z], ends = len(ends), np.r_[ends, z]
                if len(ends) > len(held):
                    held = np.vstack([held, np.zeros((min(n, max(16, 2 * len(held))) - len(held), n))])
            held[slot[z]] = new
            held[: len(ends), z] = new[ends]
        for z in (x, y):
            rows[z] = held[slot[z], z + 1 :].sum()
        rows[rows < 0] = 0
    x, y = (np.array(c, int) for c in zip(*sorted((x, y) for x in near for y in near[x] if x < y), strict=True)) if near else (np.zeros(0, int),) * 2
    return x, y


def generative_model(g: Arcs, ids: np.ndarray, sources: np.ndarray, rng=None, eta: float = -1.0, gamma: float = 0.5, k: int = 60) -> Iterator[tuple]:  # noqa: ANN001
    x, y = grown(g.n, rng, eta, gamma, k)
    yield ids[x], ids[y]


def subgraph_centrality(g: Arcs, ids: np.ndarray, sources: np.ndarray) -> Iterator[tuple]:
    """Diagonal of the exponential of the symmetric pattern: the squared length of each source's
    column of exp(B / 2). All terms of its series are positive, so their sum is exact but for
    rounding."""
    pairs = np.unique(np.stack([np.r_[g.u, g.v], np.r_[g.v, g.u]]), axis=1) if len(g.u) else np.zeros((2, 0), int)
    both = Arcs(g.n, pairs[0], pairs[1], np.ones(pairs.shape[1]), loops=True)
    for part in blocks(both, sources, 64):
        term = np.zeros((g.n, len(part)))
        term[part, np.arange(len(part))] = 1
        total, k = term.copy(), 0
        while True:
            k += 1
            term = both.pull(term, np.add, np.zeros_like(term)) / (2 * k)
            total += term
            if (term.max(0) <= 1e-17 * total.max(0)).all():
                break
        yield ids[part], (total**2).sum(0)
