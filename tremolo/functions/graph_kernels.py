"""Matrix kernels for single graphs (NumPy only).

A kernel takes an adjacency matrix, the node ids, a random generator and parameters, and returns
columns. Node-wise kernels return (ids, value, ...); graph-wise ones return lists of one value.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np

from . import source_kernels
from .source_kernels import Arcs

INF = np.inf


def arcs(a: np.ndarray) -> Arcs:
    i, j = np.nonzero(a)
    return Arcs(len(a), i, j, a[i, j])


def _gathered(kernel, a: np.ndarray, ids: np.ndarray, **params) -> tuple:  # noqa: ANN001, ANN003
    """A kernel by sources over all sources of a matrix."""
    parts = list(kernel(arcs(a), np.asarray(ids), np.arange(len(a)), **params))
    return tuple(np.concatenate([np.asarray(x) for x in column]) for column in zip(*parts, strict=True)) if parts else ([],) * 4


# Distances -------------------------------------------------------------------------------------

def hops(a: np.ndarray) -> np.ndarray:
    """Hop distances of all pairs by expanding frontiers of all sources at once."""
    b = a != 0
    n = len(b)
    d = np.where(np.eye(n, dtype=bool), 0.0, INF)
    front, step = np.eye(n, dtype=bool), 0
    while front.any():
        step += 1
        front = ((front.astype(np.float32) @ b) > 0) & np.isinf(d)
        d[front] = step
    return d


def lengths(a: np.ndarray) -> np.ndarray:
    """Edge lengths as inverse weights; no edge is infinitely long."""
    with np.errstate(divide="ignore"):
        out = np.where(a > 0, 1.0 / np.where(a > 0, a, 1), INF)
    np.fill_diagonal(out, 0)
    return out


def floyd(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest distances, edges on the path and next node on it, of all pairs."""
    n = len(length)
    d = length.copy()
    nxt = np.where(np.isfinite(d), np.arange(n)[None, :], -1)
    steps = np.where(np.isfinite(d) & ~np.eye(n, dtype=bool), 1, 0)
    for k in range(n):
        via = d[:, k, None] + d[None, k, :]
        better = via < d - 1e-12
        d = np.where(better, via, d)
        steps = np.where(better, steps[:, k, None] + steps[None, k, :], steps)
        nxt = np.where(better, nxt[:, k, None], nxt)
    return d, steps, nxt


def path(nxt: np.ndarray, i: int, j: int) -> list[int]:
    """Nodes on the shortest path, ends included; empty without one."""
    if nxt[i, j] < 0:
        return []
    out = [i]
    while i != j:
        i = int(nxt[i, j])
        out.append(i)
    return out


def distance_wei(a, ids, rng):  # noqa: ANN001, ANN201
    return _gathered(source_kernels.distance_wei, a, ids)


def _inverse_mean(d: np.ndarray) -> float:
    n = len(d)
    if n < 2:
        return 0.0
    with np.errstate(divide="ignore"):
        e = np.where(np.eye(n, dtype=bool), 0, 1.0 / d)
    return float(e.sum() / (n * n - n))


def global_efficiency(a, ids, rng, weighted=False):  # noqa: ANN001, ANN201
    if not weighted:
        return ([_inverse_mean(hops(a))],)
    n = len(a)
    return ([float(_gathered(source_kernels.inverse_distances, a, ids)[0][0]) / (n * n - n) if n > 1 else 0.0],)


def local_efficiency(a, ids, rng, weighted=False):  # noqa: ANN001, ANN201
    """Efficiency of the subgraph of each node's neighbours; the weighted form takes cube roots of
    the weights to the node and of the inverse distances."""
    out = np.zeros(len(a))
    for u in range(len(a)):
        near = np.flatnonzero((a[u] != 0) | (a[:, u] != 0))
        near = near[near != u]
        if len(near) < 2:
            continue
        sub = a[np.ix_(near, near)]
        with np.errstate(divide="ignore"):
            e = 1.0 / (floyd(lengths(sub))[0] if weighted else hops(sub))
        np.fill_diagonal(e, 0)
        s = np.cbrt(a[u, near]) + np.cbrt(a[near, u]) if weighted else (a[u, near] != 0) * 1.0 + (a[near, u] != 0)
        e = np.cbrt(e) if weighted else e
        flat = (a[u, near] != 0) * 1.0 + (a[near, u] != 0)
        top = (np.outer(s, s) * (e + e.T)).sum() / 2
        base = flat.sum() ** 2 - (flat**2).sum()
        out[u] = top / base if base else 0.0
    return ids, out


def characteristic_path(a, ids, rng):  # noqa: ANN001, ANN201
    """Mean finite distance, efficiency, radius and diameter."""
    d = hops(a)
    off = d[~np.eye(len(d), dtype=bool)]
    fin = off[np.isfinite(off)]
    ecc = np.where(np.isfinite(d), d, -1).max(1)
    return [float(fin.mean()) if len(fin) else 0.0], [_inverse_mean(d)], [float(ecc.min())], [float(ecc.max())]


def edge_range(a, ids, rng):  # noqa: ANN001, ANN201
    return _gathered(source_kernels.edge_range, a, ids)


# Centrality ------------------------------------------------------------------------------------

def _brandes(a: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge betweenness, directed counts."""
    g = arcs(a)
    node, edge = source_kernels.brandes(g, np.arange(len(a)), weighted)
    out = np.zeros(a.shape)
    out[g.u, g.v] = edge
    return node, out


def betweenness(a, ids, rng, weighted=False):  # noqa: ANN001, ANN201
    return ids, _brandes(a, weighted)[0]


def edge_betweenness(a, ids, rng, weighted=False):  # noqa: ANN001, ANN201
    e = _brandes(a, weighted)[1]
    i, j = np.nonzero(a)
    return ids[i], ids[j], e[i, j]


def eigenvector_centrality(a, ids, rng):  # noqa: ANN001, ANN201
    return ids, np.abs(np.linalg.eigh((a + a.T) / 2)[1][:, -1])


def pagerank(a, ids, rng, damping=0.85):  # noqa: ANN001, ANN201
    n = len(a)
    deg = a.sum(0)
    deg[deg == 0] = 1
    r = np.linalg.solve(np.eye(n) - damping * a / deg[None, :], np.full(n, (1 - damping) / n))
    return ids, r / r.sum()


def subgraph_centrality(a, ids, rng):  # noqa: ANN001, ANN201
    val, vec = np.linalg.eigh(((a + a.T) != 0).astype(float))
    return ids, (vec**2) @ np.exp(val)


def mean_first_passage(a, ids, rng):  # noqa: ANN001, ANN201
    p = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    n = len(a)
    one = len(a) > 1 and np.isfinite(hops(a)).all()
    if one:
        # Strongly connected: one stationary distribution, and an inverse; both by elimination.
        m = np.eye(n) - p.T
        m[-1] = 1
        w = np.linalg.solve(m, np.eye(n)[-1])
        z = np.linalg.inv(np.eye(n) - p + w[None, :])
    else:
        val, vec = np.linalg.eig(p.T)
        w = np.real(vec[:, np.argmin(np.abs(val - 1))])
        w = w / w.sum()
        z = np.linalg.pinv(np.eye(n) - p + np.tile(w, (n, 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (np.diag(z)[None, :] - z) / w[None, :]
    i, j = np.nonzero(~np.eye(len(a), dtype=bool))
    return ids[i], ids[j], m[i, j]


def diffusion_efficiency(a, ids, rng):  # noqa: ANN001, ANN201
    _, _, m = mean_first_passage(a, ids, rng)
    return ([float(np.mean(1.0 / m[np.abs(m) > 1e-12]))],)


def gateway(a, ids, rng, modules=4):  # noqa: ANN001, ANN201
    """Gateway coefficient by strength, modules by Louvain."""
    ci = louvain_partition(a, rng, 1.0)
    s = a.sum(1)
    out = np.zeros(len(a))
    k = np.stack([a[:, ci == m].sum(1) for m in range(ci.max() + 1)], 1)
    total_in = np.array([k[ci == m].sum(0) for m in range(ci.max() + 1)])
    cen = np.array([s[ci == m].sum() for m in range(ci.max() + 1)])
    for i in range(len(a)):
        if s[i] == 0:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            khat = np.nan_to_num(k[i] / total_in[ci[i]])
        chat = np.array([s[(a[i] > 0) & (ci == m)].sum() for m in range(ci.max() + 1)]) / max(cen.max(), 1e-300)
        out[i] = 1 - ((k[i] / s[i]) ** 2 * (1 - khat * chat) ** 2).sum()
    return ids, out


# Communities -----------------------------------------------------------------------------------

def _dense_labels(ci: np.ndarray) -> np.ndarray:
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(x), len(first)) for x in ci])


def modularity(a: np.ndarray, ci: np.ndarray, gamma: float = 1.0) -> float:
    s = a.sum()
    if s == 0:
        return 0.0
    same = ci[:, None] == ci[None, :]
    return float(((a - gamma * np.outer(a.sum(1), a.sum(0)) / s) * same).sum() / s)


def louvain_partition(a: np.ndarray, rng: np.random.Generator, gamma: float) -> np.ndarray:
    """Moves of single nodes in random order while modularity gains, then aggregation, repeated."""
    s = a.sum()
    n = len(a)
    if s == 0:
        return np.arange(n)
    b = (a - gamma * np.outer(a.sum(1), a.sum(0)) / s) / s
    b = (b + b.T) / 2
    total, best = np.arange(n), -INF
    while True:
        m = len(b)
        ci = np.arange(m)
        to = b.copy()  # to[i, c]: gain that node i has from community c
        moved = True
        while moved:
            moved = False
            for u in rng.permutation(m):
                gain = to[u] - to[u, ci[u]] + b[u, u]
                gain[ci[u]] = 0
                c = int(np.argmax(gain))
                if gain[c] > 1e-10:
                    to[:, c] += b[:, u]
                    to[:, ci[u]] -= b[:, u]
                    ci[u] = c
                    moved = True
            used = np.unique(ci)
            if moved and 2 * len(used) < to.shape[1]:  # communities that are left, and one empty
                to = np.hstack([to[:, used], np.zeros((m, 1))])
                ci = np.searchsorted(used, ci)
        ci = _dense_labels(ci)
        total = ci[total]
        k = ci.max() + 1
        one = np.eye(k)[ci]
        b = one.T @ b @ one
        q = float(np.trace(b))
        if q - best <= 1e-10 or k == m:
            return _dense_labels(total)
        best = q


def louvain(a, ids, rng, gamma=1.0):  # noqa: ANN001, ANN201
    ci = louvain_partition(a, rng, gamma)
    return ids, ci, np.full(len(ids), modularity(a, ci, gamma))


def spectral_modularity(a, ids, rng, gamma=1.0):  # noqa: ANN001, ANN201
    """Recursive splits by the leading eigenvector, each fine-tuned by single moves."""
    s = max(a.sum(), 1e-300)
    b = a - gamma * np.outer(a.sum(1), a.sum(0)) / s
    b = b + b.T
    ci, todo, label = np.zeros(len(a), int), [np.arange(len(a))], 0
    while todo:
        part = todo.pop()
        sub = b[np.ix_(part, part)]
        sub = sub - np.diag(sub.sum(1))
        v = np.where(np.linalg.eigh(sub)[1][:, -1] >= 0, 1.0, -1.0)
        q = v @ sub @ v
        free = np.ones(len(part), bool)
        while free.any():
            gain = np.where(free, -4 * v * (sub @ v - np.diag(sub) * v), -INF)
            k = int(np.argmax(gain))
            if gain[k] <= 1e-10:
                break
            v[k], free[k], q = -v[k], False, q + gain[k]
        if q > 1e-10 and abs(v.sum()) < len(v):
            todo += [part[v > 0], part[v < 0]]
        else:
            ci[part] = label
            label += 1
    ci = _dense_labels(ci)
    return ids, ci, np.full(len(ids), modularity(a, ci, gamma))


def consensus(a, ids, rng, tau=0.3, reps=20):  # noqa: ANN001, ANN201
    """Partition on which repeated Louvain runs of the thresholded agreement matrix agree."""
    parts = [louvain_partition(a, rng, 1.0) for _ in range(reps)]
    for _ in range(20):
        d = np.mean([p[:, None] == p[None, :] for p in parts], 0) * (1 - np.eye(len(a)))
        d[d < tau] = 0
        if not d.any():
            return ids, np.arange(len(a))
        parts = [louvain_partition(d, rng, 1.0) for _ in range(reps)]
        if all((p == parts[0]).all() for p in parts):
            break
    return ids, parts[0]


def core_periphery(a, ids, rng, gamma=1.0):  # noqa: ANN001, ANN201
    """Split into core and periphery that maximises weight inside the core less weight inside the
    periphery, against ``gamma`` times the mean weight; links to itself don't count. With c = 1 in the core and -1
    outside, the sum over pairs is that of row sums times c, so each node goes by the sign of its
    row sum, and no moves one by one are needed."""
    w = a - np.diag(np.diag(a))
    b = w - gamma * w.mean() if len(w) else w
    return ids, ((b + b.T).sum(1) > 1e-10 * max(abs(w).sum(), 1e-300)).astype(int)


def clique_communities(a, ids, rng, size=3):  # noqa: ANN001, ANN201
    """Clique percolation: maximal cliques of at least ``size`` that share ``size - 1`` nodes."""
    near = [set(np.flatnonzero((a[k] != 0) | (a[:, k] != 0))) - {k} for k in range(len(a))]
    cliques: list[frozenset] = []

    def grow(r: set, p: set, x: set) -> None:
        if not p and not x:
            if len(r) >= size:
                cliques.append(frozenset(r))
            return
        pivot = max(p | x, key=lambda v: len(near[v] & p))
        for v in list(p - near[pivot]):
            grow(r | {v}, p & near[v], x & near[v])
            p.remove(v)
            x.add(v)

    grow(set(), set(range(len(a))), set())
    group = list(range(len(cliques)))

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    for i, j in combinations(range(len(cliques)), 2):
        if len(cliques[i] & cliques[j]) >= size - 1:
            group[root(j)] = root(i)
    rows = sorted({(root(k), ids[v]) for k, c in enumerate(cliques) for v in c})
    return [r[1] for r in rows], [r[0] for r in rows]


def link_communities(a, ids, rng, cut=0.5):  # noqa: ANN001, ANN201
    """Edges grouped by single linkage on the similarity of their outer ends' neighbourhoods."""
    near = [set(np.flatnonzero(a[k])) | {k} for k in range(len(a))]
    edges = [(i, j) for i, j in zip(*np.nonzero(np.triu(a + a.T, 1)), strict=True)]
    group = list(range(len(edges)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    at: dict[int, list[int]] = {}
    for k, e in enumerate(edges):
        for v in e:
            at.setdefault(int(v), []).append(k)
    for v, ks in at.items():
        for x, y in combinations(ks, 2):
            i = edges[x][0] if edges[x][1] == v else edges[x][1]
            j = edges[y][0] if edges[y][1] == v else edges[y][1]
            if len(near[i] & near[j]) / len(near[i] | near[j]) >= cut:
                group[root(y)] = root(x)
    return [ids[i] for i, _ in edges], [ids[j] for _, j in edges], [root(k) for k in range(len(edges))]


# Structure -------------------------------------------------------------------------------------

def backbone(a, ids, rng, avgdeg=6):  # noqa: ANN001, ANN201
    """Maximum spanning forest, then the strongest edges up to the average degree."""
    n = len(a)
    w = np.maximum(a, a.T)
    order = sorted(((w[i, j], -i, -j) for i, j in combinations(range(n), 2) if w[i, j] > 0), reverse=True)
    group = list(range(n))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    tree, rest = [], []
    for weight, i, j in order:
        ri, rj = root(-i), root(-j)
        (rest if ri == rj else tree).append((-i, -j, weight))
        group[rj] = ri
    rows = tree + rest[: max(0, int(avgdeg * n / 2) - len(tree))]
    return [ids[i] for i, _, _ in rows], [ids[j] for _, j, _ in rows], [w for _, _, w in rows], [k < len(tree) for k in range(len(rows))]


def s_core(a, ids, rng, s=10.0):  # noqa: ANN001, ANN201
    """Nodes left when those of strength under s are taken out again and again."""
    b = a.copy()
    while True:
        weak = (b.sum(1) < s) & (b.sum(1) > 0)
        if not weak.any():
            return ids, b.sum(1) > 0
        b[weak], b[:, weak] = 0, 0


def walks(a, ids, rng, q=4):  # noqa: ANN001, ANN201
    b, out = (a != 0).astype(float), []
    p = np.eye(len(a))
    for _ in range(q):
        p = p @ b
        out.append(float(p.sum()))
    return list(range(1, q + 1)), out


def paths(a, ids, rng, q=4):  # noqa: ANN001, ANN201
    """Simple paths and cycles by number of edges up to q, and the probability of a cycle."""
    near = [np.flatnonzero(r) for r in a]
    n_paths, n_cycles = np.zeros(q + 1), np.zeros(q + 1)
    stack = [(s, (s,)) for s in range(len(a))]
    while stack:
        v, seen = stack.pop()
        for u in near[v].tolist():
            if u == seen[0] and len(seen) > 1:
                n_cycles[len(seen)] += 1
            elif u not in seen:
                n_paths[len(seen)] += 1
                if len(seen) < q:
                    stack.append((u, (*seen, u)))
    k = np.arange(1, q + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return k.tolist(), n_paths[1:].tolist(), n_cycles[1:].tolist(), np.nan_to_num(n_cycles[1:] / (n_cycles[1:] + n_paths[1:])).tolist()


def navigation(a, ids, rng, max_hops=20):  # noqa: ANN001, ANN201
    """Greedy routes: the next node is the neighbour nearest to the target on a ring of ids."""
    n = len(a)
    place = np.arange(n)
    ring = np.abs(place[:, None] - place[None, :])
    ring = np.minimum(ring, n - ring)
    done, total = 0, 0
    for i, j in permutations(range(n), 2):
        at, before, k = i, -1, 0
        while at != j and k < max_hops:
            near = np.flatnonzero(a[at])
            if not len(near):
                break
            nxt = int(near[np.argmin(ring[near, j])])
            if nxt == before:
                break
            before, at, k = at, nxt, k + 1
        total += 1
        done += at == j
    return ([done / total if total else 0.0],)


def search_information(a, ids, rng):  # noqa: ANN001, ANN201
    """Bits needed to follow the shortest path by a random walk."""
    d, _, nxt = floyd(lengths(a))
    p = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    rows = []
    for i, j in permutations(range(len(a)), 2):
        way = path(nxt, i, j)
        if way:
            rows.append((ids[i], ids[j], float(-sum(np.log2(p[x, y]) for x, y in zip(way, way[1:], strict=False)))))
    return tuple(zip(*rows, strict=True)) if rows else ([], [], [])


def path_transitivity(a, ids, rng):  # noqa: ANN001, ANN201
    """Mean matching of node pairs on the shortest path."""
    n = len(a)
    deg = a.sum(1)
    _, _, nxt = floyd(lengths(a))
    rows = []
    for i, j in combinations(range(n), 2):
        way = path(nxt, i, j)
        if len(way) > 1:
            m = []
            for x, y in combinations(way, 2):
                both = (a[x] > 0) & (a[y] > 0)
                base = deg[x] + deg[y] - 2 * a[x, y]
                m.append((a[x, both] + a[y, both]).sum() / base if base else 0.0)
            rows.append((ids[i], ids[j], float(np.mean(m))))
    return tuple(zip(*rows, strict=True)) if rows else ([], [], [])


def resource_efficiency(a, ids, rng, share=0.5):  # noqa: ANN001, ANN201
    """Walkers needed so that one follows the shortest path with probability ``share``, inverted."""
    _, _, nxt = floyd(lengths(a))
    p = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    rows = []
    for i, j in permutations(range(len(a)), 2):
        way = path(nxt, i, j)
        if way:
            q = float(np.prod([p[x, y] for x, y in zip(way, way[1:], strict=False)]))
            need = 1.0 if q >= 1 else np.log(1 - share) / np.log1p(-q) if q > 0 else INF
            rows.append((ids[i], ids[j], 1.0 / max(need, 1.0)))
    return tuple(zip(*rows, strict=True)) if rows else ([], [], [])


def quasi_idempotence(a, ids, rng, steps=20, eps=1e-4):  # noqa: ANN001, ANN201
    """Correlation of the normalised, repeatedly squared matrix with its start."""
    x = a / max(np.linalg.norm(a, 2), 1e-300)
    up = np.triu_indices(len(a), 1)
    start, out, last = x[up], [], None
    for _ in range(steps):
        x = x @ x
        x = x / max(np.linalg.norm(x, 2), 1e-300)
        c = float(np.corrcoef(start, x[up])[0, 1]) if start.std() > 0 and x[up].std() > 0 else 0.0
        out.append(c)
        if last is not None and abs(c - last) <= eps:
            break
        last = c
    return list(range(1, len(out) + 1)), out


def motifs(a, ids, rng, size=3):  # noqa: ANN001, ANN201
    """Counts of connected subgraphs of 3 or 4 nodes by class (the least code over all orders of
    its nodes), with the mean weight intensity."""
    b = (a != 0).astype(int)
    np.fill_diagonal(b, 0)
    und = b | b.T
    count: dict[int, int] = {}
    weight: dict[int, float] = {}
    orders = [list(p) for p in permutations(range(size))]
    powers = 1 << np.arange(size * size)
    kept: dict[int, int] = {}
    for nodes in combinations(range(len(a)), size):
        sub = und[np.ix_(nodes, nodes)]
        if (np.linalg.matrix_power(sub + np.eye(size, dtype=int), size - 1) == 0).any():
            continue
        m = b[np.ix_(nodes, nodes)]
        raw = int(m.ravel() @ powers)
        if raw not in kept:
            kept[raw] = min(int(m[np.ix_(p, p)].ravel() @ powers) for p in orders)
        code = kept[raw]
        w = a[np.ix_(nodes, nodes)][m > 0]
        count[code] = count.get(code, 0) + 1
        weight[code] = weight.get(code, 0.0) + float(np.exp(np.log(np.abs(w) + 1e-300).mean()))
    codes = sorted(count)
    return codes, [count[c] for c in codes], [weight[c] / count[c] for c in codes]


def reorder_matrix(a, ids, rng, rounds=2000):  # noqa: ANN001, ANN201
    """Order of nodes that draws weight to the diagonal, by annealed swaps."""
    n = len(a)
    order = np.arange(n)
    far = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))

    def cost(o: np.ndarray) -> float:
        return float((a[np.ix_(o, o)] * far).sum())

    now, heat = cost(order), max(1.0, cost(order) / max(n, 1) / 10)
    for k in range(rounds if n > 1 else 0):
        i, j = rng.choice(n, 2, replace=False)
        new = order.copy()
        new[[i, j]] = new[[j, i]]
        c = cost(new)
        if c < now or rng.random() < np.exp((now - c) / (heat * (1 - k / rounds) + 1e-9)):
            order, now = new, c
    return ids[order], list(range(n))


# Null models and generators --------------------------------------------------------------------

def _rewire(a: np.ndarray, rng, iterations: int, directed: bool, accept=None) -> tuple[np.ndarray, int]:  # noqa: ANN001
    r = a.copy()
    i, j = np.nonzero(r if directed else np.triu(r, 1))
    i, j = i.copy(), j.copy()
    k, n, done = len(i), len(r), 0
    tries = int(round(n * k / max(1, n * (n - 1)))) + 1
    for _ in range(iterations * k if k > 1 else 0):
        for _ in range(tries):
            x, y = rng.integers(0, k, 2)
            p, q, u, v = i[x], j[x], i[y], j[y]
            if len({p, q, u, v}) < 4:
                continue
            if not directed and rng.random() < 0.5:
                u, v = v, u
            if r[p, v] or r[u, q] or (accept and not accept(r, p, q, u, v)):
                continue
            r[p, v], r[p, q], r[u, q], r[u, v] = r[p, q], 0, r[u, v], 0
            if not directed:
                r[v, p], r[q, p], r[q, u], r[v, u] = r[p, v], 0, r[u, q], 0
            i[x], j[x], i[y], j[y] = p, v, u, q
            done += 1
            break
    return r, done


def _connected(r: np.ndarray) -> bool:
    return bool(np.isfinite(hops(r + r.T)[0]).all())


def rewired(a, ids, rng, iterations=5, directed=False, connected=False, lattice=False):  # noqa: ANN001, ANN201
    """Degree-preserving rewiring; ``connected`` keeps one component, ``lattice`` only accepts swaps
    that don't lengthen edges on the ring of nodes."""
    n = len(a)

    def accept(r, p, q, u, v):  # noqa: ANN001, ANN202
        if lattice:
            ring = lambda x, y: min(abs(int(x) - int(y)), n - abs(int(x) - int(y)))
            if ring(p, q) * r[p, q] + ring(u, v) * r[u, v] < ring(p, v) * r[p, q] + ring(u, q) * r[u, v]:
                return False
        if connected:
            t = r.copy()
            t[p, v], t[p, q], t[u, q], t[u, v] = t[p, q], 0, t[u, v], 0
            if not directed:
                t[v, p], t[q, p], t[q, u], t[v, u] = t[p, v], 0, t[u, q], 0
            return _connected(t)
        return True

    r, done = _rewire(a, rng, iterations, directed, accept if lattice or connected else None)
    i, j = np.nonzero(r)
    return ids[i], ids[j], r[i, j], np.full(len(i), done)


def null_model_signed(a, ids, rng, swaps=5):  # noqa: ANN001, ANN201
    """Rewires positive and negative parts alone, then deals each part's weights again, the largest
    to the pairs of largest expected strength."""
    out = np.zeros_like(a)
    for sign in (1, -1):
        part = np.where(a * sign > 0, np.abs(a), 0)
        shape = _rewire((part > 0).astype(float), rng, swaps, False)[0]
        i, j = np.nonzero(np.triu(shape, 1))
        free = (out[i, j] == 0)
        i, j = i[free], j[free]
        w = np.sort(part[np.triu_indices(len(a), 1)])[::-1]
        w = w[w > 0][: len(i)]
        s = part.sum(1)
        order = np.argsort(-(s[i] * s[j]), kind="stable")[: len(w)]
        out[i[order], j[order]] = out[j[order], i[order]] = sign * w
    i, j = np.nonzero(out)
    return ids[i], ids[j], out[i, j]


def generated(a, ids, rng, kind="random", k=60, directed=True):  # noqa: ANN001, ANN201
    """Synthetic graphs on the given nodes with k edges: random, lattice, ring, toeplitz, fractal,
    even (clusters) or degrees (random with the degrees of the given graph)."""
    n = len(ids)
    off = ~np.eye(n, dtype=bool) if directed else np.triu(np.ones((n, n), bool), 1)
    i, j = np.nonzero(off)
    far = np.abs(i - j)
    if kind == "random":
        score = rng.random(len(i))
    elif kind == "lattice":
        score = far + rng.random(len(i))
    elif kind == "ring":
        score = np.minimum(far, n - far) + rng.random(len(i))
    elif kind == "toeplitz":
        score = -np.log(rng.random(len(i))) / np.exp(-0.5 * (far / (n / 6)) ** 2)
    elif kind == "fractal":
        level = np.floor(np.log2(np.maximum(1, i ^ j))).astype(int)
        score = rng.random(len(i)) * 2.0**level
    elif kind == "even":
        score = (i // 4 != j // 4) * 1.0 + rng.random(len(i)) * 0.99
    else:
        d = (a != 0).sum(1)
        r, _ = _rewire((np.argsort(np.argsort(rng.random((n, n)), 1), 1) < d[:, None]).astype(float) * off, rng, 2, True)
        i, j = np.nonzero(r)
        return ids[i], ids[j]
    keep = np.argsort(score, kind="stable")[:k]
    return ids[i[keep]], ids[j[keep]]


def generative_model(a, ids, rng, eta=-1.0, gamma=0.5, k=60):  # noqa: ANN001, ANN201
    x, y = source_kernels.grown(len(ids), rng, eta, gamma, k)
    return ids[x], ids[y]


def ks_energy(a, ids, rng, eta=-1.0, gamma=0.5):  # noqa: ANN001, ANN201
    """Largest Kolmogorov-Smirnov distance of degree, clustering, betweenness and edge length
    between a graph and one grown by ``generative_model``."""
    b = (np.triu(a + a.T, 1) > 0).astype(float)
    k = int(b.sum())
    x, y = generative_model(a, np.arange(len(a)), rng, eta, gamma, k)
    g = np.zeros_like(b)
    g[x, y] = 1
    b, g = b + b.T, g + g.T

    def stats(m: np.ndarray) -> list[np.ndarray]:
        d = m.sum(1)
        c = ((m @ m) * m).sum(1) / np.maximum(1, d * (d - 1))
        i, j = np.nonzero(np.triu(m))
        return [d, c, _brandes(m, False)[0], np.minimum(j - i, len(m) - (j - i))]

    def ks(p: np.ndarray, q: np.ndarray) -> float:
        at = np.sort(np.r_[p, q])
        return float(np.abs(np.searchsorted(np.sort(p), at, "right") / max(1, len(p)) - np.searchsorted(np.sort(q), at, "right") / max(1, len(q))).max()) if len(at) else 0.0

    e = [ks(p, q) for p, q in zip(stats(b), stats(g), strict=True)]
    return [max(e)], [e[0]], [e[1]], [e[2]], [e[3]]
