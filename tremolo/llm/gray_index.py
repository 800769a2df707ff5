"""Hierarchical index over 64-bit fingerprints in Gray order (NumPy only, no Spark).

Leaves are fingerprints sorted by Gray rank. Every ``FAN`` neighbours share a parent that
stores the bits on which all of them agree (mask and pattern); parents are grouped alike.
A search adds up differences from the top: bits that a node shares with its parent have been
counted above, so only the node's own new bits are compared, and a whole group is left as soon
as the sum exceeds the radius. Many independent groups are indexed and searched side by side.
"""

from __future__ import annotations

import numpy as np

FAN = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of a bit pattern in the reflected Gray sequence."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


class GrayIndex:
    """Index of ``prints`` (uint64) within groups; ``group`` are integers of any order."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(prints), group))
        self.order = order
        self.prints = prints[order]
        self.group = group[order]
        n = len(prints)
        # levels[k] = (mask, pattern, first child, one past the last child); level 0 are leaves
        self.levels = [(np.full(n, ONES), self.prints, None, None)]
        self.leaf = [np.arange(n)]  # of each node the first leaf below it
        owner = self.group
        while True:
            mask, pattern, _, _ = self.levels[-1]
            m = len(pattern)
            first_of_group = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if m else np.zeros(0, np.int64)
            if len(first_of_group) == m or not m:
                break
            size = np.diff(np.r_[first_of_group, m])
            inside = np.arange(m) - np.repeat(first_of_group, size)
            starts = np.flatnonzero(inside % FAN == 0)
            lead = np.repeat(pattern[starts], np.diff(np.r_[starts, m]))
            differs = np.bitwise_or.reduceat((pattern ^ lead) | ~mask, starts)
            shared = ~differs
            self.levels.append((shared, pattern[starts] & shared, starts, np.r_[starts[1:], m]))
            self.leaf.append(self.leaf[-1][starts])
            owner = owner[starts]
        self.top_owner = owner

    def links(self, radius: int, label: np.ndarray, unite, block: int = 2048, wide: int = 1 << 21) -> None:
        """Calls ``unite(i, j)`` (arrays of leaf positions, i after j) on linked pairs until the
        components of all pairs within ``radius`` are joined. ``label[i]`` is the component of
        leaf i as known so far; ``unite`` renews it. A subtree that lies wholly in the query's
        component isn't entered, so a dense ball costs about one block and not its square."""
        n = len(self.prints)
        top = len(self.levels) - 1
        roots, of_root = self.top_owner, np.arange(len(self.top_owner))
        root_of = of_root[np.searchsorted(roots, self.group)] if n else np.zeros(0, np.int64)
        bare = np.r_[True, self.group[1:] != self.group[:-1]] & np.r_[self.group[1:] != self.group[:-1], True] if n else np.zeros(0, bool)
        queries = np.flatnonzero(~bare)
        for at in range(0, len(queries), block):
            q = queries[at : at + block]
            same = self._uniform(label)
            self._search(q, root_of[q], top, radius, label, same, unite, wide)

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level and node the one component of its leaves, or -1."""
        out = [label]
        for _, _, first, _ in self.levels[1:]:
            below = out[-1]
            low, high = np.minimum.reduceat(below, first), np.maximum.reduceat(below, first)
            out.append(np.where(low == high, low, -1))
        return out

    def _search(self, q, node, level, radius, label, same, unite, wide) -> None:
        acc = np.zeros(len(q), np.uint8)
        above = np.zeros(len(q), np.uint64)
        stack = [(level, q, node, acc, above)]
        while stack:
            level, q, node, acc, above = stack.pop()
            if len(q) > wide:
                half = len(q) // 2
                stack.append((level, q[half:], node[half:], acc[half:], above[half:]))
                stack.append((level, q[:half], node[:half], acc[:half], above[:half]))
                continue
            mask, pattern, first, last = self.levels[level]
            known = same[level][node]
            go = ((known < 0) | (known != label[q])) & (self.leaf[level][node] < q)  # a later leaf finds the pair itself
            q, node, acc, above = q[go], node[go], acc[go], above[go]
            new = mask[node] & ~above
            acc = acc + np.bitwise_count((self.prints[q] ^ pattern[node]) & new)
            go = acc <= radius
            q, node, acc = q[go], node[go], acc[go]
            if not len(q):
                continue
            if level == 0:
                unite(q, node)
                continue
            count = last[node] - first[node]
            rep = np.repeat(np.arange(len(q)), count)
            child = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[node], count)
            stack.append((level - 1, q[rep], child, acc[rep], mask[node][rep]))


def local_components(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) fingerprints: within each group, fingerprints at ``radius`` or fewer
    differing bits are linked; equal fingerprints in different groups are one node. Only nodes
    whose root is another node are returned: at most one edge for each fingerprint."""
    if not len(prints):
        return prints, prints
    index = GrayIndex(prints, group)
    values, at = np.unique(index.prints, return_inverse=True)
    parent = np.arange(len(values))
    label = parent[at].copy()

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = parent[x]

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        a, b = at[i], at[j]
        while len(a):
            a, b = roots(a), roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(parent, high, low)
        label[:] = roots(np.arange(len(values)))[at]

    index.links(radius, label, unite)
    root = roots(np.arange(len(values)))
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]
