"""Nearest neighbours in numpy: a k-d tree with tight boxes, walked for many points at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Points in a leaf of the tree that `search` builds; pairs of a query and a leaf that are compared at once.
MOST, PAIRS = 64, 2048


@dataclass(frozen=True)
class Tree:
    """Nodes, parents before children: dim (-1: a leaf), cut (up to it goes left), kids, number of the leaf, and the box of what lies in it."""

    dim: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, p: np.ndarray) -> np.ndarray:
        """The leaf in whose part of space each point lies."""
        node, at = np.zeros(len(p), int), np.arange(len(p))
        while len(at := at[self.dim[node[at]] >= 0]):
            n = node[at]
            node[at] = self.kids[n, (p[at, self.dim[n]] > self.cut[n]).astype(int)]
        return self.leaf[node]

    def boxed(self, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Tree:
        """The same tree with other boxes for its leaves; leaves not named are empty, and infinitely far."""
        los, his = np.full_like(self.lo, np.inf), np.full_like(self.hi, -np.inf)
        node = np.empty(self.leaves, int)
        node[self.leaf[self.dim < 0]] = np.flatnonzero(self.dim < 0)
        los[node[leaf]], his[node[leaf]] = lo, hi
        for n in range(len(self.dim) - 1, -1, -1):
            if self.dim[n] >= 0:
                los[n], his[n] = los[self.kids[n]].min(axis=0), his[self.kids[n]].max(axis=0)
        return replace(self, lo=los, hi=his)

    def gap2(self, p: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance to a node's box; by the same steps as a point's, so that rounding never lifts it over that of a point inside."""
        g = np.maximum(np.maximum(self.lo[node] - p, p - self.hi[node]), 0)
        return g[:, 0] * g[:, 0] + g[:, 1] * g[:, 1] + g[:, 2] * g[:, 2]

    def closest(self, p: np.ndarray) -> np.ndarray:
        """A leaf near each point, by the nearer box at each fork."""
        node, at = np.zeros(len(p), int), np.arange(len(p))
        while len(at := at[self.dim[node[at]] >= 0]):
            left, right = self.kids[node[at]].T
            node[at] = np.where(self.gap2(p[at], right) < self.gap2(p[at], left), right, left)
        return self.leaf[node]

    def within(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, squared distance) of all leaves whose box is no farther than the point's bound."""
        at, node = np.arange(len(p)), np.zeros(len(p), int)
        found = []
        while len(at):
            gap = self.gap2(p[at], node)
            near = gap <= bound[at]
            at, node, gap = at[near], node[near], gap[near]
            end = self.dim[node] < 0
            found.append((at[end], self.leaf[node[end]], gap[end]))
            at, node = np.repeat(at[~end], 2), self.kids[node[~end]].ravel()
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def build(p: np.ndarray, most: int) -> tuple[Tree, np.ndarray]:
    """A tree whose leaves hold `most` points or fewer, unless they are all equal, and the leaf of each point."""
    dim, cut, kids, leaf, lo, hi = [-1], [0.0], [[-1, -1]], [-1], [], []
    where, leaves, todo = np.zeros(len(p), int), 0, [(0, np.arange(len(p)))]
    boxes = {}
    while todo:
        n, rows = todo.pop()
        own = p[rows]
        boxes[n] = low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.full(3, np.inf), np.full(3, -np.inf))
        if len(rows) <= most or (low == high).all():
            leaf[n], where[rows], leaves = leaves, leaves, leaves + 1
            continue
        d = int(np.argmax(high / 2 - low / 2))
        c = own[:, d]
        mid = float(np.partition(c, (len(c) - 1) // 2)[(len(c) - 1) // 2])
        if mid == high[d]:
            mid = float(c[c < mid].max())
        dim[n], cut[n], kids[n] = d, mid, [len(dim), len(dim) + 1]
        for side in (c <= mid, c > mid):
            todo.append((len(dim), rows[side]))
            dim.append(-1), cut.append(0.0), kids.append([-1, -1]), leaf.append(-1)
    lo, hi = (np.array([boxes[n][k] for n in range(len(dim))]) for k in (0, 1))
    return Tree(np.array(dim), np.array(cut), np.array(kids), np.array(leaf), lo, hi), where


def search(p: np.ndarray, names: np.ndarray, q: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, squared distance, name) of the k nearest points p of each query q no farther than its bound (squared), by distance and name. same: a name may equal the query's id."""
    if not len(p) or not len(q):
        return np.empty(0, int), np.empty(0), names[:0]
    order = np.argsort(names, kind="stable")
    p, names = p[order], names[order]
    tree, leaf = build(p, MOST)
    rows, counts = np.argsort(leaf, kind="stable"), np.bincount(leaf)
    block = np.full((len(counts), counts.max()), -1)  # the points of each leaf, filled up with one infinitely far
    block[leaf[rows], np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)] = rows
    held, called = np.vstack([p, np.full(3, np.inf)])[block], names[block]

    def compared(at: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        x, y, z = (q[at, c, None] - held[leaf, :, c] for c in range(3))
        d2 = x * x + y * y + z * z
        if not same:
            d2[ids[at][:, None] == called[leaf]] = np.inf
        return d2

    bound = bound.copy()
    if block.shape[1] >= k:
        home = tree.closest(q)
        for a in range(0, len(q), PAIRS):
            at = np.arange(a, min(a + PAIRS, len(q)))
            bound[at] = np.minimum(bound[at], np.partition(compared(at, home[at]), k - 1, axis=1)[:, k - 1])
    out = []
    for a in range(0, len(q), PAIRS):
        at, leaf, _ = tree.within(q[a : a + PAIRS], bound[a : a + PAIRS])
        found = []
        for b in range(0, len(at), PAIRS):
            one, into = at[b : b + PAIRS] + a, leaf[b : b + PAIRS]
            d2 = compared(one, into)
            row, col = np.nonzero((d2 <= bound[one][:, None]) & (d2 < np.inf))
            found.append((one[row], d2[row, col], block[into[row], col]))
        if found:
            one, d2, rank = (np.concatenate(x) for x in zip(*found, strict=True))
            sort = np.lexsort((rank, d2, one))
            one, d2, rank = one[sort], d2[sort], rank[sort]
            first = firsts(one, k)
            out.append((one[first], d2[first], names[rank[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0), names[:0])


def firsts(groups: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their run of equal values."""
    new = np.r_[True, groups[1:] != groups[:-1]][: len(groups)]
    return np.arange(len(groups)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k


def lists(at: np.ndarray, n: int, *values: np.ndarray) -> list[list[np.ndarray]]:
    """Each of the values as n arrays, one for each number in at, which is sorted."""
    cuts = np.searchsorted(at, np.arange(1, n))
    return [np.split(v, cuts) if n else [] for v in values]
