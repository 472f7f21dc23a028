"""Gradient-boosted trees for the logistic loss, by histograms; small enough for the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node 0 is the root; a leaf's feature is -1. Rows with x <= threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)

    def paths(self) -> list[list[tuple[int, bool, float]]]:
        """Conditions (feature, at most, threshold) from the root to every other node."""
        out, todo = [], [(0, [])]
        while todo:
            node, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                todo += [(int(self.left[node]), [*path, (f, True, t)]), (int(self.right[node]), [*path, (f, False, t)])]
        return out


@dataclass
class Forest:
    base: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Deterministic; `least` is the fewest rows of a leaf. Features with one cut are summed by a matrix product, the others by histograms."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)] if len(x) else edges
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    single = [f for f, e in enumerate(edges) if len(e) == 1]
    several = [f for f, e in enumerate(edges) if len(e) > 1]
    right = (binned[:, single] > 0).astype(float)
    columns = {f: np.ascontiguousarray(binned[:, f]) for f in several}
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    forest, raw = Forest(float(np.log(mean / (1 - mean))), []), np.full(len(y), float(np.log(mean / (1 - mean))))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        at = np.zeros(len(y), dtype=np.int64)
        level = [0]
        for d in range(depth + 1):
            following: list[int] = []
            for node in level:
                rows = np.flatnonzero(at == node)
                own_g, own_h = g[rows], h[rows]
                n, sg, sh = len(rows), own_g.sum(), own_h.sum()
                nodes[node][4] = rate * sg / (sh + ridge)
                if d == depth or n < 2:
                    continue

                def gain(hw: np.ndarray, hg: np.ndarray, hh: np.ndarray) -> np.ndarray:
                    ok = (hw >= least) & (n - hw >= least)  # noqa: B023
                    return np.where(ok, hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge), -1)  # noqa: B023

                best = (1e-9, -1, -1)
                if single:
                    sums = right[rows].T @ np.stack([np.ones(n), own_g, own_h], axis=1)
                    found = gain(n - sums[:, 0], sg - sums[:, 1], sh - sums[:, 2])
                    k = int(found.argmax())
                    if found[k] > best[0]:
                        best = (float(found[k]), single[k], 0)
                for f in several:
                    own, size = columns[f][rows], len(edges[f]) + 1
                    found = gain(*(np.bincount(own, weights=v, minlength=size).cumsum()[:-1] for v in (None, own_g, own_h)))
                    k = int(found.argmax())
                    if found[k] > best[0]:
                        best = (float(found[k]), f, k)
                if best[1] >= 0:
                    _, f, k = best
                    a, b = len(nodes), len(nodes) + 1
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    nodes[node][:4] = [f, float(edges[f][k]), a, b]
                    at[rows] = np.where(binned[rows, f] <= k, a, b)
                    following += [a, b]
            level = following
        tree = Tree(*(np.array(c) for c in zip(*nodes, strict=True)))
        forest.trees.append(tree)
        raw += tree.predict(x)
    return forest
