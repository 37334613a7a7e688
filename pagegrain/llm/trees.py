"""Gradient-boosted trees with logistic loss on binned features, in numpy. Trees are complete, of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 2.0, least: float = 1.0, balanced: bool = False, share: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """A forest for y in {0, 1}; without rows or with one class only, a constant. ``balanced``: both classes weigh the same; ``weight``: so much each
    row; ``share``: of the features, drawn from a fixed seed, for each tree."""
    n, inner = len(x), 2**depth - 1
    ones = float(np.sum(y))
    if weight is None:
        weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))) if balanced and 0 < ones < n else np.ones(n)
    mean = (float(np.sum(y * weight)) + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], leaves[:0], base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins))) for f in range(x.shape[1])]
    edges = [(c[1:] + c[:-1]) / 2 for c in cuts]  # half way, so that a value never seen falls to the nearer side
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    useful = [f for f, e in enumerate(edges) if len(e)]
    total, draw = np.full(n, base), np.random.default_rng(1)
    for t in range(trees):
        tried = useful if share >= 1 else np.sort(draw.choice(useful, max(1, int(share * len(useful))), replace=False))
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, split = np.full(width, 1e-6), [(0, np.inf, bins)] * width
            for f in tried:
                e, cells = edges[f], len(edges[f]) + 1
                key = local * cells + binned[f]
                gs, hs = (np.bincount(key, v, width * cells).reshape(width, cells).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[node], split[node] = gain[node, k[node]], (f, e[k[node]], k[node])
            for node, (f, edge, k) in enumerate(split):
                feature[t, first + node], threshold[t, first + node] = f, edge
            right = np.zeros(n, np.int64)
            for node, (f, _, k) in enumerate(split):
                rows = np.flatnonzero(local == node)
                right[rows] = binned[f][rows] > k
            at = 2 * at + 1 + right
        cell = at - inner
        gs, hs = np.bincount(cell, g, inner + 1), np.bincount(cell, h, inner + 1)
        leaves[t] = -rate * gs / (hs + l2)
        total += leaves[t][cell]
    return Forest(feature, threshold, leaves, base)
