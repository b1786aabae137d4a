"""Gradient-boosted trees with logistic loss on binned features, in numpy (for bounded samples)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: inner nodes as (feature, limit), leaves as values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(d)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = 2**self.depth - 1
        self.feature, self.limit = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                if len(rows) >= 4:
                    gain, j, b = self._split(binned[rows], grad[rows], hess[rows])
                    if gain > 1e-6:
                        self.feature[t, at], self.limit[t, at] = j, limits[j][b]
                right = x[rows, self.feature[t, at]] > self.limit[t, at]
                node[rows] = 2 * at + 1 + right
            for at in range(inner + 1):
                rows = node == at + inner
                self.leaf[t, at] = self.rate * grad[rows].sum() / (hess[rows].sum() + self.ridge)
            score += self.leaf[t, node - inner]
        return self

    def _split(self, binned, grad, hess):
        best, (g, h) = (0.0, 0, 0), (grad.sum(), hess.sum())
        for j in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[:, j], grad, self.bins + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, j], hess, self.bins + 1))[:-1]
            gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
            b = int(gain[: binned[:, j].max()].argmax()) if binned[:, j].max() else 0
            if binned[:, j].max() and gain[b] > best[0]:
                best = (float(gain[b]), j, b)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        score, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            score += leaf[node - inner]
        return 1 / (1 + np.exp(-score))
