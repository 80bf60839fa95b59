"""Gradient-boosted trees for a two-class problem, in numpy: histograms, logistic loss, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``fit`` on features and 0/1 labels, ``margin`` gives log-odds. Ties break towards the first feature, so a fit is repeatable."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.zeros((self.rounds, nodes), np.int64)
        self.cut = np.full((self.rounds, nodes), np.inf)
        self.value = np.zeros((self.rounds, nodes))
        flat = b + np.arange(m) * self.bins
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                idx = ((at - first)[:, None] * (m * self.bins) + flat).ravel()
                gs, hs = (np.bincount(idx, np.repeat(v, m), width * m * self.bins).reshape(width, m, self.bins).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain = np.where((hs < self.least) | (ht - hs < self.least), -1, gain).reshape(width, -1)
                best = gain.argmax(axis=1)
                for k in range(width):
                    j, c = divmod(int(best[k]), self.bins)
                    if gain[k, best[k]] > 1e-6 and c < len(self.edges[j]):
                        self.feature[r, first + k], self.cut[r, first + k] = j, self.edges[j][c]
                at = self._step(x, at, r)
            last = (1 << self.depth) - 1
            gl, hl = (np.bincount(at - last, v, 1 << self.depth) for v in (g, h))
            self.value[r, last:] = self.rate * gl / (hl + self.ridge)
            f += self.value[r, at]
        return self

    def _step(self, x: np.ndarray, at: np.ndarray, r: int) -> np.ndarray:
        right = x[np.arange(len(x)), self.feature[r, at]] > self.cut[r, at]
        return 2 * at + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for r in range(self.rounds):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = self._step(x, at, r)
            f += self.value[r, at]
        return f
