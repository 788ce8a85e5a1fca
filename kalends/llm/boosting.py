"""Gradient-boosted trees, fitted on a bounded labelled sample, scored as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Depth-two trees on numeric features, logistic loss, Newton leaves.

    A tree is (feature, cut, (feature, cut, low, high), (feature, cut, low, high)):
    values up to a cut go low.
    """

    def __init__(self, trees: int = 24, rate: float = 0.3, ridge: float = 1.0):
        self.size, self.rate, self.ridge = trees, rate, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            j, cut = self._split(x, g, h)
            tree = [j, cut]
            for side in (x[:, j] <= cut, x[:, j] > cut):
                k, c = self._split(x[side], g[side], h[side])
                low = x[side][:, k] <= c
                tree.append((k, c, *(float(self.rate * g[side][s].sum() / (h[side][s].sum() + self.ridge)) for s in (low, ~low))))
            self.trees.append(tuple(tree))
            score = score + self._tree(x, tree)
        return self

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, a, b = x[order, j], g[order].cumsum(), h[order].cumsum()
            ends = np.flatnonzero(v[1:] > v[:-1])
            if len(ends):
                gain = a[ends] ** 2 / (b[ends] + self.ridge) + (a[-1] - a[ends]) ** 2 / (b[-1] - b[ends] + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float((v[ends[k]] + v[ends[k] + 1]) / 2))
        return best[1], best[2]

    @staticmethod
    def _tree(x: np.ndarray, tree: list) -> np.ndarray:
        j, cut, low, high = tree
        leaf = lambda t: np.where(x[:, t[0]] <= t[1], t[2], t[3])
        return np.where(x[:, j] <= cut, leaf(low), leaf(high))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._tree(x, t) for t in self.trees)

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The least score at and above which held-out rows reach the precision; halfway to the next one, so that rounding decides nothing."""
        s = self.score(x)
        order = np.argsort(-s, kind="stable")
        right = y[order].cumsum() / np.arange(1, len(y) + 1)
        last = np.r_[s[order][1:] < s[order][:-1], True]  # ties stand or fall together
        good = np.flatnonzero((right >= precision) & last)
        if not len(good):
            return float("inf")
        least, below = s[order][good[-1]], s[order][good[-1] + 1 :]
        return float((least + below[0]) / 2) if len(below) else float(least) - 1e-6

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The score as an expression; feature(j) is the column of feature j."""
        leaf = lambda t: F.when(feature(t[0]) <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
        out = F.lit(self.base)
        for j, cut, low, high in self.trees:
            out = out + F.when(feature(j) <= cut, leaf(low)).otherwise(leaf(high))
        return out
