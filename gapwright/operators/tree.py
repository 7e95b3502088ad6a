"""A small classification tree, and its evaluation as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class GiniTree:
    """Exact binary splits by Gini impurity down to ``max_depth``.

    Nodes lie in a heap: children of k at 2k + 1 and 2k + 2.  Ties go to the
    lower feature, then the lower threshold, and a leaf to the lower code.
    """

    def __init__(self, max_depth: int = 4, min_rows: int = 2):
        self.max_depth, self.min_rows = max_depth, min_rows

    def fit(self, X: np.ndarray, y: np.ndarray) -> GiniTree:
        size = 2 ** (self.max_depth + 1) - 1
        self.feature = np.full(size, -1, dtype=np.int64)
        self.threshold = np.zeros(size)
        self.leaf = np.zeros(size, dtype=np.int64)
        self._grow(0, X, y.astype(np.int64), int(y.max()) + 1 if len(y) else 1, 0)
        return self

    def _grow(self, node: int, X: np.ndarray, y: np.ndarray, classes: int, depth: int) -> None:
        counts = np.bincount(y, minlength=classes)
        self.leaf[node] = counts.argmax() if len(y) else 0
        if depth == self.max_depth or len(y) < self.min_rows or counts.max() == len(y):
            return
        best = (counts.astype(float) ** 2).sum() / len(y) + 1e-9
        found = None
        for j in range(X.shape[1]):
            order = np.argsort(X[:, j], kind="stable")
            x = X[order, j]
            cut = np.flatnonzero(x[1:] > x[:-1]) + 1
            if not len(cut):
                continue
            left = np.cumsum(np.eye(classes)[y[order]], axis=0)[cut - 1]
            right = counts - left
            purity = (left**2).sum(axis=1) / cut + (right**2).sum(axis=1) / (len(y) - cut)
            k = int(purity.argmax())
            if purity[k] > best:
                best, found = purity[k], (j, (x[cut[k] - 1] + x[cut[k]]) / 2)
        if found is None:
            return
        self.feature[node], self.threshold[node] = found
        side = X[:, found[0]] <= found[1]
        self._grow(2 * node + 1, X[side], y[side], classes, depth + 1)
        self._grow(2 * node + 2, X[~side], y[~side], classes, depth + 1)

    def predict(self, X: np.ndarray) -> np.ndarray:
        node = np.zeros(len(X), dtype=np.int64)
        for _ in range(self.max_depth):
            f = self.feature[node]
            down = f >= 0
            left = X[np.arange(len(X)), np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(down, 2 * node + np.where(left, 1, 2), node)
        return self.leaf[node]


def walk(values: Column, feature: Column, threshold: Column, leaf: Column, depth: int) -> Column:
    """The code that a tree (as arrays) gives to an array of feature values."""

    def step(node: Column, _: Column) -> Column:
        f = F.element_at(feature, node + 1)
        down = F.when(F.element_at(values, F.greatest(f, F.lit(0)) + 1) <= F.element_at(threshold, node + 1), 2 * node + 1).otherwise(2 * node + 2)
        return F.when(f < 0, node).otherwise(down)

    at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
    return F.element_at(leaf, at + 1)
