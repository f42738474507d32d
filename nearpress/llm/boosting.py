"""Gradient-boosted trees for two classes, on arrays.

The trees are oblivious: all nodes of a level ask the same question, so that a
tree is a few comparisons of whole columns.  Training is by histograms with
second-order leaf values; a fitted model is a few arrays, which go to JSON.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """A fitted model: trees of one depth, and what they start from."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        used = np.unique(self.feature)
        columns = dict(zip(used.tolist(), np.ascontiguousarray(rows[:, used].T)))
        out = np.full(len(rows), self.base)
        for feature, cut, value in zip(self.feature.tolist(), self.cut, self.value):
            leaf = np.zeros(len(rows), np.int32)
            for f, c in zip(feature, cut):
                leaf += leaf
                leaf += columns[f] > c
            out += value[leaf]
        return out

    def to_dict(self) -> dict:
        return {
            "base": round(self.base, 6), "feature": self.feature.tolist(),
            "cut": [[float(f"{c:.6g}") for c in t] for t in self.cut], "value": [[round(v, 5) for v in t] for t in self.value.tolist()],
        }

    @classmethod
    def from_dict(cls, d: dict) -> Trees:
        return cls(d["base"], np.array(d["feature"], np.int64), np.array(d["cut"], np.float32), np.array(d["value"]))


def fit(rows: np.ndarray, labels: np.ndarray, n_trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Fits trees by logistic loss; ``least`` is the smallest sum of curvature of a side that counts."""
    n, m = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(m)]
    asked = [j for j in range(m) if len(edges[j])]
    binned = {j: np.searchsorted(edges[j], rows[:, j], side="left") for j in asked}
    mean = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    trees = ([], [], [])
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = labels - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, leaf = [], [], np.zeros(n, np.int64)
        for level in range(depth):
            width, best = 2**level, (-1.0, asked[0], 0)
            for j in asked:
                nb = len(edges[j]) + 1
                key = leaf * nb + binned[j]
                g = np.bincount(key, grad, width * nb).reshape(width, nb).cumsum(axis=1)
                h = np.bincount(key, curve, width * nb).reshape(width, nb).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain.sum(axis=0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            _, j, k = best
            feature.append(j)
            cut.append(np.float32(edges[j][k]))
            leaf = 2 * leaf + (rows[:, j] > cut[-1])
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + l2)
        margin += value[leaf]
        for store, x in zip(trees, (feature, cut, value)):
            store.append(x)
    return Trees(base, *(np.array(x) for x in trees))
