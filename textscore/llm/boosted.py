"""Gradient-boosted trees on feature histograms, and their traversal as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in five arrays. Node ``i`` sends a row right when ``x[feature[i]] > limit[i]``; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    children: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row: all rows walk one level of a tree at once."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.limit[node]
                node = self.children[node, right.astype(np.int8)]
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def constant(probability: float) -> Forest:
    none = np.zeros(0, np.int64)
    bias = float(np.log(probability) - np.log1p(-probability))
    return Forest(none, none, np.zeros(0), np.zeros((0, 2), np.int64), np.zeros(0), 0, bias)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        smooth: float = 5.0, least: int = 10) -> Forest:
    """Logistic boosting. Values are cut once into quantile bins; a split is read off gradient sums per bin."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    limits, codes = [], np.zeros((n, width), np.int64)
    for j in range(width):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        limits.append(cuts)
        codes[:, j] = np.searchsorted(cuts, x[:, j], side="left")
    bias = float(np.log(prior) - np.log1p(-prior))
    total = np.full(n, bias)
    feature, limit, children, value, roots = [], [], [], [], []

    def new_node() -> int:
        feature.append(0)
        limit.append(np.inf)
        children.append([len(children)] * 2)
        value.append(0.0)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        root = new_node()
        roots.append(root)
        where = np.full(n, root)
        level = [root]
        for _ in range(depth):
            after = []
            for node in level:
                rows = np.flatnonzero(where == node)
                if len(rows) < 2 * least:
                    continue
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + smooth)
                best = (1e-6, -1, -1)
                for j in range(width):
                    size = len(limits[j]) + 1
                    if size < 2:
                        continue
                    c = codes[rows, j]
                    gl = np.cumsum(np.bincount(c, g, size))[:-1]
                    hl = np.cumsum(np.bincount(c, h, size))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=size))[:-1]
                    gain = gl ** 2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - whole
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] < 0:
                    continue
                _, j, k = best
                feature[node], limit[node] = j, float(limits[j][k])
                left, right = new_node(), new_node()
                children[node] = [left, right]
                where[rows] = np.where(codes[rows, j] > k, right, left)
                after += [left, right]
            level = after
        sums_g, sums_h = np.bincount(where, grad, len(value)), np.bincount(where, hess, len(value))
        for node in np.unique(where):
            value[node] = float(rate * sums_g[node] / (sums_h[node] + smooth))
        total += np.asarray(value)[where]
    return Forest(np.array(roots), np.array(feature), np.array(limit), np.array(children), np.array(value), depth, bias)
