"""Gradient-boosted trees for two classes, on binned features, for small training sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    cuts: list[np.ndarray]  # bin borders of each feature
    start: float
    feature: np.ndarray  # tree x inner node; complete binary trees in heap order
    border: np.ndarray  # a row goes right if its bin is above
    value: np.ndarray  # tree x leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.cuts)
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, border, value in zip(self.feature, self.border, self.value, strict=True):
            at = np.zeros(len(x), int)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (binned[rows, feature[at]] > border[at])
            total += value[at - inner]
        return total


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]).astype(np.uint8)


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0
) -> Trees:
    """Logistic loss; splits by the second-order gain over feature histograms."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = _binned(x, cuts)
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    features, borders, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, border = np.zeros(inner, int), np.full(inner, 255)
        at = np.zeros(len(y), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows):
                gr, hr, sub = g[rows], h[rows], binned[rows]
                base = gr.sum() ** 2 / (hr.sum() + ridge)
                for k in range(x.shape[1]):
                    size = len(cuts[k]) + 1
                    if size < 2:
                        continue
                    gs = np.cumsum(np.bincount(sub[:, k], gr, size))[:-1]
                    hs = np.cumsum(np.bincount(sub[:, k], hr, size))[:-1]
                    gain = gs**2 / (hs + ridge) + (gr.sum() - gs) ** 2 / (hr.sum() - hs + ridge) - base
                    top = int(gain.argmax())
                    if gain[top] > best:
                        best, feature[node], border[node] = gain[top], k, top
                at[rows] = 2 * node + 1 + (sub[:, feature[node]] > border[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        features.append(feature)
        borders.append(border)
        values.append(value)
    return Trees(cuts, start, np.array(features), np.array(borders), np.array(values))
