"""Gradient-boosted trees over binned features, for training sets that fit in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: a feature and threshold per inner node, a value per leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 1.0) -> Trees:
    """Fit to logistic loss with second-order steps; every split is the best over all features' bins.

    A node without a split that helps sends all rows left. Without rows, all leaves are 0.
    """
    inner = 2**depth - 1
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    if not len(x):
        return Trees(features, thresholds, leaves)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    margin = np.zeros(len(x))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best_gain, best = np.full(width, 1e-9), np.full((width, 2), -1)
            for f in range(d):
                cell = slot * BINS + binned[:, f]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                ga, ha = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[:, len(edges[f]):] = -1
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best_gain
                best_gain[better] = top[better]
                best[better] = np.stack([np.full(width, f), b], axis=1)[better]
            for s, (f, b) in enumerate(best):
                if f >= 0:
                    features[t, first + s], thresholds[t, first + s] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        leaves[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        margin += leaves[t, leaf]
    return Trees(features, thresholds, leaves)
