"""Gradient-boosted trees for a two-class target, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth: features and thresholds by level order, then leaf values."""

    features: np.ndarray  # trees x (2^depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2^depth
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), "i8")
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, features[at]] > thresholds[at])
            total += leaves[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, least: float = 0.5) -> BoostedTrees:
    """Fits by Newton steps on the logistic loss; each level splits every node where the gain is largest.

    least: the curvature that either side of a split must hold.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2**depth - 1
    out = BoostedTrees(np.zeros((trees, inner), "i8"), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, "i8")
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(place, np.repeat(v, width), many * width * bins).reshape(many, width, bins) for v in (g, h)]
            (left_g, left_h), (all_g, all_h) = ([np.cumsum(s, axis=2) for s in sums], [s.sum(axis=2, keepdims=True) for s in sums])
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                j, cut = divmod(b, bins)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    out.features[t, first + k], out.thresholds[t, first + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), out.features[t, at]] > out.thresholds[t, at])
        leaf = at - inner
        out.leaves[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += out.leaves[t, leaf]
    return out
