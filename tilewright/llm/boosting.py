"""Gradient-boosted trees for a few classes, on histograms, in NumPy; deterministic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostedTrees:
    """Complete trees of one depth: ``features`` and ``cuts`` by inner node, ``leaves`` by leaf; a tree's class is its number modulo ``classes``."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    depth: int
    classes: int
    start: np.ndarray

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))
        for t in range(len(self.features)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.features[t, node]] >= self.cuts[t, node])
            scores[:, t % self.classes] += self.leaves[t, node - (1 << self.depth) + 1]
        top = scores.max(axis=1, keepdims=True)
        return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))


def fit(
    x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 24, depth: int = 4, bins: int = 24, rate: float = 0.3, ridge: float = 2.0
) -> BoostedTrees:
    """Softmax boosting with second-order gains."""
    n, wide = x.shape
    edges = []
    for f in range(wide):
        found = np.unique(x[:, f])
        mid = (found[1:] + found[:-1]) / 2
        edges.append(mid if len(mid) < bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    across = int(binned.max()) + 1
    base = np.bincount(y, minlength=classes) + 1.0
    start = np.log(base / base.sum())
    scores = np.tile(start, (n, 1))
    offsets = np.arange(wide) * across
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
            node = np.zeros(n, np.int64)
            tree_f, tree_c = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                slot = ((node - first)[:, None] * (wide * across) + offsets + binned).ravel()
                size = width * wide * across
                sums = [np.bincount(slot, np.repeat(v, wide), size).reshape(width, wide, across) for v in (g, h)]
                left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
                whole = [s.sum(axis=2, keepdims=True) for s in sums]
                right = [w - part for w, part in zip(whole, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                gain[(left[1] < 0.5) | (right[1] < 0.5)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                f, b = best // (across - 1), best % (across - 1)
                worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                for k in range(width):
                    if worth[k] and b[k] < len(edges[f[k]]):
                        tree_f[first + k], tree_c[first + k] = f[k], edges[f[k]][b[k]]
                node = 2 * node + 1 + (x[np.arange(n), tree_f[node]] >= tree_c[node])
            leaf = node - (1 << depth) + 1
            value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            scores[:, c] += value[leaf]
            features.append(tree_f)
            cuts.append(tree_c)
            leaves.append(value)
    return BoostedTrees(np.stack(features), np.stack(cuts), np.stack(leaves), depth, classes, start)
