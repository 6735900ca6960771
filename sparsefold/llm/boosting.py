"""Gradient-boosted trees for a few classes, in NumPy.

Each tree is symmetric: one (feature, threshold) test per level, so a row's leaf is the number that its test results spell
and scoring is a handful of array operations per tree. One logistic ensemble per class; probabilities are normalised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for f, t in zip(self.features, self.thresholds, strict=True):
            at = 2 * at + (x[:, f] > t)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.leaves[self.leaf(x)]


@dataclass(frozen=True)
class Boosted:
    """Per class its prior log-odds and trees."""

    priors: tuple[float, ...]
    trees: tuple[tuple[Tree, ...], ...]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        raw = np.stack([p + sum((t.score(x) for t in trees), np.zeros(len(x))) for p, trees in zip(self.priors, self.trees, strict=True)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.log(np.maximum(p / p.sum(axis=1, keepdims=True), 1e-9))


def _tree(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float, rate: float, among: np.ndarray) -> Tree:
    n = len(binned)
    bins = max(len(e) for e in edges) + 1
    at, picked_f, picked_t = np.zeros(n, np.int64), [], []
    for level in range(depth):
        leaves, best = 1 << level, (-1.0, 0, 0)
        for f in among.tolist():
            if not len(edges[f]):
                continue
            slot = at * bins + binned[:, f]
            g = np.bincount(slot, gradient, leaves * bins).reshape(leaves, bins).cumsum(axis=1)
            h = np.bincount(slot, hessian, leaves * bins).reshape(leaves, bins).cumsum(axis=1)
            left = g[:, :-1] ** 2 / (h[:, :-1] + ridge)
            right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
            gain = (left + right).sum(axis=0)[: len(edges[f])]
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        _, f, k = best
        threshold = edges[f][k] if len(edges[f]) else np.inf
        picked_f.append(f)
        picked_t.append(threshold)
        at = 2 * at + (x[:, f] > threshold)
    size = 1 << depth
    leaves = rate * np.bincount(at, gradient, size) / (np.bincount(at, hessian, size) + ridge)
    return Tree(np.array(picked_f), np.array(picked_t), leaves)


def fit(x: np.ndarray, y: np.ndarray, classes: int, trees: int = 40, depth: int = 6, rate: float = 0.3, ridge: float = 5.0, bins: int = 32, share: float = 0.5) -> Boosted:
    """Fit on rows x (features) and y (class numbers); the same input gives the same model.

    Each tree is grown on a share of the rows and of the features, drawn with a fixed seed.
    """
    draw = np.random.default_rng(0)
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    priors, forests = [], []
    for c in range(classes):
        target = (y == c).astype(float)
        known = min(max(target.mean(), 1e-4), 1 - 1e-4)
        prior = float(np.log(known / (1 - known)))
        score, grown = np.full(len(x), prior), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            some = np.flatnonzero(draw.random(len(x)) < share) if share < 1 else np.arange(len(x))
            among = np.sort(draw.permutation(x.shape[1])[: max(1, int(np.ceil(share * x.shape[1])))])
            tree = _tree(x[some], binned[some], edges, (target - p)[some], (p * (1 - p))[some], depth, ridge, rate, among)
            grown.append(tree)
            score = score + tree.score(x)
        priors.append(prior)
        forests.append(tuple(grown))
    return Boosted(tuple(priors), tuple(forests))
