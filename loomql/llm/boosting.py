"""Gradient-boosted trees with logistic loss on binned features, and isotonic regression, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: inner nodes compare a binned feature with a threshold."""

    edges: list[np.ndarray] = field(default_factory=list)  # bin edges of each feature
    features: np.ndarray | None = None  # (trees, inner nodes)
    thresholds: np.ndarray | None = None  # bins; go right if greater
    leaves: np.ndarray | None = None  # (trees, leaves)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting with histograms; ``least`` is the least Hessian sum of a child."""
    model = Boosted()
    for k in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])))
    b = model.bins(x).astype(np.int64)
    rate_of = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model.base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), model.base)
    inner, n_leaves = 2**depth - 1, 2**depth
    feats, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        f_of, t_of, node = np.zeros(inner, np.int64), np.full(inner, bins + 1, np.int64), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (node - first) * (bins + 1)
            best = np.full(width, 1e-6)
            for k in range(x.shape[1]):
                gs = np.bincount(slot + b[:, k], g, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(slot + b[:, k], h, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                won = top > best
                best[won] = top[won]
                f_of[first:][:width][won] = k
                t_of[first:][:width][won] = at[won]
            node = 2 * node + 1 + (b[np.arange(len(y)), f_of[node]] > t_of[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + l2)
        margin += value[leaf]
        feats.append(f_of)
        cuts.append(t_of)
        leaves.append(value)
    model.features, model.thresholds, model.leaves = np.array(feats), np.array(cuts), np.array(leaves)
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the weighted least-squares rising fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    knots, value, weight = [], [], []
    for s, v, one in zip(score[order], y[order].astype(float), weights[order]):
        knots.append([s, s])
        value.append(v)
        weight.append(one)
        while len(value) > 1 and value[-2] >= value[-1]:
            w = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
            weight[-2:] = [w]
            knots[-2:] = [[knots[-2][0], knots[-1][1]]]
    xs = np.array([x for pair in knots for x in pair])
    ys = np.repeat(value, 2)
    return xs, ys
