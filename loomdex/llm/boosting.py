"""Gradient-boosted trees on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


@dataclass
class Booster:
    """Binary logistic boosting with depth-limited trees."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    depth: int = 4
    rate: float = 0.3

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of small non-negative integers (values over BINS - 1 are clipped)."""
        x = np.minimum(x, BINS - 1).astype(np.intp)
        f = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.intp)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            f += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Booster:
    """Newton boosting; each split is the best of all features and bins by gain."""
    x = np.minimum(x, BINS - 1).astype(np.intp)
    n, d = x.shape
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Booster([], float(np.log(p / (1 - p))), depth, rate)
    f = np.full(n, model.base)
    inner, slot = 2**depth - 1, x + np.arange(d) * BINS
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)
        feature, cut = np.zeros(inner, np.intp), np.full(inner, BINS, np.intp)
        node = np.zeros(n, np.intp)
        for level in range(depth):
            first = 2**level - 1
            for k in range(2**level):
                rows = np.flatnonzero(node == first + k)
                if len(rows) < 8:
                    continue
                flat = slot[rows].ravel()
                gs = np.bincount(flat, np.repeat(g[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                ga, ha = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                best = int(gain.argmax())
                if gain.flat[best] > 1e-4:
                    feature[first + k], cut[first + k] = divmod(best, BINS)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        last = node - inner
        gl, hl = np.bincount(last, g, 2**depth), np.bincount(last, h, 2**depth)
        leaf = -rate * gl / (hl + ridge)
        f += leaf[last]
        model.trees.append((feature, cut, leaf))
    return model
