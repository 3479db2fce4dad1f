"""Gradient-boosted trees on binned features, in numpy; for training sets of a bounded size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: per tree and inner node a feature and a cut, per leaf a step."""

    start: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    step: list[np.ndarray] = field(default_factory=list)

    def share(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, step in zip(self.feature, self.cut, self.step, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            total += step[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Places to cut a sorted feature: all values but the least where there are few, so that a rare flag can be cut off."""
    kinds = np.unique(values)
    return kinds[1:] if len(kinds) <= bins else np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boost ``rounds`` trees on the logistic loss; a constant where there is only one label."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    if len(np.unique(y)) < 2:
        return model
    cuts = [_cuts(np.sort(x[:, f]), bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            place = np.zeros(width, np.int64)
            local = at - first
            for f, c in enumerate(cuts):
                size = len(c) + 1
                key = local * size + binned[:, f]
                gs, hs = (np.bincount(key, w, width * size).reshape(width, size).cumsum(1) for w in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1e-2) | (ht - hl < 1e-2)] = 0
                if gain.shape[1]:
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[np.arange(width), top][better]
                    feature[first : first + width][better], place[better] = f, top[better]
                    cut[first : first + width][better] = c[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] >= cut[at])
        leaf = at - (2**depth - 1)
        step = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.step.append(step)
        total += step[leaf]
    return model
