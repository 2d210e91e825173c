"""Histogram gradient-boosted trees for yes-or-no labels.

Features are cut into at most 64 bins by quantiles of the training rows; every
level of a tree needs one histogram of gradients for all nodes and features.
Trees are complete and flattened into arrays (node i has the children 2i+1 and
2i+2), so that prediction walks all rows down all trees with array operations.
Fitting works on one bounded sample; the operators state its bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # rows with a value above go right
    value: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.base), int(np.log2(self.value.shape[1]))
        if not len(self.feature):
            return out
        tree = np.arange(len(self.feature))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(tree)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[lo : lo + 4096] += self.value[tree, node - (self.value.shape[1] - 1)].sum(1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders of bins, halfway between the values on both sides."""
    known = np.unique(values)
    at = np.unique(np.searchsorted(known, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    at = at[at + 1 < len(known)]
    return (known[at] + known[at + 1]) / 2


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, reg: float = 1.0, least: float = 2.0, share: float = 0.6) -> Trees:
    """Trees for labels 0 and 1, each from a ``share`` of the features. With no rows, or one label only, a constant."""
    n, width = x.shape
    prior = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    leaves = 1 << depth
    empty = Trees(np.zeros((0, leaves - 1), np.int64), np.zeros((0, leaves - 1)), np.zeros((0, leaves)), base)
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [_cuts(x[:, j], bins) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: above cut b-1, up to cut b
    legal = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    flat = code + bins * np.arange(width)
    margin, trees = np.full(n, base), ([], [], [])
    rng, some = np.random.default_rng(7), max(1, round(share * width))
    for _ in range(rounds):
        out = np.ones(width, bool)
        out[rng.permutation(width)[:some]] = False
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(leaves - 1, np.int64), np.full(leaves - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here = 1 << level
            spot = ((node - (here - 1))[:, None] * (width * bins) + flat).ravel()
            g = np.bincount(spot, np.repeat(grad, width), here * width * bins).reshape(here, width, bins).cumsum(2)
            h = np.bincount(spot, np.repeat(hess, width), here * width * bins).reshape(here, width, bins).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + reg) + (gt - g) ** 2 / (ht - h + reg) - gt**2 / (ht + reg)
            gain[(h < least) | (ht - h < least) | ~legal | out[:, None]] = 0
            best = gain.reshape(here, -1).argmax(1)
            good = gain.reshape(here, -1)[np.arange(here), best] > 1e-9
            for k in np.flatnonzero(good):
                j, b = divmod(int(best[k]), bins)
                feature[here - 1 + k], threshold[here - 1 + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (leaves - 1)
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + reg)
        margin += value[leaf]
        for store, a in zip(trees, (feature, threshold, value)):
            store.append(a)
    return Trees(*map(np.array, trees), base)
