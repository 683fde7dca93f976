"""Gradient-boosted symmetric trees for a binary target, on numpy alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Each tree asks `depth` questions (feature > threshold) of all rows; the answers number a leaf."""

    features: np.ndarray  # trees x depth
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2**depth
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for k in range(len(f)):
                at |= (x[:, f[k]] > t[k]).astype(np.int64) << k
            out += leaf[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.int64)
    d, width = x.shape[1], bins + 1
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    logit = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p) + 1e-6
        leaf = np.zeros(len(y), np.int64)
        fs, ts = [], []
        for k in range(depth):
            best = (-1.0, 0, 0)
            n = 1 << k
            for f in range(d):
                if not len(cuts[f]):
                    continue
                key = leaf * width + binned[:, f]
                gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                gl, hl = gs[:, : len(cuts[f])], hs[:, : len(cuts[f])]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = (gl * gl / (hl + ridge) + gr * gr / (hr + ridge)).sum(0)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), f, c)
            _, f, c = best
            fs.append(f)
            ts.append(cuts[f][c])
            leaf |= (binned[:, f] > c).astype(np.int64) << k
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        logit += value[leaf]
        features.append(fs)
        thresholds.append(ts)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
