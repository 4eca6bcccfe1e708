"""Gradient-boosted trees on binned features, in numpy: logistic loss, second-order leaf values."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> dict:
    """x: rows by features (float); y: 0 or 1. Plain values: edges by feature, base score, trees as arrays."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node, feature, cut = np.zeros(len(y), int), np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int)
        for level in range(depth):
            for k in range(2**level):
                at = 2**level - 1 + k
                rows = np.flatnonzero(node == k)
                best, gs, hs = 1e-6, g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(e) + 1))[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        if gain.max() > best:
                            best, feature[at], cut[at] = gain.max(), j, gain.argmax()
            at = 2**level - 1 + node
            right = np.where(feature[at] >= 0, b[np.arange(len(y)), np.maximum(feature[at], 0)] > cut[at], False)
            node = 2 * node + right
        leaf = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2) * rate
        f = f + leaf[node]
        out.append((feature, cut, leaf))
    return {"edges": edges, "base": base, "trees": out, "depth": depth}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities."""
    b = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model["edges"])], 1) if len(x) else np.empty((0, len(model["edges"])), int)
    f, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for level in range(model["depth"]):
            at = 2**level - 1 + node
            node = 2 * node + np.where(feature[at] >= 0, b[rows, np.maximum(feature[at], 0)] > cut[at], False)
        f += leaf[node]
    return 1 / (1 + np.exp(-f))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold from which on held-out precision holds; 1 (nothing passes but certainty) if none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= precision)
    return float(p[order][ok[-1]]) if len(ok) else 1.0
