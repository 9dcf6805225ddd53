"""Gradient-boosted trees for a yes-no label: depth-wise trees over binned features, logistic loss."""

from __future__ import annotations

import numpy as np


class Trees:
    """``score`` gives log-odds. A tree is full to its depth; node i has children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> None:
        self.base, self.feature, self.cut, self.value, self.depth = base, feature, cut, value, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2 ** self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32,
        least: float = 5.0) -> Trees:
    """Boost ``trees`` trees; a split needs a Hessian of ``least`` on both sides to be worth taking."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, inner, n_features = np.full(len(y), base), 2 ** depth - 1, x.shape[1]
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.zeros(width)
            cell = (at - first) * (bins + 1)
            right = np.zeros(len(y), bool)
            choice = [(0, bins)] * width
            for j in range(n_features):
                key = cell + binned[:, j]
                gs = np.bincount(key, g, width * (bins + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (bins + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gr, hr = gs.sum(1, keepdims=True) - gl, hs.sum(1, keepdims=True) - hl
                gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - gs.sum(1, keepdims=True) ** 2 / (hs.sum(1, keepdims=True) + 1)
                gain[(hl < least) | (hr < least)] = 0
                top = gain.argmax(1)
                for w in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[w] = gain[w, top[w]]
                    choice[w] = (j, int(top[w]))
            for w, (j, b) in enumerate(choice):
                if best[w] > 0 and b < len(edges[j]):
                    f[first + w], c[first + w] = j, edges[j][b]
                    here = at == first + w
                    right[here] = binned[here, j] > b
            at = 2 * at + 1 + right
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[leaf]
        all_f.append(f), all_c.append(c), all_v.append(value)
    return Trees(base, np.array(all_f), np.array(all_c), np.array(all_v), depth)
