"""Small gradient-boosted trees over integer features, with calibrated scores. NumPy only, deterministic."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier: depth-limited trees fitted to the gradient of the logistic loss, thresholds on feature values."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = x.astype(np.int32), y.astype(float)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p) + 1e-9
            size = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int32), np.zeros(size)
            at = np.zeros(len(y), np.int64)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                if not rows.size:
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + 1.0)
                if node >= (1 << self.depth) - 1 or rows.size < 4:
                    continue
                best = 1e-6
                for f, ts in enumerate(cuts):
                    v = x[rows, f]
                    for t in ts:
                        left = v <= t
                        hl = h[rows][left].sum()
                        if hl < 1e-3 or hs - hl < 1e-3:
                            continue
                        gl = g[rows][left].sum()
                        gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                        if gain > best + 1e-9:
                            best, feature[node], cut[node] = gain, f, t
                if feature[node] >= 0:
                    at[rows] = np.where(x[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            self.nodes.append((feature, cut, value))
            raw += self._tree(x, self.nodes[-1])
        return self

    def _tree(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            if not go.any():
                break
            rows = np.flatnonzero(go)
            at[rows] = np.where(x[rows, f[rows]] <= cut[at[rows]], 2 * at[rows] + 1, 2 * at[rows] + 2)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int32)
        out = np.full(len(x), self.base)
        for t in self.nodes:
            out += self._tree(x, t)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Platt scaling on rows kept apart, then the threshold of the best F1 there (the middle of the best range)."""
        r, y = self.raw(x), y.astype(float)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * r + b)))
            d = p - y
            w = p * (1 - p) + 1e-6
            haa, hab, hbb = (w * r * r).sum() + 1e-2, (w * r).sum(), w.sum() + 1e-2
            ga, gb = (d * r).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b
            det = haa * hbb - hab * hab
            sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - sa, b - sb
            if abs(sa) + abs(sb) < 1e-6:
                break
        self.slope, self.shift = float(a), float(b)
        p = self.predict(x)
        grid = np.linspace(0.05, 0.95, 91)
        f1 = np.array([2 * (y[p >= t]).sum() / max(1.0, (p >= t).sum() + y.sum()) for t in grid])
        self.threshold = float(np.median(grid[f1 >= f1.max() - 1e-12]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))
