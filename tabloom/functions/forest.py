"""A forest of randomised trees with calibrated probabilities, for small numeric inputs."""

from __future__ import annotations

import numpy as np


class CalibratedForest:
    """Extremely randomised trees; the mean leaf shares are calibrated by temperature on rows held out."""

    def __init__(self, trees: list, classes: np.ndarray, temperature: float):
        self.trees, self.classes, self.temperature = trees, classes, temperature

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ids: np.ndarray, n_trees: int = 24, depth: int = 6, least: int = 3, held_out: int = 5, rows_per_tree: int = 20_000) -> CalibratedForest:
        """Rows whose id is divisible by ``held_out`` only calibrate. The same rows give the same forest.

        A tree grows on at most ``rows_per_tree`` rows, drawn anew for each.
        """
        x = np.nan_to_num(x)
        classes = np.unique(y)
        codes = np.searchsorted(classes, y)
        calibrate = ids % held_out == 0
        if calibrate.all() or not calibrate.any() or len(y) < 20:
            calibrate = np.zeros(len(y), dtype=bool)
        train = np.flatnonzero(~calibrate)
        rng = np.random.default_rng(7)
        trees = []
        for _ in range(n_trees):
            own = train if len(train) <= rows_per_tree else rng.choice(train, rows_per_tree, replace=False)
            trees.append(cls._grow(x[own], codes[own], len(classes), depth, least, rng))
        forest = cls(trees, classes, 1.0)
        if calibrate.any():
            raw = forest._raw(x[calibrate])
            target = codes[calibrate]
            grid = np.exp(np.linspace(-1.5, 1.5, 31))
            losses = [-np.log(cls._warm(raw, t)[np.arange(len(target)), target] + 1e-9).mean() for t in grid]
            forest.temperature = float(grid[int(np.argmin(losses))])
        return forest

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, k: int, depth: int, least: int, rng: np.random.Generator):
        counts = np.bincount(y, minlength=k).astype(float)
        leaf = (counts + 0.1) / (counts.sum() + 0.1 * k)
        if depth == 0 or len(y) < 2 * least or (counts > 0).sum() < 2:
            return leaf
        best = None
        for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2 + 1)]:
            low, high = x[:, f].min(), x[:, f].max()
            if low == high:
                continue
            for cut in rng.uniform(low, high, 2):
                left = x[:, f] <= cut
                n = left.sum()
                if n < least or len(y) - n < least:
                    continue
                a, b = np.bincount(y[left], minlength=k), np.bincount(y[~left], minlength=k)
                impurity = n - (a**2).sum() / n + (len(y) - n) - (b**2).sum() / (len(y) - n)
                if best is None or impurity < best[0]:
                    best = (impurity, f, cut, left)
        if best is None:
            return leaf
        _, f, cut, left = best
        grow = CalibratedForest._grow
        return (int(f), float(cut), grow(x[left], y[left], k, depth - 1, least, rng), grow(x[~left], y[~left], k, depth - 1, least, rng))

    @staticmethod
    def _walk(tree, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if isinstance(tree, np.ndarray):
            out[rows] += tree
            return
        f, cut, low, high = tree
        left = x[rows, f] <= cut
        if left.any():
            CalibratedForest._walk(low, x, out, rows[left])
        if not left.all():
            CalibratedForest._walk(high, x, out, rows[~left])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for tree in self.trees:
            self._walk(tree, x, out, np.arange(len(x)))
        return out / len(self.trees)

    @staticmethod
    def _warm(raw: np.ndarray, temperature: float) -> np.ndarray:
        p = (raw + 1e-9) ** (1 / temperature)
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of ``classes``."""
        return self._warm(self._raw(np.nan_to_num(x)), self.temperature)
