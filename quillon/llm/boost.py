"""Small gradient-boosted trees: fitted on the driver on a bounded table of
candidate features, scored as a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    base: float
    trees: list  # nested (feature, threshold, left, right), leaves are floats
    names: list[str]

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if isinstance(tree, float):
                return np.full(len(rows), tree)
            feature, threshold, left, right = tree
            small = rows[:, feature] <= threshold
            out = np.empty(len(rows))
            out[small], out[~small] = walk(left, rows[small]), walk(right, rows[~small])
            return out

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, field: Callable[[str], str] = lambda name: name) -> str:
        """The probability, inside whole-stage code. One expression text, as hundreds
        of nodes take seconds to make one by one; ``field`` says where a feature stands."""

        def walk(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            feature, threshold, left, right = tree
            return f"CASE WHEN {field(self.names[feature])} <= {threshold!r}D THEN {walk(left)} ELSE {walk(right)} END"

        return f"1D / (1D + exp(-({' + '.join([f'{self.base!r}D', *map(walk, self.trees)])})))"


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 4.0) -> Boosted:
    """Newton boosting of the logistic loss with exact splits."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(rate * total_g / (total_h + 1.0))
        if left_depth == 0 or len(rows) < 2 * least:
            return leaf
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            value = x[order, f]
            cg, ch = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            open_ = value[1:] > value[:-1]
            if not open_.any():
                continue
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
            gain = np.where(open_, gain, -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((value[i] + value[i + 1]) / 2))
        if best[1] is None:
            return leaf
        small = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[small], g, h, left_depth - 1), grow(rows[~small], g, h, left_depth - 1))

    model = Boosted(base, trees, names)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        if isinstance(tree, float):
            break
        trees.append(tree)
        score = score + Boosted(0.0, [tree], names).margin(x)
    return model
