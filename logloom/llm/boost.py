"""Small gradient-boosted trees for 0/1 labels, fitted on a bounded table and scored as a DataFrame expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Leaves of (feature, cut) and, on either side of it, (feature, cut, value at or below, value above)."""

    feature: int
    cut: int
    low: tuple[int, int, float, float]
    high: tuple[int, int, float, float]

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, self.feature] <= self.cut, side(self.low), side(self.high))

    def column(self, names: list[str]) -> Column:
        side = lambda s: F.when(F.col(names[s[0]]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
        return F.when(F.col(names[self.feature]) <= self.cut, side(self.low)).otherwise(side(self.high))


def best_cut(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int, int, float, float]:
    """Gain, feature, cut and both Newton steps of the best split of these rows."""
    total_g, total_h = grad.sum(), hess.sum()
    best = (0.0, 0, int(x[:, 0].max()) if len(x) else 0, total_g / (total_h + ridge), 0.0)
    for f in range(x.shape[1]):
        bins = int(x[:, f].max()) + 1 if len(x) else 1
        g, h = (np.cumsum(np.bincount(x[:, f], v, bins))[:-1] for v in (grad, hess))
        if not len(g):
            continue
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, k, g[k] / (h[k] + ridge), (total_g - g[k]) / (total_h - h[k] + ridge))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, rate: float = 0.4, ridge: float = 1.0) -> list[Tree]:
    """Depth-2 trees by Newton boosting of the logistic loss; x holds small whole numbers."""
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        _, f, cut, _, _ = best_cut(x, grad, hess, ridge)
        low = x[:, f] <= cut
        sides = [best_cut(x[m], grad[m], hess[m], ridge) for m in (low, ~low)]
        leaf = [(s[1], s[2], rate * float(s[3]), rate * float(s[4])) for s in sides]
        out.append(Tree(f, cut, leaf[0], leaf[1]))
        margin += out[-1].values(x)
    return out


def margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.values(x) for t in trees), np.zeros(len(x)))


def margin_column(trees: list[Tree], names: list[str]) -> Column:
    out = F.lit(0.0)
    for t in trees:
        out = out + t.column(names)
    return out


def calibrated_cut(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on held-out rows have that precision; infinite if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, right = scores[order], np.cumsum(y[order])
    ok = (right / np.arange(1, len(s) + 1) >= precision) & np.append(s[1:] < s[:-1], True)
    return float((s[ok][-1] + (s[np.flatnonzero(ok)[-1] + 1] if np.flatnonzero(ok)[-1] + 1 < len(s) else s[ok][-1] - 1)) / 2) if ok.any() else float("inf")
