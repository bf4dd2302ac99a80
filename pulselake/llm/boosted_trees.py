"""Gradient-boosted trees over dense features in numpy: a small trainer, flat node arrays, isotonic calibration.

Training sees a bounded sample of rows on the driver; the fitted model is a few arrays that tasks use on whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees of a model in one set of node arrays. A leaf points to itself and never goes right."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``: one step of all rows and trees for each level."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[lo : lo + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray | None = None,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    least: int = 8,
    bins: int = 64,
    penalty: float = 1.0,
) -> Forest:
    """Logistic boosting with second-order leaves on binned features.

    ``monotone`` has +1, -1 or 0 per feature: a split on a constrained feature needs ordered leaves, and its children
    are held on either side of the middle, so that no deeper split breaks the order. Without rows the model gives 1/2,
    with one class a constant near it.
    """
    n, width = x.shape
    monotone = np.zeros(width, int) if monotone is None else monotone
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            _grow(nodes, codes, cuts, p - y, p * (1 - p), np.arange(n), depth, monotone, rate, least, bins, penalty, -np.inf, np.inf, margin)
    table = np.array(nodes, float).reshape(-1, 5)
    return Forest(np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], base, depth)


def _grow(nodes, codes, cuts, g, h, rows, depth, monotone, rate, least, bins, penalty, low, high, margin) -> int:
    """Appends the subtree over ``rows``, moves their margins, returns its node number."""
    me = len(nodes)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = float(np.clip(-total_g / (total_h + penalty), low, high))
    nodes.append([0, np.inf, me, me, rate * leaf])
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            c = codes[rows, f]
            gl = np.cumsum(np.bincount(c, g[rows], bins + 1))[: len(cut)]
            hl = np.cumsum(np.bincount(c, h[rows], bins + 1))[: len(cut)]
            nl = np.cumsum(np.bincount(c, minlength=bins + 1))[: len(cut)]
            gr, hr = total_g - gl, total_h - hl
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
            wl, wr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (wr - wl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, (wl[k] + wr[k]) / 2))
    if best[1] is None:
        margin[rows] += rate * leaf
        return me
    f, k, middle = best[1]
    goes_left = codes[rows, f] <= k
    bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
    rest = (depth - 1, monotone, rate, least, bins, penalty)
    left = _grow(nodes, codes, cuts, g, h, rows[goes_left], *rest, *bounds[0], margin)
    right = _grow(nodes, codes, cuts, g, h, rows[~goes_left], *rest, *bounds[1], margin)
    nodes[me] = [f, cuts[f][k], left, right, 0.0]
    return me


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from score to probability (pool adjacent violators, ends smoothed off 0 and 1)."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, which = np.unique(score, return_inverse=True)
    total, count = np.bincount(which, y), np.bincount(which)
    pools: list[list[float]] = []
    for s, t, c in zip(at, total, count, strict=True):
        pools.append([s, s, t, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, t2, c2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + t2, pools[-1][3] + c2]
    rate = [(t + 0.05) / (c + 0.5) if t == 0 or t == c else t / c for _, _, t, c in pools]
    knots = np.array([[lo, r] for (lo, _, _, _), r in zip(pools, rate, strict=True)] + [[hi, r] for (_, hi, _, _), r in zip(pools, rate, strict=True)])
    knots = knots[np.lexsort((knots[:, 1], knots[:, 0]))]
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])
