"""Trees grown on one machine from whole tables, to hold the distributed ones against. Gains come from class counts and are compared to nine decimals."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

from eventide.operators.trees import BINS, UnitTree


class Binned(NamedTuple):
    """Features as numbers of bins, row by row, and the upper limits of each feature's bins."""

    codes: np.ndarray
    limits: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Binned:
        limits, codes = [], np.zeros(x.shape, np.int64)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) > BINS:
                values = np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower"))
                values = np.append(values, np.inf)
            limits.append(values)
            codes[:, f] = np.searchsorted(values, x[:, f])
        return cls(codes, limits)


def _impurity(positive: np.ndarray, total: np.ndarray, kind: str) -> np.ndarray:
    """Of a node, times its weight."""
    p = np.divide(positive, total, out=np.zeros_like(total), where=total > 0)
    if kind == "gini":
        return 2 * p * (1 - p) * total
    q = 1 - p
    return -(p * np.log2(np.where(p > 0, p, 1)) + q * np.log2(np.where(q > 0, q, 1))) * total


def grow(data: Binned, rows: np.ndarray, y: np.ndarray, balanced: bool, impurity: str, max_depth: int, min_rows: int, max_leaves: int) -> UnitTree:
    """A tree over ``rows`` of ``data`` with 0/1 labels ``y`` (of all rows); ties go to the first feature and the least limit."""
    n_features = data.codes.shape[1]
    positive = max(int(y[rows].sum()), 1), max(int((1 - y[rows]).sum()), 1)
    of = (len(rows) / (2 * positive[1]), len(rows) / (2 * positive[0])) if balanced else (1.0, 1.0)
    weight = np.where(y == 1, of[1], of[0])
    offsets = np.arange(n_features) * BINS
    tree = UnitTree([], [], [], [], [])

    def leaf(own: np.ndarray) -> int:
        w = weight[own]
        tree.feature.append(-1)
        tree.limit.append(0.0)
        tree.left.append(-1)
        tree.right.append(-1)
        tree.value.append(int(w[y[own] == 1].sum() > w[y[own] == 0].sum()))
        return len(tree.value) - 1

    def best(own: np.ndarray) -> tuple[float, int, int] | None:
        if len(own) < 2 * min_rows or not 0 < y[own].sum() < len(own):
            return None
        cells = (data.codes[own] + offsets).ravel()
        size = n_features * BINS
        count, hits = (np.cumsum(np.bincount(cells, weights=v, minlength=size).reshape(n_features, BINS), axis=1) for v in (None, np.repeat(y[own], n_features)))
        pos, total = hits * of[1], hits * of[1] + (count - hits) * of[0]
        whole = _impurity(pos[:1, -1], total[:1, -1], impurity)[0]
        gain = whole - _impurity(pos, total, impurity) - _impurity(pos[:, -1:] - pos, total[:, -1:] - total, impurity)
        gain = np.round(gain, 9)
        gain[(count < min_rows) | (count[:, -1:] - count < min_rows)] = -1
        at = int(gain.argmax())
        return (float(gain.flat[at]), at // BINS, at % BINS) if gain.flat[at] > 1e-12 else None

    heap: list[tuple] = []

    def offer(node: int, own: np.ndarray, depth: int) -> None:
        found = best(own) if depth < max_depth else None
        if found:
            heapq.heappush(heap, (-found[0], node, depth, found[1], found[2], own))

    offer(leaf(rows), rows, 0)
    leaves = 1
    while heap and leaves < max_leaves:
        _, node, depth, feature, cut, own = heapq.heappop(heap)
        under = data.codes[own, feature] <= cut
        tree.feature[node], tree.limit[node] = feature, float(data.limits[feature][cut])
        for side, part in ((tree.left, own[under]), (tree.right, own[~under])):
            child = leaf(part)
            side[node] = child
            offer(child, part, depth + 1)
        leaves += 1
    return tree


def f1(y: np.ndarray, guess: np.ndarray) -> float:
    hit = float(((y == 1) & (guess == 1)).sum())
    wrong = float((y != guess).sum())
    return 2 * hit / (2 * hit + wrong) if hit else 0.0


def search(x: np.ndarray, y: np.ndarray, grid: list[dict], fold: np.ndarray) -> tuple[UnitTree, dict, float]:
    """The tree of the settings with the best mean f1 over the folds (the first of equals), fitted to all rows."""
    data, every, folds = Binned.of(x), np.arange(len(y)), int(fold.max()) + 1
    scores = [0.0] * len(grid)
    if len(grid) > 1:
        for i, settings in enumerate(grid):
            for k in range(folds):
                seen, left = every[fold != k], every[fold == k]
                if len(seen) and len(left):
                    scores[i] += f1(y[left], grow(data, seen, y, **settings).predict(x[left])) / folds
    chosen = int(np.argmax(np.round(scores, 9)))
    return grow(data, every, y, **grid[chosen]), grid[chosen], scores[chosen]
