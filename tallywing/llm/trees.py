"""Histogram gradient-boosted trees on numpy: fitting on binned columns, scoring over flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees as one set of arrays; a tree's nodes are in heap order, node i has 2i+1 and 2i+2 below it.

    `column[t, i]` is -1 where a row stays on the left all the way down; `leaf[t]` has one value for each place
    of the last level.
    """

    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def log_odds(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Log-odds of each row; all rows of a block go down all trees a level at a time."""
        out = np.empty(len(x))
        trees = np.arange(len(self.leaf))[None, :]
        for i in range(0, len(x), block):
            part = x[i : i + block]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                column = self.column[trees, node]
                right = (column >= 0) & (part[rows, column] > self.cut[trees, node])
                node = 2 * node + 1 + right
            out[i : i + block] = self.base + self.leaf[trees, node - self.column.shape[1]].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -60, 60)))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each column: at most bins - 1 quantiles, without repeats."""
    wanted = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], wanted, method="lower")) for j in range(x.shape[1])]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: int = 10,
) -> Forest:
    """Boost logistic loss. Each level sums gradients per node, column and bin, and cuts where the gain is largest.

    Ties go to the first column and cut. With one class only, every row gets that class's smoothed rate.
    """
    n, p = x.shape
    rate0 = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate0 / (1 - rate0)))
    inner, places = 2**depth - 1, 2**depth
    if n < 2 * least or y.min() == y.max():
        return Forest(np.full((1, inner), -1), np.zeros((1, inner)), np.zeros((1, places)), base)
    edges = edges_of(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    wide = binned + np.arange(p)[None, :] * bins
    f, columns, cuts, leaves = np.full(n, base), [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        column, cut, node = np.full(inner, -1), np.zeros(inner), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (p * bins) + wide).ravel()
            shape = (width, p, bins)
            size = width * p * bins
            gs = np.bincount(cell, np.repeat(g, p), size).reshape(shape).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, p), size).reshape(shape).cumsum(2)
            ns = np.bincount(cell, minlength=size).reshape(shape).cumsum(2)
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (nt - ns < least)] = 0
            gain = gain.reshape(width, -1)
            best = gain.argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, best[k]] > 1e-6 and b < len(edges[j]):
                    column[first + k], cut[first + k] = j, edges[j][b]
            at = column[node]
            node = 2 * node + 1 + ((at >= 0) & (x[np.arange(n), at] > cut[node]))
        place = node - inner
        leaf = -rate * np.bincount(place, g, places) / (np.bincount(place, h, places) + ridge)
        f = f + leaf[place]
        columns.append(column)
        cuts.append(cut)
        leaves.append(leaf)
    return Forest(np.array(columns), np.array(cuts), np.array(leaves), base)
