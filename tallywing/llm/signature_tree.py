"""Signature trees: an exact self-join of a bounded block of sets by Jaccard similarity.

Leaves are sets; a node has the OR of its sets' bitmaps, the range of their sizes and the most elements that one of them
lost to shared bits. Two sets under nodes p and q share at most popcount(p & q) elements plus those that bits hide, and
at most the size of the smaller one. A pair of nodes that can't reach the least overlap asked for is left out whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 8


class Groups:
    """Union-find over the members of a block."""

    def __init__(self, labels: np.ndarray):
        self.parent = {int(x): int(x) for x in labels}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def least_overlap(total: np.ndarray | int, similar: int) -> np.ndarray | int:
    """The least overlap o of sets with `total` elements together that has 100 * o >= similar * (total - o)."""
    return -(-similar * total // (100 + similar))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of bits/64 words per set; an element's bit is given by its low bits."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i in range(0, len(sets), 256):
        own = sets[i : i + 256]
        row = np.repeat(np.arange(len(own)), [len(s) for s in own])
        there = np.zeros((len(own), bits), np.uint8)
        there[row, np.concatenate(own) & np.uint64(bits - 1)] = 1
        out[i : i + 256] = np.packbits(there, axis=1, bitorder="little").view("<u8")
    return out


class Tree:
    """Levels of nodes over sets sorted by size; level 0 has a node per set."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.maps, self.low, self.high = [maps], [sizes], [sizes]
        self.hidden = [sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)]
        while len(self.maps[-1]) > FANOUT:
            cuts = np.arange(0, len(self.maps[-1]), FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cuts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))
            self.hidden.append(np.maximum.reduceat(self.hidden[-1], cuts))

    def below(self, level: int, node: int) -> np.ndarray:
        """The nodes one level further down."""
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.maps[level - 1])))

    def possible(self, level: int, p: np.ndarray, q: np.ndarray, similar: int) -> np.ndarray:
        """Matrix of the node pairs under which a pair may be similar enough."""
        low, high, hidden, maps = self.low[level], self.high[level], self.hidden[level], self.maps[level]
        need = least_overlap(low[p][:, None] + low[q][None, :], similar)
        most = np.minimum(high[p][:, None], high[q][None, :])
        ok = (most >= need) & (100 * most >= similar * np.maximum(low[p][:, None], low[q][None, :]))
        if ok.any():
            shared = np.bitwise_count(maps[p][:, None, :] & maps[q][None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= np.minimum(shared + np.minimum(hidden[p][:, None], hidden[q][None, :]), most) >= need
        return ok


def traverse(
    tree: Tree, similar: int, same: Callable[[int, np.ndarray, np.ndarray], np.ndarray], visit: Callable[[np.ndarray, np.ndarray], None]
) -> None:
    """Go down all pairs of nodes that may hold a similar pair and aren't of one group already; `visit` gets the
    pairs of sets (i < j) that are left.

    `same(level, p, q)` is the matrix of the node pairs whose sets are all of one group.
    """
    top = len(tree.maps) - 1
    todo = [(top, np.arange(len(tree.maps[top])), None)]
    while todo:
        level, p, q = todo.pop()
        r = p if q is None else q
        ok = tree.possible(level, p, r, similar) & ~same(level, p, r)
        if q is None:
            ok &= p[:, None] <= r[None, :] if level else p[:, None] < r[None, :]
        a, b = np.nonzero(ok)
        if level == 0:
            if len(a):
                visit(p[a], r[b])
            continue
        # Siblings last in, first out: what stands under one node is joined before pairs of nodes are looked at.
        order = np.argsort(a != b if q is None else np.zeros(len(a)), kind="stable")[::-1]
        for x, y in zip(p[a[order]].tolist(), r[b[order]].tolist(), strict=True):
            todo.append((level - 1, tree.below(level, x), None if x == y else tree.below(level, y)))


def join_sets(sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """Links that connect all sets of a block that similar pairs connect: (i, j) of similar pairs, one per union.

    `sets` are ascending arrays without repeats, none of them empty. Pairs already connected aren't counted again.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    own = [sets[i] for i in order]
    sizes = np.array([len(s) for s in own], np.int64)
    bits = 1 << int(min(max(int(sizes.max()) * 4, 256), 1 << 16) - 1).bit_length()
    tree = Tree(bitmaps(own, bits), sizes)
    groups, links = Groups(np.arange(len(own))), []

    def same(level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        width = FANOUT**level

        def group(node: int) -> int:
            found = {groups.find(i) for i in range(node * width, min((node + 1) * width, len(own)))}
            return found.pop() if len(found) == 1 else -1

        if level and len(own) <= FANOUT:
            return np.zeros((len(p), len(q)), bool)
        gp, gq = np.array([group(i) for i in p.tolist()]), np.array([group(i) for i in q.tolist()])
        return (gp[:, None] == gq[None, :]) & (gp[:, None] >= 0)

    def visit(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if groups.find(x) == groups.find(y):
                continue
            a, b = own[x], own[y]
            both = int(np.isin(a, b, assume_unique=True).sum()) if len(a) < 64 else len(a) + len(b) - len(np.union1d(a, b))
            if both * 100 >= similar * (len(a) + len(b) - both):
                groups.join(x, y)
                links.append((order[x], order[y]))

    traverse(tree, similar, same, visit)
    return links
