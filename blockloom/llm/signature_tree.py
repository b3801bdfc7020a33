"""Similar sets by signature trees.

A tree's leaves hold a few sets each, in order of size and smallest element; a
node holds the OR of its sets' bitmaps, the range of their sizes and the most
elements that any of them loses to equal bits.  Two trees, or one with itself,
are walked together: a pair of nodes is left as soon as no two sets below them
can overlap enough.  Only links between different components matter, so pairs
whose sets are all connected already are left as well; a group of thousands of
near copies costs about one comparison a copy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BITS = 4096
LEAF = 16
FAN = 8


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(n_common: int, n_a: int, n_b: int, percent: int) -> bool:
    """Whether the overlap is at least ``percent`` of the union."""
    return 100 * n_common >= percent * (n_a + n_b - n_common)


class Level:
    """Nodes of one height: OR bitmaps, size ranges, most elements lost to equal bits."""

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, lost: np.ndarray):
        self.bits, self.low, self.high, self.lost = bits, low, high, lost

    def above(self, fan: int) -> Level:
        at = np.arange(0, len(self.low), fan)
        return Level(
            np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.lost, at)
        )

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets below nodes a and b may be linked, by sizes and by the largest possible overlap."""
        least = np.maximum(self.low[a], self.low[b])
        fits = percent * least <= 100 * np.minimum(self.high[a], self.high[b])
        most = np.zeros(len(a), dtype=np.int64)
        some = np.flatnonzero(fits)
        for start in range(0, len(some), 4096):
            k = some[start : start + 4096]
            most[k] = np.bitwise_count(self.bits[a[k]] & self.bits[b[k]]).sum(axis=1, dtype=np.int64)
        most += np.minimum(self.lost[a], self.lost[b])
        needed = np.maximum(100 * most >= percent * least, False)
        return fits & needed & ((100 + percent) * most >= percent * (self.low[a] + self.low[b]))


class SignatureTree:
    def __init__(self, sets: Sequence[np.ndarray]):
        bits = np.zeros((len(sets), BITS // 64), dtype=np.uint64)
        for k, s in enumerate(sets):
            row = np.zeros(BITS, dtype=bool)
            row[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
            bits[k] = np.packbits(row).view(np.uint64)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Level(bits, sizes, sizes, lost)]
        self.levels.append(self.levels[0].above(LEAF))
        while len(self.levels[-1].low) > 1:
            self.levels.append(self.levels[-1].above(FAN))

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that may hold linked sets, near ones first."""
        a = b = np.zeros(1, dtype=np.int64)
        for height in range(len(self.levels) - 1, 0, -1):
            level = self.levels[height]
            may = level.possible(a, b, percent) | (a == b)
            a, b = a[may], b[may]
            if height == 1:
                break
            below = len(self.levels[height - 1].low)
            step = np.arange(FAN)
            x = (a[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
            y = (b[:, None, None] * FAN + step[None, None, :] + 0 * step[None, :, None]).ravel()
            keep = (x <= y) & (y < below)
            a, b = x[keep], y[keep]
        order = np.argsort(b - a, kind="stable")
        return a[order], b[order]


def connect(sets: Sequence[np.ndarray], percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Component of each set: the position of one of its sets.

    ``label`` gives components that are known already; with ``side`` only sets
    of different sides are compared.  Sets must not be empty.
    """
    n = len(sets)
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].ravel()
    if n < 2:
        return label
    order = np.array(sorted(range(n), key=lambda k: (len(sets[k]), sets[k][0])))
    tree = SignatureTree([sets[k] for k in order])
    label = label[order]
    side = side[order] if side is not None else None
    a, b = tree.leaf_pairs(percent)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = np.arange(x * LEAF, min(n, (x + 1) * LEAF)), np.arange(y * LEAF, min(n, (y + 1) * LEAF))
        if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
            continue
        p, q = np.repeat(i, len(j)), np.tile(j, len(i))
        keep = (p < q) & (label[p] != label[q])
        if side is not None:
            keep &= side[p] != side[q]
        p, q = p[keep], q[keep]
        may = tree.levels[0].possible(p, q, percent)
        for u, v in zip(p[may].tolist(), q[may].tolist(), strict=True):
            if label[u] != label[v]:
                s, t = sets[order[u]], sets[order[v]]
                if linked(overlap(s, t), len(s), len(t), percent):
                    label[label == label[v]] = label[u]
    out = np.empty(n, dtype=np.int64)
    out[order] = label
    return out
