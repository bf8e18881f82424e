"""A Gray-order hierarchical index over 64-bit fingerprints, for all pairs within a few differing bits.

Upper nodes are masked bit patterns: with at most d differing bits and d + k blocks of bits, any two linked fingerprints agree on at
least k whole blocks, so every link lies under an upper node that fixes k blocks. Fingerprints are dealt to the upper nodes they
match; below each node they are sorted by Gray rank of their bits (neighbours in that order share long patterns) and factored into a
tree of runs, each run holding the bits all its members share. A join descends pairs of runs of one upper node, adding up the
differing bits among the shared bits, and prunes a whole pair of runs as soon as the sum exceeds d.

Everything here is numpy over one batch of rows sorted by upper node, in bounded chunks of pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

FAN = 8
CHUNK = 1 << 18


def blocks(distance: int, agree: int = 2, bits: int = 64) -> list[int]:
    """The masks of distance + agree blocks of nearly equal size."""
    n = distance + agree
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def upper_masks(distance: int, agree: int = 2, bits: int = 64) -> list[int]:
    """Masks of all choices of ``agree`` blocks, as signed longs."""
    masks = [sum(chosen) for chosen in combinations(blocks(distance, agree, bits), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(prints: np.ndarray, group: np.ndarray) -> list[dict]:
    """From the leaves up: shared bits, their values, first and last child, and group of each node."""
    n = len(prints)
    level = {"mask": np.full(n, ~np.uint64(0)), "bits": prints, "lo": np.arange(n), "hi": np.arange(n) + 1, "group": group}
    out = [level]
    while len(level["group"]) > 1:
        g = level["group"]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        if size.max() == 1:
            break
        within = np.arange(len(g)) - np.repeat(first, size)
        lo = np.flatnonzero(within % FAN == 0)
        hi = np.r_[lo[1:], len(g)]
        ones = np.bitwise_and.reduceat(level["bits"] & level["mask"], lo)
        shared = np.bitwise_and.reduceat(level["mask"], lo)
        zeros = np.bitwise_and.reduceat(~level["bits"] & level["mask"], lo)
        shared &= ones | zeros
        level = {"mask": shared, "bits": ones & shared, "lo": lo, "hi": hi, "group": g[lo]}
        out.append(level)
    return out


def linked_pairs(prints: np.ndarray, group: np.ndarray, distance: int, side: np.ndarray | None = None):
    """Yields arrays (i, j), i < j, of rows in one group that differ in at most ``distance`` bits. Rows come sorted by group, then Gray rank.

    With ``side`` (0 or 1 by row), only pairs across the sides are asked for.
    """
    levels = _levels(prints, group)
    top = len(levels) - 1
    root = np.arange(len(levels[top]["group"]))
    stack = [(top, root, root.copy())]
    while stack:
        depth, a, b = stack.pop()
        limit = CHUNK // (FAN * FAN) if depth else CHUNK
        if len(a) > limit:
            stack += [(depth, a[s : s + limit], b[s : s + limit]) for s in range(0, len(a), limit)]
            continue
        level = levels[depth]
        differ = level["bits"][a] ^ level["bits"][b]
        if depth:
            differ &= level["mask"][a] & level["mask"][b]
        near = np.bitwise_count(differ) <= distance
        a, b = a[near], b[near]
        if not len(a):
            continue
        if depth == 0:
            real = a < b if side is None else (a < b) & (side[a] != side[b])
            if real.any():
                yield a[real], b[real]
            continue
        na, nb = level["hi"][a] - level["lo"][a], level["hi"][b] - level["lo"][b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        off = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        ca = level["lo"][a[pair]] + off // nb[pair]
        cb = level["lo"][b[pair]] + off % nb[pair]
        ordered = ca <= cb
        stack.append((depth - 1, ca[ordered], cb[ordered]))


class Forest:
    """Union-find over the rows of one task; only its spanning edges leave the task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            to = self.up[self.up]
            if np.array_equal(to, self.up):
                return to
            self.up = to

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.up, hi, lo)
            kept = self.up[hi] != lo
            a, b = hi[kept], lo[kept]
