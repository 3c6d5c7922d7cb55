"""R-tree over count vectors: bounds the overlap of two bags by summed coordinate minima."""

from __future__ import annotations

import numpy as np

LEAF = 64


def overlap_needed(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least intersection of sets of sizes n and m with ``100 * inter >= percent * union``."""
    return -(-percent * (n + m) // (100 + percent))


class CountRTree:
    """Points are count vectors (rows); built by median splits of the widest coordinate.

    A node keeps the coordinate maxima of its points and their least size.  A
    point below can share at most the sum of min(query, maxima) with a query.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(axis=1, dtype=np.int64)
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points))

    def _build(self, lo: int, hi: int):
        own = self.order[lo:hi]
        box = self.points[own].max(axis=0)
        if hi - lo <= LEAF:
            return box, int(self.sizes[own].min()), lo, hi, None
        spread = box - self.points[own].min(axis=0)
        half = (hi - lo) // 2
        self.order[lo:hi] = own[np.argpartition(self.points[own, int(spread.argmax())], half)]
        return box, int(self.sizes[own].min()), lo, hi, (self._build(lo, lo + half), self._build(lo + half, hi))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Points whose bound allows the similarity; the query itself is among them if it is a point."""
        size, found, stack = int(query.sum(dtype=np.int64)), [], [self.root]
        while stack:
            box, least, lo, hi, below = stack.pop()
            bound = int(np.minimum(query, box).sum(dtype=np.int64))
            if bound < overlap_needed(size, least, percent) or 100 * bound < percent * size:
                continue
            if below:
                stack += below
                continue
            own = self.order[lo:hi]
            shared = np.minimum(self.points[own], query).sum(axis=1, dtype=np.int64)
            found.append(own[shared >= overlap_needed(self.sizes[own], size, percent)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)
