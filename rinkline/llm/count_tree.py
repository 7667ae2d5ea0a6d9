"""R-tree over count vectors: which points can share enough with a query, by bounds alone.

A point counts a set's elements by hash group. Two sets share at most the sum
over groups of the smaller count; a box of points shares at most the sum of
minima with its upper corner. The tree is packed from points in order of size.
"""

from __future__ import annotations

import numpy as np

LEAF = 16


class CountTree:
    def __init__(self, counts: np.ndarray, num: int, den: int):
        """``counts``: points x groups; a pair must have num/den similarity."""
        self.num, self.den = num, den
        self.size = counts.sum(axis=1)
        # Packed by size, then by the two first coordinates, so that boxes are narrow.
        self.order = np.lexsort((counts[:, 1], counts[:, 0], self.size))
        self.levels = [(counts[self.order], self.size[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            upper, least = self.levels[-1]
            at = np.arange(0, len(upper), LEAF)
            self.levels.append((np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at)))

    def search(self, point: np.ndarray) -> np.ndarray:
        """Places (in the given order) of points whose bound reaches the similarity with ``point``."""
        n = point.sum()
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            shared = np.minimum(upper[at], point).sum(axis=1)
            # shared / (n + other - shared) >= num / den, with the smallest other size in the box
            at = at[shared * (self.num + self.den) >= self.num * (n + least[at])]
            if depth:
                below = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = below[below < len(self.levels[depth - 1][0])]
        return self.order[at]
