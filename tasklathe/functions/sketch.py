"""Count-min sketch with conservative update: bounded memory, never an underestimate."""

from __future__ import annotations

import math

import numpy as np

# The default error settings, and the widest row allowed.
EPSILON, DELTA = 0.00005, 0.00001
MAX_WIDTH = 1 << 20
CHUNK = 4096  # arrivals that are looked at together


def dimensions(epsilon: float = EPSILON, delta: float = DELTA) -> tuple[int, int]:
    """(depth, width): rows for the confidence, and a power of two of counters for the error."""
    depth = max(1, math.ceil(math.log(1 / delta)))
    width = 1 << math.ceil(math.log2(math.e / epsilon))
    return depth, min(width, MAX_WIDTH)


class CountMin:
    """Counts of 64-bit hashes; an estimate exceeds the truth by more than epsilon * total with probability delta at most."""

    def __init__(self, epsilon: float = EPSILON, delta: float = DELTA):
        self.depth, self.width = dimensions(epsilon, delta)
        self.cells = np.zeros((self.depth, self.width), np.int64)
        self._odd = np.random.default_rng(11).integers(1, 2**63, self.depth, dtype=np.uint64) | np.uint64(1)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        return ((h[None, :] * self._odd[:, None]) >> np.uint64(64 - int(math.log2(self.width)))).astype(np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Add hashes one after the other; returns the estimate after each.

        Only hashes that share a counter depend on each other's order: in a
        chunk of arrivals they go one by one, all others at once.
        """
        counts = np.ones(len(hashes), np.int64) if counts is None else np.asarray(counts, np.int64)
        out = np.empty(len(hashes), np.int64)
        rows = np.arange(self.depth)[:, None]
        for s in range(0, len(hashes), CHUNK):
            h, n, o = hashes[s : s + CHUNK], counts[s : s + CHUNK], out[s : s + CHUNK]
            own, which = np.unique(h, return_inverse=True)
            at = self._at(own)
            _, cell, used = np.unique(at + rows * self.width, return_inverse=True, return_counts=True)
            shared = (used[cell.reshape(at.shape)] > 1).any(0)
            # arrivals of a hash by itself: its least counter, and what has come since
            order = np.argsort(which, kind="stable")
            total = np.cumsum(n[order])
            heads = np.flatnonzero(np.append(True, np.diff(which[order]) != 0))
            before = np.repeat(total[heads] - n[order][heads], np.diff(np.append(heads, len(order))))
            least = self.cells[rows, at].min(0)
            o[order] = least[which[order]] + total - before
            free = np.flatnonzero(~shared)
            most = least[free] + np.bincount(which, n, len(own)).astype(np.int64)[free]
            self.cells[rows, at[:, free]] = np.maximum(self.cells[rows, at[:, free]], most)
            for i in np.flatnonzero(shared[which]):
                place = rows[:, 0], at[:, which[i]]
                o[i] = self.cells[place].min() + n[i]
                self.cells[place] = np.maximum(self.cells[place], o[i])
        return out

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return self.cells[np.arange(self.depth)[:, None], self._at(hashes)].min(0)
