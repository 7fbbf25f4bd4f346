"""FM-index over a sequence of small integers, in numpy; many patterns are searched at once."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence keep their place in the suffix array.
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, by doubling the sorted prefix."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.empty(n, dtype=np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class WaveletTree:
    """Bits of a sequence level by level, stably parted by each bit, with counts of ones."""

    def __init__(self, s: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.bits.append(bit.astype(np.int8))
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol lies before each position."""
        begin, end = np.zeros_like(at), at
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            one_begin, one_end = self.ones[i][begin], self.ones[i][end]
            begin = np.where(bit, self.zeros[i] + one_begin, begin - one_begin)
            end = np.where(bit, self.zeros[i] + one_end, end - one_end)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbol at each position."""
        symbol = np.zeros_like(at)
        for i in range(self.levels):
            bit = self.bits[i][at].astype(np.int64)
            ones = self.ones[i][at]
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return symbol


class FmIndex:
    """Backward search over ``s`` (values 1 to ``size`` - 1; 0 ends the sequence)."""

    def __init__(self, s: np.ndarray, size: int):
        s = np.append(s, 0)
        order = suffix_array(s)
        last = s[order - 1]
        self.n = len(s)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        self.tree = WaveletTree(last, size)
        kept = order % SAMPLE == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.is_kept = kept
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each pattern; patterns are rows, flush left."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        rows = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            rows = rows[(lengths[rows] <= k) | (hi[rows] > lo[rows])]
            due = rows[lengths[rows] > k]
            if not len(due):
                continue
            c = patterns[due, k]
            lo[due] = self.below[c] + self.tree.rank(c, lo[due])
            hi[due] = self.below[c] + self.tree.rank(c, hi[due])
        return lo, np.maximum(hi, lo)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Position in the sequence of each suffix, walking back to a sampled one."""
        out = np.zeros(len(at), dtype=np.int64)
        rows, steps = np.arange(len(at)), 0
        while len(rows):
            found = self.is_kept[at]
            out[rows[found]] = self.places[self.kept[at[found]]] + steps
            rows, at = rows[~found], at[~found]
            c = self.tree.access(at)
            at = self.below[c] + self.tree.rank(c, at)
            steps += 1
        return out
