"""Vectorised hashing of the words in a buffer of texts."""

from __future__ import annotations

import numpy as np

from tickloom.llm.common import joined

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []

# lower-case letters, digits and bytes of longer characters are word bytes
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _P, dtype=np.uint64)
        down = np.full(size, _P_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, equal for equal bytes wherever they lie."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of non-zero bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = data != 0
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[bytes], prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every word of ``texts`` in order, of its first ``prefix`` bytes, and the index
    of each text's first word."""
    data, starts, _ = joined(texts, b" ")
    folded = FOLD[data]
    begin, end = word_spans(folded)
    whole = hash_spans(folded, begin, end)
    head = hash_spans(folded, begin, np.minimum(begin + prefix, end))
    return whole, head, np.searchsorted(begin, starts)
