"""Words and word shingles of UTF-8 bytes, hashed to 64 bits inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which are exactly the bytes that bytes.split() drops; bytes.lower()
changes A-Z alone.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5


class Hashes(dict):
    """Word to 64-bit hash; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; of fewer words, one for the whole sequence; of none, empty."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return np.unique(h)
