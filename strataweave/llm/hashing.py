"""Word and shingle hashes for Arrow-batched operators."""

from __future__ import annotations

import numpy as np

CACHE_WORDS = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words, kept for words seen lately (``CACHE_WORDS`` at most); seeds give independent ones."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * MULTIPLIER


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= MULTIPLIER
        out += hashes[k : k + n]
    return mixed(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; of fewer words than ``width``, the whole sequence is one."""
    if len(hashes) < width:
        return windows(hashes, len(hashes)) if len(hashes) else hashes
    return np.unique(windows(hashes, width))
