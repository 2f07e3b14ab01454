"""Word shingles of whole texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 400_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingles of ``words`` words.

    Words are what stands between runs of space, tab and line breaks, with A-Z lower-cased. A
    text of fewer words is one shingle; one without words has none.
    """

    def __init__(self, words: int):
        self.words, self.hashes = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # For bytes, both methods know ASCII letters and ASCII white space only.
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        hashes = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(words))
        out = np.full(len(words) - size + 1, np.uint64(size))
        for k in range(size):
            out = mixed(out * _MIX[0] + hashes[k : len(hashes) - size + 1 + k])
        return np.unique(out)
