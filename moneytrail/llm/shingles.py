"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

REMEMBERED_WORDS = 300_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted arrays of distinct 64-bit shingle hashes, one hash function for all uses.

    Words are what lies between ASCII white space, with A-Z lower-cased.  A text of fewer words than
    ``width`` is one shingle; one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self._words = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        # Bytes split at exactly the six ASCII white-space characters, and lower changes A-Z alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self._words) > REMEMBERED_WORDS:
            self._words = _Words()
        hashes = np.fromiter(map(self._words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        count = len(words) - width + 1
        total = np.full(count, width, np.uint64)
        for at in range(width):
            total = _mixed(total * _MULTIPLY + hashes[at : at + count])
        return np.unique(total)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers; two empty sets are not similar."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
