"""Word shingles as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(x, -1, 1 << 64)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(_inverse(int(_BASE))), np.uint64)]))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_WORD = np.ones(256, bool)
_WORD[:128] = [chr(c).isalnum() for c in range(128)]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order: lower case, runs of letters and digits (any non-ASCII character counts as a letter)."""
    a = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    word = _WORD[a]
    step = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of `words` words; a text with fewer words, but some, is one shingle."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    if len(w) < words:
        h = mixed(np.cumsum(w * np.arange(3, 2 * len(w) + 3, 2, dtype=np.uint64))[-1:] + np.uint64(len(w)))
        return h
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = (h + w[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(mixed(h))
