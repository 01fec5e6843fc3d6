"""Word shingles as sets of 64-bit hashes.

Words are what ``str.split()`` gives.  A shingle is ``n`` words in a row; a text
with fewer words has one shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Distinct words whose hashes a task keeps.
_KEPT_WORDS = 1 << 16

_known: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > _KEPT_WORDS:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all shingles, in order."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mix(out + words[i : len(words) - width + 1 + i] + np.uint64(i + 1))
    return out


def shingle_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text.split()), n))


def odd_factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """MinHash values, shape (sets, factors). The sets aren't empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    out = np.empty((len(sets), len(factors)), np.uint64)
    for i, a in enumerate(factors):
        out[:, i] = np.minimum.reduceat(every * a, starts)
    return out
