"""Hashes of a text's words, remembered per worker."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers; it starts anew beyond that, with the same results.
REMEMBERED = 200_000
#: What is stripped from a word's ends before it is hashed; a word of nothing else hashes to 0.
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»¿¡„“”‘’…–—"


class _Known(dict):
    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES)
        value = self[word] = (xxhash.xxh64_intdigest(core) | 1) if core else 0
        return value


_known = _Known()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words, without those that are punctuation alone."""
    if len(_known) > REMEMBERED:
        _known.clear()
    words = text.lower().split()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*columns: np.ndarray) -> np.ndarray:
    """One hash of each row of aligned columns, in order."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one of all."""
    n = min(size, len(words))
    if not n:
        return words
    return chain(*[words[i : len(words) - n + 1 + i] for i in range(n)])
