"""Words of texts as arrays of 64-bit hashes, for tasks that compare texts.

A word is a run of bytes other than blank and \\t \\n \\v \\f \\r. Texts come as UTF-8
bytes, whose ``split`` and ``lower`` know exactly these and A-Z.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

from planlens.llm.worker_memory import worker_cache

#: Odd multipliers for sequences, and the constants of a 64-bit finaliser.
_STEP, OTHER_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hash a worker keeps; others are hashed when they occur.
_WORDS_KEPT = 150_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = worker_cache("word hashes", dict)
    out = np.fromiter(map(known.get, words, repeat(0)), np.uint64, len(words))
    gaps = np.flatnonzero(out == 0).tolist()
    if gaps:
        digest = xxhash.xxh3_64_intdigest
        for k in gaps:
            word = words[k]
            h = known.get(word) or digest(word) or 1
            out[k] = h
            if len(word) <= 64 and len(known) < _WORDS_KEPT:
                known[word] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int, step: int = _STEP) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words; none if there are fewer. Another ``step`` gives an independent hash."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(step) + hashes[k : k + n]
    return mix(out)


def shingle_set(body: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of a text in lower case; with fewer words than ``width`` the whole sequence is one."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(width, len(words))))
