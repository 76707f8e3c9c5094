"""Words of a text as numbers, and content-selected places in them."""

import re
from functools import cache

import numpy as np
import xxhash

_BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
LONG_TEXT = 4_000_000
KNOWN_WORDS = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes by word; a bounded cache of what this worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of a text in UTF-8: A-Z lower-cased, split at ASCII blanks."""
    text, known = text.lower(), _hashes()
    if len(text) <= LONG_TEXT:
        words = text.split()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.fromiter((known[m.group()] for m in _BLANK.finditer(text)), np.uint64)


def kmer_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, well mixed, so that its order is as good as random.

    Of a table, one text per column.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros((n, *h.shape[1:]), np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def minimisers(order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the leftmost least value of each ``window`` values in a row.

    Returns each place once, with the first and the last window that it is least in; every window
    belongs to exactly one place, which depends on the values in the window alone.
    """
    n = len(order) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    least = []
    for a in range(0, n, 200_000):
        some = order[a : min(a + 200_000, n) + window - 1]
        view = np.lib.stride_tricks.sliding_window_view(some, window)
        least.append(view.argmin(axis=1) + np.arange(a, a + len(view)))
    at = np.concatenate(least)
    first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    return at[first], first, np.append(first[1:] - 1, n - 1)
