"""Words and word n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``.  Words are hashed by
polynomials modulo 2^64 over random byte values, taken from prefix sums, and then
mixed; n-grams combine the hashes of their words.  Two given different n-grams share
a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import functools

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTES = numbers(256, 1)
_BASE = int(numbers(1, 2)[0])
_PLACES = numbers(64, 3)


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        factors = np.full(1 << bits, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, docs)``: byte bounds of all words; words ``docs[i]`` to
    ``docs[i + 1]`` are those of text ``i``."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = word[at]
    at = offsets[1:][full] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        n = int(ends[j - 1] - low)
        powers, inverses = _powers(max(21, n.bit_length()))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[low : low + n]] * powers[:n], out=prefix[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (prefix[b] - prefix[a]) * inverses[a]
        i = j
    return mix(out)


def ngrams(words: np.ndarray, docs: np.ndarray, n: int, whole_if_shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of all word n-grams in order.  Texts with 1 to n - 1 words give
    their whole sequence as one if ``whole_if_shorter``, else none."""
    counts = np.diff(docs)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(docs[1:], counts) - np.arange(len(words))  # words from here to the text's end
    valid = left >= n
    if whole_if_shorter:
        heads = docs[:-1][(counts > 0) & (counts < n)]
        valid[heads] = True
    at = np.flatnonzero(valid)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.full(len(at), n, np.uint64)
    for j in range(n):
        total += np.where(left[at] > j, padded[at + j], np.uint64(0)) * _PLACES[j]
    return doc[at], mix(total)


def distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(doc, value)`` sorted by both, and how often each occurs; ``doc`` is
    non-decreasing."""
    if not len(doc):
        return doc, values, np.zeros(0, np.int64)
    order = np.argsort(values)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return doc[at], values[at], np.diff(np.append(at, len(doc)))
