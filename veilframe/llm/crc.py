"""CRC-32 of many byte strings at once, in numpy.

CRC-32 is linear: the checksum of two strings put together is that of the first, moved on
by the length of the second, XORed with that of the second.  Moving on by ``n`` bytes is a
look-up of the four bytes of a checksum in a table for ``n``.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Lengths that have a table; longer moves are made of several.
MOST = 255
#: Longer strings are left to zlib.
VECTOR_BYTES = 48


@functools.lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """The checksum register after one more byte, by its lowest byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


@functools.lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """Entry ``1024 * n + 256 * k + b``: byte ``b`` at place ``k`` moved on by ``n`` bytes."""
    step = _steps()
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    out = np.empty((MOST + 1, 1024), np.uint32)
    for n in range(MOST + 1):
        out[n] = now
        now = step[now & 255] ^ (now >> 8)
    return out.ravel()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums moved on by ``n`` bytes each."""
    crc, n = crc.copy(), n.copy()
    while (far := np.flatnonzero(n > MOST)).size:
        crc[far] = _look_up(crc[far], np.full(len(far), MOST))
        n[far] -= MOST
    return _look_up(crc, n)


def _look_up(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    table, at = _moves(), n.astype(np.int64) << 10
    return table[at + (crc & 255)] ^ table[at + (256 + (crc >> 8 & 255))] ^ table[at + (512 + (crc >> 16 & 255))] ^ table[at + (768 + (crc >> 24))]


def joined(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """Checksums of pairs of strings put together."""
    return moved(first, second_bytes) ^ second


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of ``data[starts[i]:ends[i]]``."""
    step = _steps()
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, VECTOR_BYTES + 1), kind="stable")
    long = int(np.count_nonzero(sizes > VECTOR_BYTES))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = order[long:]
    at, left = starts[order], sizes[order]  # longest first: those still going on are a prefix
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    going = len(order)
    for k in range(int(left[0]) if len(left) else 0):
        going = int(np.searchsorted(-left[:going], -k))  # left > k
        now = state[:going]
        state[:going] = step[(now ^ data[at[:going] + k]) & 255] ^ (now >> 8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out
