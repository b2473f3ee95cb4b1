"""Longest common extensions of a sequence of codes, by a difference cover.

Positions whose remainder by ``PERIOD`` lies in ``COVER`` are samples.  Any two positions
reach samples together after fewer than ``PERIOD`` codes, as every difference of remainders
occurs in the cover.  Only the sampled suffixes are sorted (by their first ``PERIOD`` codes,
then by doubling); a sparse table over the common prefixes of neighbours in that order
answers how far two of them agree.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set, every remainder but 0 being one difference of two.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_ORDINAL = np.full(PERIOD, -1)
_ORDINAL[list(COVER)] = range(len(COVER))
#: Entry ``[a, b]``: codes from positions with remainders a and b to samples of both.
_APART = np.array([[min(h for h in range(PERIOD) if (a + h) % PERIOD in COVER and (b + h) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def agree(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many codes from ``a`` and from ``b`` on are equal, ``most`` at most."""
    out = np.minimum(np.full(len(a), PERIOD), most)
    going = np.flatnonzero(out > 0)
    for t in range(PERIOD):
        if not len(going):
            break
        same = codes[a[going] + t] == codes[b[going] + t]
        out[going[~same]] = t
        going = going[same]
        going = going[out[going] > t + 1]
    return out


class Suffixes:
    """``codes``: non-negative numbers.  No two suffixes that are asked about may agree up
    to the end of the sequence, as is the case if texts end with codes of their own."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.concatenate([codes, np.full(PERIOD, int(codes.max(initial=0)) + 1)]).astype(np.int32)
        blocks = np.arange(0, len(codes), PERIOD)[:, None] + np.array(COVER)
        self.samples = blocks.ravel()[: np.count_nonzero(blocks < len(codes))]
        self._sort()
        self._tabulate()

    def _sort(self) -> None:
        m = len(self.samples)
        heads = np.lib.stride_tricks.sliding_window_view(self.codes.astype(">i4"), PERIOD)[self.samples]
        keys = np.ascontiguousarray(heads).view(f"V{4 * PERIOD}").ravel()  # compared as bytes: by code, then by place
        self.ranks, step = [_dense(keys, m)], len(COVER)
        while self.ranks[-1][:m].max(initial=0) < m - 1 and step < m:
            now = self.ranks[-1][:m].astype(np.int64)
            after = np.concatenate([now[step:] + 1, np.zeros(min(step, m), np.int64)])
            self.ranks.append(_dense(now * (m + 1) + after, m))
            step *= 2
        self.rank = self.ranks[-1][:m]

    def _tabulate(self) -> None:
        m = len(self.samples)
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[level][a] == self.ranks[level][b]
            jump = len(COVER) << level
            a[same] = np.minimum(a[same] + jump, m)
            b[same] = np.minimum(b[same] + jump, m)
            common[same] += PERIOD << level
        del self.ranks
        ends = np.append(self.samples, len(self.codes) - PERIOD)
        common += agree(self.codes, ends[a], ends[b], PERIOD)
        rows, width = [common.astype(np.int32)], 1
        while 2 * width <= m - 1:
            last = rows[-1]
            rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.least = np.concatenate(rows)
        self.row = np.cumsum([0] + [len(r) for r in rows])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from positions ``a`` and ``b`` (different ones) on are equal."""
        apart = _APART[a % PERIOD, b % PERIOD]
        out = agree(self.codes, a, b, apart)
        on = np.flatnonzero(out == apart)
        x, y = self._sample_rank(a[on] + apart[on]), self._sample_rank(b[on] + apart[on])
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        row = self.row[level]
        out[on] += np.minimum(self.least[row + low], self.least[row + high - (1 << level)])
        return out

    def _sample_rank(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * len(COVER) + _ORDINAL[at % PERIOD]].astype(np.int64)


def _dense(keys: np.ndarray, m: int) -> np.ndarray:
    """Ranks of keys, equal ones alike, and -1 behind them for what lies past the end."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.full(m + 1, -1, np.int32)
    out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if m else 0
    return out
