"""Periodic runs: stretches of words that repeat with a period, and texts without them.

A run is a stretch of at least ``MIN_WORDS`` words and two periods in which words one
period apart are equal, and which neither neighbour extends.  For every period p, a run
holds a point of the grid of step ``max(p, MIN_WORDS - p)`` whose word equals that p words
on; the grids of all periods together have about n ln n points (a harmonic sum).  At each
such point the run's bounds are the common extensions to the left and to the right.  Most
extensions end within a few words; the others are asked of difference-cover suffixes
(``suffixes``), built for the texts that need them, of the words and of the words reversed.

Arrow batches are worked on as a whole in slices, grids in pieces: memory is bounded by
the longest text.  No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from veilframe.llm.shared import slices, utf8
from veilframe.llm.suffixes import PERIOD, Suffixes, agree
from veilframe.llm.words import word_bounds

MIN_WORDS = 12
SLICE_BYTES = 2 << 20
#: Grid points worked on at a time.
POINTS = 1 << 20
RUN = StructType().add("start", "long").add("length", "long").add("period", "long")


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, the same for equal words."""
    if not len(starts):
        return np.zeros(0, np.int32)
    cuts = np.stack([starts, ends], 1).ravel().astype(np.int64)  # words and the gaps between them
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    words = pieces.take(pa.array(np.arange(0, len(cuts), 2)))
    return pc.dictionary_encode(words).indices.to_numpy().astype(np.int32)


class _Texts:
    """Codes of many texts in a row, each with a code of its own at both ends."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, chosen: np.ndarray):
        self.sizes = np.diff(docs)[chosen]
        self.first = np.cumsum(self.sizes + 2) - self.sizes - 1
        n = int((self.sizes + 2).sum())
        self.codes = np.full(n, -1, np.int32)
        inside = np.repeat(self.first - docs[:-1][chosen], self.sizes)
        at = np.arange(int(self.sizes.sum())) + np.repeat(docs[:-1][chosen] - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.codes[at + inside] = codes[at]
        free = np.flatnonzero(self.codes < 0)
        self.codes[free] = int(codes.max(initial=0)) + 1 + np.arange(len(free))


class Extensions:
    """Common extensions inside texts; suffixes are sorted when a text first needs them."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray):
        self.given, self.docs = codes, docs
        self.texts = _Texts(codes, docs, np.arange(len(docs) - 1))
        self.index = np.full(len(docs) - 1, -1)
        self.moved = np.zeros(len(docs) - 1, np.int64)
        self.both: list[tuple[Suffixes, Suffixes]] = []
        # past the texts there is room to look ahead; those codes are never reached
        self.ahead = np.concatenate([self.texts.codes, np.zeros(PERIOD, np.int32)])
        self.back = np.concatenate([self.texts.codes[::-1], np.zeros(PERIOD, np.int32)])

    def around(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before ``a`` and ``b``, and from them on, are equal; both are
        positions in ``texts.codes`` of the same text, ``a`` before ``b``."""
        n = len(self.texts.codes)
        left, right = agree(self.back, n - a, n - b, PERIOD), agree(self.ahead, a, b, PERIOD)
        self._sort(np.unique(doc[(left == PERIOD) | (right == PERIOD)]))
        for k in np.unique(self.index[doc]):
            if k >= 0:
                forward, backward = self.both[k]
                size = len(forward.codes) - PERIOD
                on = np.flatnonzero((self.index[doc] == k) & (right == PERIOD))
                shift = self.moved[doc[on]] + PERIOD
                right[on] += forward.common(a[on] + shift, b[on] + shift)
                on = np.flatnonzero((self.index[doc] == k) & (left == PERIOD))
                shift = self.moved[doc[on]] - PERIOD
                left[on] += backward.common(size - (a[on] + shift), size - (b[on] + shift))
        return left, right

    def _sort(self, wanted: np.ndarray) -> None:
        wanted = wanted[self.index[wanted] < 0]
        if len(wanted):
            texts = _Texts(self.given, self.docs, wanted)
            self.index[wanted] = len(self.both)
            self.moved[wanted] = texts.first - self.texts.first[wanted]
            self.both.append((Suffixes(texts.codes), Suffixes(texts.codes[::-1])))


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, i, p`` of the grid points of all periods, in pieces, by doublings of p."""
    low = 1
    while len(chosen := np.flatnonzero((sizes >= 2 * low) & (sizes >= MIN_WORDS))):
        n_periods = np.minimum(2 * low - 1, sizes[chosen] // 2) - low + 1
        doc = np.repeat(chosen, n_periods)
        period = low + np.arange(len(doc)) - np.repeat(np.cumsum(n_periods) - n_periods, n_periods)
        step = np.maximum(period, MIN_WORDS - period)
        points = (sizes[doc] - period - 1) // step + 1
        upto, done = np.cumsum(points), 0
        while done < len(doc):
            before = upto[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(upto, before + POINTS, "right")))
            row = np.repeat(np.arange(done, end), points[done:end])
            nth = np.arange(len(row)) - (upto[row] - points[row] - before)
            yield doc[row], nth * step[row], period[row]
            done = end
        low *= 2


def find_runs(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows ``text, start, end, period`` of all runs, by text, start and period.  The words
    of text ``i`` are ``codes[docs[i]:docs[i + 1]]``."""
    extensions = Extensions(codes, docs)
    first, here = extensions.texts.first, extensions.texts.codes
    # A run that holds a position, to skip points that would only find it again
    period_at, end_at = np.zeros(len(here), np.int32), np.zeros(len(here), np.int64)
    found = [np.zeros((0, 4), np.int64)]
    for doc, i, p in _grid(np.diff(docs)):
        a = first[doc] + i
        hit = np.flatnonzero(here[a] == here[a + p])
        known = period_at[a[hit]]
        again = (known > 0) & (p[hit] % np.maximum(known, 1) == 0) & (a[hit] + p[hit] < end_at[a[hit]])
        hit = hit[~again]
        doc, a, p = doc[hit], a[hit], p[hit]
        left, right = extensions.around(doc, a, a + p)
        long = left + right >= np.maximum(p, MIN_WORDS - p)
        doc, p, start, end = doc[long], p[long], (a - left)[long], (a + p + right)[long]
        new = np.unique(np.stack([doc, start, end, p], 1), axis=0)
        for _, s, e, period in new:
            period_at[s:e], end_at[s:e] = period, e
        new[:, 1:3] -= first[new[:, 0]][:, None]
        found.append(new)
    runs = np.unique(np.concatenate(found), axis=0)  # by text, start, end, period
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)  # multiples of a period give the same stretch
    runs = runs[least]
    return runs[np.lexsort([runs[:, 3], runs[:, 1], runs[:, 0]])]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words of a text without what a run holds after its first period."""
    words = text.split()  # at space and \\t\\n\\v\\f\\r only, being bytes
    if len(runs):
        kept = np.ones(len(words), bool)
        for start, end, period in runs:
            kept[start + period : end] = False
        words = compress(words, kept)
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``runs`` (structs of ``start, length, period`` in words,
    by start and period) and ``collapsed`` (the words joined by one space, less those that
    some run holds after its first period); columns of these names are replaced.

    Words are what lies between space and ``\\t\\n\\v\\f\\r``.  Null and empty texts have no
    runs and collapse to the empty text.  Stretches are given with their smallest period."""
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                offsets, data = utf8(part.column(text))
                starts, ends, docs = word_bounds(offsets, data)
                runs = find_runs(word_codes(data, starts, ends), docs)
                at = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1))
                whole = data.tobytes()
                texts = [_collapsed(whole[offsets[i] : offsets[i + 1]], runs[at[i] : at[i + 1], 1:]) for i in range(part.num_rows)]
                fields = [pa.array(x) for x in (runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3])]
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [listed, pa.array(texts, pa.binary()).cast(pa.string())], [*kept, "runs", "collapsed"])

    schema = docs.select(kept).schema.add("runs", ArrayType(RUN)).add("collapsed", "string")
    return docs.select(kept).mapInArrow(find, schema)
