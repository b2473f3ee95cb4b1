"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Templates are cut into word n-grams; of every ``WINNOW`` neighbouring n-gram hashes the
least (the rightmost in a tie) becomes a fingerprint, in an index from hash to template
and position.  A text that shares ``GRAM + WINNOW - 1`` words in a row with a template
holds one of its fingerprints.  A hit says on which diagonal the template may lie; hits
on near diagonals make a region, in which a local alignment of the words, kept to a band
around the diagonals, gives a piece: the matched words.  Where words were put in or left
out, a match has several pieces; those that follow each other in text and template are
chained.  Licenses share most of their words, so of matches of different templates that
lie on each other the best stays, and words that tell one license from another can be
asked for, or barred.

The index is as large as the templates.  Texts are looked up in numpy over whole Arrow
batches; only those with hits are read word by word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.shared import slices, utf8
from veilframe.llm.words import LOWER, ngrams, word_bounds, word_hashes

GRAM, WINNOW = 3, 2
#: Words by which an alignment may leave its diagonals: a quarter of the template, from
#: one to this many.
BAND = 8
#: Least share of a template's words that must match; of templates of ``SHORT`` words at
#: most, one word may miss.
MIN_COVERAGE, SHORT = 0.7, 16
#: What a template's word that misses takes from a match, in matched words.
MISSING = 0.25
#: Bound of the templates, which every task holds.
MAX_TEMPLATE_WORDS = 1_000_000
SLICE_BYTES = 2 << 20

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Other bytes become spaces, A-Z lower case.
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

MATCH, MISMATCH, GAP = 2, -1, -1


def hashed_grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, hash)`` of all n-grams, then the start of every word and the texts' word
    bounds."""
    data = _PLAIN[data]
    starts, ends, docs = word_bounds(offsets, data)
    return *ngrams(word_hashes(data, starts, ends), docs, GRAM, whole_if_shorter=False), starts, docs


class Templates:
    """The inverted index: fingerprints, sorted, with template and word position."""

    def __init__(self, templates: list[tuple[str, str]], terms: dict[str, tuple[str, str]] | None = None):
        self.names = [name for name, _ in templates]
        self.words = [[w.lower() for w in _WORD.findall(text.encode())] for _, text in templates]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("too many templates for one index")
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template has at least {GRAM} words")
        self.least = [max(MIN_COVERAGE * len(w), len(w) - 1 if len(w) <= SHORT else 0) for w in self.words]
        given = [(terms or {}).get(name, ("", "")) for name in self.names]
        self.needed, self.barred = ([set(t[i].encode().split()) for t in given] for i in (0, 1))
        hashes, owners, places = [], [], []
        for t, (_, text) in enumerate(templates):
            data = np.frombuffer(text.encode(), np.uint8)
            values = hashed_grams(np.array([0, len(data)]), data)[1]
            for place in winnowed(values):
                hashes.append(values[place])
                owners.append(t)
                places.append(place)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.owners, self.places = np.array(owners, int)[order], np.array(places, int)[order]

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position in values, entry of the index)`` of all hits."""
        first = np.searchsorted(self.hashes, values, "left")
        at = np.flatnonzero((first < len(self.hashes)) & (self.hashes[np.minimum(first, len(self.hashes) - 1)] == values)) if len(self.hashes) else np.zeros(0, int)
        n = np.searchsorted(self.hashes, values[at], "right") - first[at]
        entry = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), entry


def winnowed(values: np.ndarray) -> list[int]:
    """Positions of the fingerprints of a template's n-gram hashes."""
    window = min(WINNOW, len(values))
    return sorted({max(range(i, i + window), key=lambda j: (-int(values[j]), j)) for i in range(len(values) - window + 1)})


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> list[tuple[int, int]]:
    """Matched ``(template position, word)`` of the best local alignment whose diagonals
    (word minus template position) are within ``low`` to ``high``; the most matched words
    win among equal scores, then the earliest end."""
    width = high - low + 1
    # a cell: (score, matched, path); a path: (template position, word, path before);
    # column c of row t is the word t + low + c
    none = (0, 0, None)
    best = none
    above = [none] * (width + 1)
    for t, wanted in enumerate(template):
        row, left = [none] * (width + 1), none
        for c in range(width):
            w = t + low + c
            if not 0 <= w < len(words):
                left = none
                continue
            score, matched, path = above[c]  # the diagonal neighbour is in the same column
            if words[w] == wanted:
                cell = (score + MATCH, matched + 1, (t, w, path))
            else:
                cell = (score + MISMATCH, matched, path)
            up = above[c + 1]
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, up[1], up[2])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, left[1], left[2])
            if cell[0] <= 0:
                cell = none
            row[c] = left = cell
            if cell[:2] > best[:2]:
                best = cell
        above = row
    pairs, path = [], best[2]
    while path:
        pairs.append(path[:2])
        path = path[2]
    return pairs[::-1]


def chained(pieces: list[list[tuple[int, int]]], length: int) -> Iterator[tuple[int, int, int]]:
    """``(matched words, first word, end word)`` of the best chains that end with each piece.

    Pieces of a chain follow each other in text and template, with a template's length of
    other words between them at most; where two overlap, the cut that keeps most words
    is made.  Pieces that suffice by themselves are copies of their own: a chain has one
    of them at most."""
    behind: list[tuple[list, dict]] = []  # pieces that may still be followed, with their chains
    for piece in sorted(filter(None, pieces), key=lambda p: (p[0][1], p[-1][1])):
        places, at = [t for t, _ in piece], [w for _, w in piece]
        enough = len(piece) >= MIN_COVERAGE * length
        # by whether a piece suffices: (matched, first word, first pair that is used)
        chains = {enough: (len(piece), at[0], 0)}
        behind = [b for b in behind if b[0][-1][1] + length >= at[0] - 1]
        for before, theirs in behind:
            for other, (matched, first, used) in theirs.items():
                if other and enough:
                    continue
                for p in range(len(before) - 1, used - 1, -1):
                    t, w = before[p]
                    skip = max(bisect_right(places, t), bisect_right(at, w))
                    if skip < len(piece) and at[skip] - w - 1 <= length:
                        chain = (matched - (len(before) - 1 - p) + len(piece) - skip, first, skip)
                        kind = other or enough
                        chains[kind] = max(chains.get(kind, chain), chain)
                    if not skip:
                        break
        behind.append((piece, chains))
        for matched, first, _ in chains.values():
            yield matched, first, at[-1] + 1


def regions(hits: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first word, end word, lowest, highest diagonal)`` of groups of hits
    ``(word, template position)``: a group's next hit is on a diagonal near the one before
    and within a template's length."""
    band = max(1, min(BAND, length // 4))
    group: list[tuple[int, int]] = []
    for word, place in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if group and (word - place - (group[-1][0] - group[-1][1]) > band or not group[0][0] - length <= word <= group[0][0] + length):
            yield _region(group, length, band)
            group = []
        group.append((word, place))
    if group:
        yield _region(group, length, band)


def _region(group: list[tuple[int, int]], length: int, band: int) -> tuple[int, int, int, int]:
    diagonals = [word - place for word, place in group]
    low, high = min(diagonals) - band, max(diagonals) + band
    return max(0, low), high + length, low, high


def scan_text(templates: Templates, data: bytes, hits: dict[int, list[tuple[int, int]]]) -> list[tuple[str, float, int, int, int]]:
    """``(name, coverage, matched, start byte, end byte)`` of the matches in a text, from
    its hits by template.  Of overlapping matches of a template the best stays, and of
    matches of different templates of which one lies on half of the other or more, the
    better (both if they are equally good)."""
    spans = [m.span() for m in _WORD.finditer(data)]
    out = []
    for t, own in hits.items():
        template, pieces, found = templates.words[t], [], []
        for first, end, low, high in regions(own, len(template)):
            words = [data[a:b].lower() for a, b in spans[first:end]]
            pieces.append([(place, first + w) for place, w in align(template, words, low - first, high - first)])
        for matched, start, stop in chained(pieces, len(template)):
            if matched >= templates.least[t] and _tells(templates, t, [data[a:b].lower() for a, b in spans[start:stop]]):
                found.append((-matched, stop - start, start, stop))
        taken: list[tuple[int, int]] = []
        for matched, _, start, stop in sorted(found):
            if all(stop <= a or b <= start for a, b in taken):
                taken.append((start, stop))
                out.append((-matched - MISSING * (len(template) + matched), t, -matched, start, stop))
    return [
        (templates.names[t], matched / len(templates.words[t]), matched, spans[start][0], spans[stop - 1][1])
        for _, t, matched, start, stop in sorted(_best(out), key=lambda m: (m[3], m[1]))
    ]


def _tells(templates: Templates, t: int, words: list[bytes]) -> bool:
    """Does a match have the words that its license is known by, and none of another's?"""
    needed, barred = templates.needed[t], templates.barred[t]
    return not needed and not barred or needed.issubset(words) and barred.isdisjoint(words)


def _best(matches: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Matches ``(score, template, matched, start, stop)`` without those that lie on a better
    one.  Matches are met in the order of their starts; those that end before are done."""
    out = []
    matches = sorted(matches, key=lambda m: m[3])
    open_: list[tuple[float, int, int, int, int]] = []
    worse = set()
    for match in matches:
        open_ = [m for m in open_ if m[4] > match[3]]
        for other in open_:
            common = min(match[4], other[4]) - match[3]
            if 2 * common >= min(match[4] - match[3], other[4] - other[3]) and match[0] != other[0]:
                worse.add(min(match, other, key=lambda m: m[0]))
        open_.append(match)
    for match in matches:
        if match not in worse:
            out.append(match)
    return out


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]], doc_id: str = "doc_id", text: str = "text", terms: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """A row for each match: ``doc_id``, ``template``, ``coverage`` (share of its words that
    match), ``matched_words``, ``start`` and ``end`` (code points of the text) and the
    ``passage``.

    Letters are compared without case (A-Z), punctuation not at all.  Words may be put in
    (a template's length at one place at most) or left out anywhere.  ``terms``: for a
    template, words (in lower case, by blanks) that a match must hold, and words that it
    must not.  Texts that are null,
    empty or without a match give no row; repeated rows give their matches again.
    Templates have three words at least; without templates there are no matches."""
    index = docs.sparkSession.sparkContext.broadcast(Templates(templates, terms))  # bounded: MAX_TEMPLATE_WORDS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                offsets, data = utf8(part.column("text"))
                doc, values, _, bounds = hashed_grams(offsets, data)
                starts = np.searchsorted(doc, np.arange(part.num_rows))
                at, entry = own.hits(values)
                by_doc: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                for i, e in zip(at.tolist(), entry.tolist()):
                    by_doc[int(doc[i])][int(own.owners[e])].append((i - int(starts[doc[i]]), int(own.places[e])))
                ids, rows = [], []
                for d, hits in by_doc.items():
                    raw = data[offsets[d] : offsets[d + 1]].tobytes()
                    for name, coverage, matched, start, end in scan_text(own, raw, hits):
                        passage = raw[start:end].decode()
                        first = len(raw[:start].decode())
                        ids.append(d)
                        rows.append((name, coverage, matched, first, first + len(passage), passage))
                if ids:
                    columns = [pa.array(list(c)) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(ids)), *columns], ["doc_id", "template", "coverage", "matched_words", "start", "end", "passage"]
                    )

    rows = docs.selectExpr(f"`{doc_id}` AS id", f"cast(`{text}` AS string) AS text")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, template string, coverage double, matched_words long, start long, end long, passage string"
    return rows.mapInArrow(scan, schema)
