"""SentencePiece encoding of merge-type (BPE) vocabularies, and decoding.

A text is normalised (a space in front, spaces as U+2581) and cut into chunks where no
piece of the vocabulary can cross: before a U+2581 that follows another character.  In a
chunk, all adjacent pairs of symbols that make a piece stand on an agenda, ordered by the
piece's score and then from the left; the best is merged, its neighbours make new pairs,
until none is left.  Symbols outside the vocabulary become byte pieces.

Texts are cut, and ids put together, for a slice of an Arrow batch at once; only a slice's
different chunks are merged, all chunks of a length in step, each row of a matrix being the
agenda of one.  Encoded chunks are remembered up to a bound until the task ends.

Every slice is checked against ``SentencePieceProcessor.encode``, or the job fails: each
chunk that was merged anew, as a text of its own, and the slice's first text as a whole.
As texts are put together from chunks, that covers all of them.
"""

from __future__ import annotations

import gc
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from veilframe.llm.shared import let_go, slices, utf8

SPACE = "▁"
SLICE_BYTES = 4 << 20
#: Chunks remembered by a worker, twice: a full memory becomes the older one, from
#: which chunks that occur again are taken over.
REMEMBERED = 150_000
#: Chunks longer than this are not remembered.
REMEMBERED_CHARS = 64
#: Chunks up to this long keep their agenda in a row of a matrix, longer ones in a heap.
SHORT_CHARS = 40
NO_PIECE = float("inf")
COMMA = pa.scalar(",", pa.large_string())
#: Rank of a pair that makes no piece.
NO_RANK = np.int32(2**31 - 1)


class Encoder:
    """Encodes as the library does, from the vocabulary alone."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        ids = range(n)
        names = self.library.id_to_piece(list(ids))
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in ids]
        if any(self.library.is_unused(i) for i in ids):
            raise ValueError("unused pieces are not supported")
        self.pieces = {names[i]: (-self.library.get_score(i), i) for i in ids if not special[i]}
        self.rank = {piece: found[0] for piece, found in self.pieces.items()}
        self.bytes = {int(names[i][3:5], 16): i for i in ids if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.unchecked: list[tuple[str, list[int]]] = []
        self._tabulate(n)

    def _tabulate(self, n: int) -> None:
        """Symbols as numbers (pieces by their ids, other characters of pieces from ``n``
        on) and all pairs of them that make a piece, as a sorted table."""
        symbols = {piece: found[1] for piece, found in self.pieces.items()}
        for char in sorted({c for piece in self.pieces for c in piece} - set(symbols)):
            symbols[char] = n + len(symbols) - len(self.pieces)
        self.n_ids, self.width = n, n + len(symbols)
        ranks = {score: rank for rank, score in enumerate(sorted(set(self.rank.values())))}
        pairs = sorted(
            (symbols[piece[:i]] * self.width + symbols[piece[i:]], ranks[score], made)
            for piece, (score, made) in self.pieces.items()
            for i in range(1, len(piece))
            if piece[:i] in symbols and piece[i:] in symbols
        )
        table = np.array([*pairs, (2**62, NO_RANK, 0)], np.int64)
        self.pair, self.pair_rank, self.pair_piece = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.symbol = np.full(0x110000, -1, np.int32)  # by code point
        for text, number in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = number

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pairs of symbols stand in the table; its last place if they make nothing."""
        key = left * self.width + right
        at = np.searchsorted(self.pair, key)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair) - 1)

    def merged(self, chunk: str) -> list[int]:
        """The ids of a chunk."""
        pieces, out = self.pieces, []
        for symbol in self.merged_short(chunk) if len(chunk) <= SHORT_CHARS else self.merged_long(chunk):
            found = pieces.get(symbol)
            if found:
                out.append(found[1])
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def merged_short(self, chunk: str) -> list[str]:
        """The agenda as a list with an entry for each adjacent pair; the best is its
        first minimum."""
        rank, symbols = self.rank.get, list(chunk)
        agenda = [rank(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) is not NO_PIECE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NO_PIECE)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NO_PIECE)
        return symbols

    def merged_long(self, chunk: str) -> list[str]:
        """The agenda as a heap over linked symbols."""
        rank = self.rank.get
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (negated score, left position, right position, merged length)
        agenda = []
        for i in range(n - 1):
            found = rank(chunk[i : i + 2])
            if found is not None:
                agenda.append((found, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, left, right, length = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != length or after[left] != right:
                continue  # one of them has been merged since
            symbols[left], symbols[right] = a + b, None
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                found = rank(symbols[left] + symbols[end])
                if found is not None:
                    heappush(agenda, (found, left, end, length + len(symbols[end])))
            start = before[left]
            if start >= 0:
                found = rank(symbols[start] + symbols[left])
                if found is not None:
                    heappush(agenda, (found, start, left, length + len(symbols[start])))
        return [symbol for symbol in symbols if symbol is not None]

    def merged_many(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many chunks."""
        out: list[list[int]] = [[]] * len(chunks)
        by_size = defaultdict(list)
        for i, chunk in enumerate(chunks):
            if len(chunk) <= SHORT_CHARS:
                by_size[len(chunk)].append(i)
            else:
                out[i] = self.merged(chunk)
        for size, places in by_size.items():
            text = "".join([chunks[i] for i in places])
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, size)
            self._merge(np.array(places), points, out)
        return out

    def _merge(self, places: np.ndarray, points: np.ndarray, out: list[list[int]]) -> None:
        """Merge chunks of a size in step: each loses a symbol a round until nothing fits.
        Unknown characters are negative code points less one."""
        symbols = self.symbol[points].astype(np.int64)
        symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)
        ranks = self.pair_rank[self._pairs(symbols[:, :-1], symbols[:, 1:])]
        while len(places):
            rows = np.arange(len(places))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(places), np.int64)
            goes_on = ranks[rows, at] != NO_RANK if ranks.shape[1] else np.zeros(len(places), bool)
            self._done(places[~goes_on], symbols[~goes_on], out)
            places, symbols, ranks, at = places[goes_on], symbols[goes_on], ranks[goes_on], at[goes_on]
            if not len(places):
                break
            rows = np.arange(len(places))
            made = self.pair_piece[self._pairs(symbols[rows, at], symbols[rows, at + 1])]
            left = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, left + (left > at[:, None]), 1)
            symbols[rows, at] = made
            left = left[:-1]
            ranks = np.take_along_axis(ranks, left + (left >= at[:, None]), 1)
            for beside in (at - 1, at):  # the pairs that the new symbol is in
                there = np.flatnonzero((beside >= 0) & (beside < len(left)))
                where = beside[there]
                ranks[there, where] = self.pair_rank[self._pairs(symbols[there, where], symbols[there, where + 1])]

    def _done(self, places: np.ndarray, symbols: np.ndarray, out: list[list[int]]) -> None:
        plain = ((symbols >= 0) & (symbols < self.n_ids)).all(1)
        for i, ids in zip(places[plain].tolist(), symbols[plain].tolist()):
            out[i] = ids
        for i, row in zip(places[~plain].tolist(), symbols[~plain].tolist()):
            out[i] = [id_ for symbol in row for id_ in self._ids(symbol)]

    def _ids(self, symbol: int) -> list[int]:
        if 0 <= symbol < self.n_ids:
            return [symbol]
        char = chr(-1 - symbol) if symbol < 0 else chr(int(np.flatnonzero(self.symbol == symbol)[0]))
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def remembered(self, chunks: list[str]) -> list[list[int]]:
        """The ids of different chunks, merged if they are not known."""
        out, new = [], []
        for chunk in chunks:
            found = self.known.get(chunk)
            if found is None:
                found = self.older.get(chunk)
                if found is None:
                    new.append(len(out))
                elif len(self.known) < REMEMBERED:
                    self.known[chunk] = found
            out.append(found)
        made = self.merged_many([chunks[i] for i in new])
        for i, ids in zip(new, made):
            out[i] = ids
            self.unchecked.append((chunks[i], ids))
            if len(chunks[i]) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[chunks[i]] = ids
        return out

    def cut(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray]:
        """``(docs, chunks)``: the chunks of all texts in order, those of text ``i`` being
        ``docs[i]`` to ``docs[i + 1]``."""
        full = np.flatnonzero(np.diff(offsets))
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
        texts = pc.replace_substring(texts.take(pa.array(full)), " ", SPACE)
        bounds, marked = utf8(pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        starts = np.zeros(len(marked) + 1, bool)
        if not self.crossing and len(marked):
            space = np.zeros(len(marked) + 3, bool)  # from the fourth place on: a U+2581 begins
            space[3:-2] = (marked[:-2] == 0xE2) & (marked[1:-1] == 0x96) & (marked[2:] == 0x81)
            starts[:-1] = space[3:] & ~space[:-3]
        starts[bounds] = True
        cuts = np.flatnonzero(starts)
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(marked)))
        docs = np.zeros(len(offsets), np.int64)
        docs[full + 1] = np.diff(np.searchsorted(cuts, bounds))
        return np.cumsum(docs), chunks

    def encode_all(self, offsets: np.ndarray, data: np.ndarray) -> tuple[pa.ListArray, pa.LargeStringArray]:
        """``(ids, ids as decimals with commas)`` of all texts."""
        docs, chunks = self.cut(offsets, data)
        found = pc.dictionary_encode(chunks)
        lists = self.remembered(found.dictionary.to_pylist())
        sizes = np.array([len(ids) for ids in lists], np.int64)
        flat = pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]))
        each = pa.LargeListArray.from_arrays(ends, flat).take(found.indices)
        ids = each.flatten()
        upto = np.concatenate([[0], np.cumsum(sizes[found.indices.to_numpy()])])[docs]
        shown = pc.binary_join(pa.LargeListArray.from_arrays(ends, flat.cast(pa.large_string())), COMMA).take(found.indices)
        shown = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(docs), shown), COMMA)
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), ids), shown

    def encode(self, text: str) -> tuple[list[int], str]:
        """The same of one text."""
        ids, shown = self.encode_all(*utf8(pa.array([text])))
        return ids[0].as_py(), shown[0].as_py()

    def check(self, text: str) -> None:
        """Compare a text, and the chunks merged since the last call, with the library.
        A chunk of one symbol has nothing to merge."""
        asked = [(chunk[1:].replace(SPACE, " "), ids) for chunk, ids in self.unchecked if len(chunk) > 1]
        self.unchecked = []
        asked.append((text, self.encode(text)[0]))
        for (value, ids), wanted in zip(asked, self.library.encode([value for value, _ in asked], num_threads=1)):
            if ids != wanted:
                raise ValueError(f"the library encodes otherwise: {value[:200]!r}")


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    if asked for, ``ids``; columns of these names are replaced.

    Null and empty texts have no ids and decode to the empty text.  The model file
    (under 1 MB for 32,000 pieces) is read by the driver and sent to all workers."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256") + (("ids",) if with_ids else ())
    kept = [c for c in docs.columns if c not in names]
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        gc.disable()  # lists of ids by the hundred thousand, without cycles
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                column = part.column(text)
                ids, shown = own.encode_all(*utf8(column))
                ends, listed = utf8(shown)
                whole = memoryview(listed)
                digests = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                flat, bounds = ids.flatten().to_numpy(), ids.offsets.to_numpy()
                texts = own.library.decode([flat[a:b] for a, b in zip(bounds, bounds[1:])], num_threads=1)
                decoded = [hashlib.sha256(value.encode()).hexdigest() for value in texts]
                own.check(column[0].as_py() or "")
                made = [pa.array(np.diff(bounds), pa.int64()), pa.array(digests), pa.array(decoded)]
                made += [ids] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, [*kept, *names])
        gc.enable()
        own.known, own.older = {}, {}
        let_go()

    schema = docs.select(kept).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    return docs.select(kept).mapInArrow(encode, schema)
