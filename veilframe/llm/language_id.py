"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``ORDER`` bytes long, learnt from a
bounded sample of labelled texts and then frozen.  A byte's code length in a context is
``-log2`` of its share of the context's counts, where the escape has the weight of the
number of different bytes seen there (method C); an unseen byte pays the escape and is
coded in the next shorter context, at last with equal chances for all 256 bytes.

Frozen statistics make the code length of a byte a function of the bytes just before
it.  So all trees are laid out as one table: a row for every context that some tree
has, a column for every byte value that some tree has seen (and one for all others,
which cost the same), a code length for each language.  Texts are scored by two
look-ups per byte, in numpy, over whole Arrow batches.  The table's size is bounded by
the sample, not by the data.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shared import let_go, slices, utf8

ORDER = 3
#: Bounds of the sample: texts of a language, bytes of a text, languages.
TEXTS_PER_LANGUAGE = 200
TEXT_BYTES = 1 << 13
MAX_LANGUAGES = 256
#: Contexts seen less often are not kept (their bytes are coded in shorter ones).
MIN_CONTEXT = 4
SLICE_BYTES = 1 << 20


def ppm_counts(texts: list[bytes], order: int = ORDER, min_context: int = MIN_CONTEXT) -> dict[bytes, dict[int, int]]:
    """The context tree: counts of the bytes that follow each context of 0 to
    ``order`` bytes; every text starts with the empty context."""
    tree: dict[bytes, dict[int, int]] = {b"": {}}
    for n in range(order + 1):
        grams = Counter()
        for text in texts:
            grams.update(text[i : i + n + 1] for i in range(len(text) - n))
        contexts = defaultdict(dict)
        for gram, count in grams.items():
            contexts[gram[:-1]][gram[-1]] = count
        tree |= {c: seen for c, seen in contexts.items() if not n or sum(seen.values()) >= min_context and c[1:] in tree}
    return tree


def code_length(tree: dict[bytes, dict[int, int]], context: bytes, byte: int) -> float:
    """Bits of ``byte`` after ``context``: the definition that the table tabulates."""
    bits = 0.0
    while context not in tree:
        context = context[1:]
    while True:
        seen = tree[context]
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return bits + np.log2(total) - np.log2(seen[byte])
        if seen:
            bits += np.log2(total) - np.log2(len(seen))
        if not context:
            return bits + 8.0
        context = context[1:]


class Model:
    """The trees of all languages as one table; see the module's text."""

    def __init__(self, trees: dict[str, dict[bytes, dict[int, int]]], order: int = ORDER):
        self.languages, self.order = sorted(trees), order
        self.rates: dict[str, float] = {}  # bits a byte of what a language was learnt from
        symbols = sorted({byte for tree in trees.values() for seen in tree.values() for byte in seen})
        self.width = len(symbols) + 1  # the last one stands for all unseen bytes
        self.symbol = np.full(256, len(symbols), np.int64)
        self.symbol[symbols] = np.arange(len(symbols))
        contexts = sorted({c for tree in trees.values() for c in tree}, key=lambda c: (len(c), c))
        row_of = {c: i for i, c in enumerate(contexts)}
        self.bits = np.empty((len(contexts), self.width, len(trees)), np.float32)
        for j, language in enumerate(self.languages):
            tree = trees[language]
            for c in contexts:
                shorter = self.bits[row_of[c[1:]], :, j] if c else np.full(self.width, 8.0)
                seen = tree.get(c)
                if not seen:
                    self.bits[row_of[c], :, j] = shorter
                    continue
                total = sum(seen.values()) + len(seen)
                row = shorter + (np.log2(total) - np.log2(len(seen)))
                at = self.symbol[list(seen)]
                row[at] = np.log2(total) - np.log2(np.fromiter(seen.values(), float, len(seen)))
                self.bits[row_of[c], :, j] = row
        self.bits = self.bits.reshape(len(contexts) * self.width, len(trees))
        # row of the longest known suffix of every context of each length up to the order
        self.rows = [np.zeros(1, np.int32)]
        for n in range(1, order + 1):
            rows = np.tile(self.rows[-1], self.width)
            known = [c for c in contexts if len(c) == n]
            if known:
                codes = self.symbol[np.frombuffer(b"".join(known), np.uint8).reshape(-1, n)] @ self.width ** np.arange(n - 1, -1, -1)
                rows[codes] = [row_of[c] for c in known]
            self.rows.append(rows)

    def code_lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        symbols = self.symbol[data]
        before = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        code, rows = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for n in range(1, self.order + 1):
            code[n:] += symbols[:-n] * self.width ** (n - 1)
            if n == self.order:
                rows = self.rows[n][code].astype(np.int64)
        for n in range(self.order):  # the first bytes of a text have shorter contexts
            at = np.flatnonzero(before == n)
            context = np.zeros(len(at), np.int64)
            for j in range(1, n + 1):
                context += symbols[at - j] * self.width ** (j - 1)
            rows[at] = self.rows[n][context]
        full = offsets[:-1] < offsets[1:]
        cell = rows * self.width + symbols
        out[full] = np.add.reduceat(self.bits[cell], offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def training_sample(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang`` and ``text`` of ``TEXTS_PER_LANGUAGE`` texts per language at most, those
    with the least hash among the usable, labelled ones that are not empty; of longer texts
    than ``TEXT_BYTES`` bytes, a piece from the start that is no longer for certain.
    Ranks are cut in every task before the shuffle, so a language may have any share
    of the rows."""
    fits = usable & F.col(lang).isNotNull() & (F.octet_length(text) > 0)
    piece = F.when(F.octet_length(text) <= TEXT_BYTES, F.col(text)).otherwise(F.substring(text, 1, TEXT_BYTES // 4))
    ranked = Window.partitionBy("lang").orderBy("order", "id")
    chosen = (
        docs.where(fits)
        .select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.col(doc_id).cast("string"), F.lit(6)).alias("order"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= TEXTS_PER_LANGUAGE)
        .select("id", F.col("lang").alias("language"))
    )
    # at most TEXTS_PER_LANGUAGE rows of a language, and MAX_LANGUAGES languages
    ids = F.broadcast(chosen.select("id").distinct())
    return docs.where(fits).withColumn("id", F.col(doc_id).cast("string")).join(ids, "id", "left_semi").select(F.col(lang).cast("string").alias("lang"), piece.alias("text"))


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of all languages of the usable labelled rows."""
    sample = training_sample(docs, usable, doc_id, text, lang)
    texts = defaultdict(list)
    # bounded by TEXTS_PER_LANGUAGE, TEXT_BYTES and MAX_LANGUAGES
    for language, value in sample.take(TEXTS_PER_LANGUAGE * MAX_LANGUAGES + 1):
        texts[language].append(value.encode())
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = Model({language: ppm_counts(sorted(known)) for language, known in texts.items()})
    for at, language in enumerate(model.languages):
        known = texts[language]
        ends = np.cumsum([0, *map(len, known)])
        model.rates[language] = float(model.code_lengths(ends, np.frombuffer(b"".join(known), np.uint8))[:, at].sum() / ends[-1])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``score`` (the language's posterior
    chance, all languages being equally likely before) and ``bits_per_byte`` (its code
    length); columns of these names are replaced.

    The language with the shortest code wins, the first in the alphabet in a tie.
    Texts that are null or have no letter, and all texts if no language was learnt, get
    ``und``, 0 and null."""
    names = ("lang_pred", "score", "bits_per_byte")
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                column = part.column(text)
                offsets, data = utf8(column)
                bits = model.code_lengths(offsets, data)
                said = np.array([t is not None and has_letter(t) for t in column.to_pylist()], bool) & bool(model.languages)
                languages, scores, rates = [None] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                if model.languages:
                    best = bits.argmin(1)
                    least = bits.min(1)
                    scores = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    rates = least / np.maximum(np.diff(offsets), 1)
                    languages = [model.languages[i] for i in best]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept]
                    + [
                        pa.array([x if s else "und" for x, s in zip(languages, said)], pa.string()),
                        pa.array(np.where(said, scores, 0.0)),
                        pa.array(rates, mask=~said),
                    ],
                    [*kept, *names],
                )
        let_go()

    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return docs.select(kept).mapInArrow(predict, schema)
