"""Importance resampling towards a target distribution.

Documents are drawn without replacement in favour of those whose word n-grams are likelier
in target texts than in the raw corpus.  Every text is cut into words by an untrained
pre-tokeniser of the ``tokenizers`` library (a regular expression that splits the text,
A-Z lower-cased before), which gives each word with its byte offsets.  Features are
windows of 1 to 3 consecutive words, given by the offsets of their words; a feature falls
into the bucket of its CRC-32.  Bucket counts of corpus and target make a gain per bucket,
a document's weight is the sum of its features' gains, and Gumbel noise drawn from a hash
of its id turns weights into a sample: the highest scores are drawn.

Counts cover every text.  The model has a fixed size, one number per bucket.  Texts are
cut twice, once to count and once to weigh, as their features are about as large as they.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ordered import positions
from veilframe.llm import crc
from veilframe.llm.shared import slices, utf8, written
from veilframe.llm.words import LOWER

BUCKETS = 10_000
#: Longest feature, in words.
WORDS = 3
#: Documents with fewer words are not drawn.
MIN_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
#: Everything in ASCII but digits and letters parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20
#: Texts are given to the pre-tokeniser in pieces of about this many characters.
PIECE_CHARS = 1 << 20
_SEPARATOR = re.compile(SEPARATORS)
_BLANK = np.uint32(0xE96CCF45)  # CRC-32 of one space


def splitter():
    """The pre-tokeniser: separators go, words stay."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATORS), behavior="removed")


def word_offsets(split, text: str) -> np.ndarray:
    """``start, end`` of the words of a text, in bytes of its UTF-8.  Long texts are cut in
    pieces, each ending after a separator."""
    from tokenizers import PreTokenizedString

    found, at, base = [], 0, 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_CHARS:
            gap = _SEPARATOR.search(text, at + PIECE_CHARS)
            end = gap.end() if gap else end
        piece = text[at:end]
        cut = PreTokenizedString(piece)
        split.pre_tokenize(cut)
        splits = cut.get_splits(offset_referential="original", offset_type="byte")
        found.append(np.array([offsets for _, offsets, _ in splits], np.int64).reshape(-1, 2) + base)
        at, base = end, base + len(piece.encode())
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def features(split, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(docs, buckets, words)``: the text and the bucket of every feature, texts in order
    for each length of features, and the number of words of every text."""
    offsets, data = utf8(texts)
    data = LOWER[data]
    whole = data.tobytes()
    found = [word_offsets(split, whole[a:b].decode()) for a, b in zip(offsets, offsets[1:])]
    words = np.array([len(f) for f in found], np.int64)
    bounds = np.concatenate([np.zeros((0, 2), np.int64), *found])
    doc = np.repeat(np.arange(len(words)), words)
    starts, ends = (bounds + offsets[doc][:, None]).T
    own, size = crc.crc32(data, starts, ends), ends - starts + 1
    blank = np.full(len(own), _BLANK, np.uint32)
    after_blank = crc.joined(blank, own, size - 1)  # of the word with a space before it
    docs, buckets = [doc], [own % BUCKETS]
    grown = own
    for n in range(1, WORDS):
        inside = np.flatnonzero(doc[n:] == doc[: len(doc) - n])
        whole = np.zeros(len(own), np.uint32)
        whole[inside] = crc.joined(grown[inside], after_blank[inside + n], size[inside + n])
        grown = whole
        docs.append(doc[inside])
        buckets.append(whole[inside] % BUCKETS)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64), words


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = splitter(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                total += np.bincount(features(split, part.column(text))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # one row per bucket, a fixed number
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus shares, one added to each count."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in pairs], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with ``n_words``, ``n_features`` and ``weight``;
    columns of these names are replaced."""
    names = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c not in names and c != text]
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                doc, buckets, words = features(split, part.column(text))
                weights = np.zeros(len(words), np.int64)
                np.add.at(weights, doc, shared.value[buckets])
                made = [words, np.bincount(doc, minlength=len(words)), weights]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in made], [*kept, *names])

    schema = docs.select(kept).schema
    for name in names:
        schema = schema.add(name, "long")
    return docs.select(*kept, text).mapInArrow(sums, schema)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw for an id; null for a null id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's ``doc_id, n_words, n_features, weight, score`` and ``rank``.

    Of the N documents with an id and at least ``MIN_WORDS`` words, ``percent`` percent
    (rounded down) are drawn: ``rank`` counts them from 1 by falling score, ties by id, and
    is null for all others.  ``target`` has the same column of texts.  Null and empty texts
    have no features and weight 0; a null id has no score and is not drawn.  Rows that are
    equal in id and score are ranked one after the other, in either order.  Other columns
    are not read.  Without target texts the gains only reflect the corpus."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gains = bucket_gains(bucket_counts(named), bucket_counts(target.select(F.col(text).alias("text"))))
    scored = weigh(named, gains).withColumn("score", (F.col("weight") + noise("doc_id", seed)).cast("long"))
    scored = written(scored, "weights")  # cut no text again to sort
    fits = F.col("doc_id").isNotNull() & (F.col("n_words") >= MIN_WORDS)
    falling = F.struct((~fits).alias("out"), (-F.col("score")).alias("less"), F.col("doc_id").alias("id"))
    placed = positions(scored.withColumn("_falling", falling), "_falling", "_place").drop("_falling")
    drawn = scored.agg(F.count_if(fits)).first()[0] * percent // 100
    return placed.select(*scored.columns, F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
