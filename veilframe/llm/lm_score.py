"""Stupid-backoff scores of all documents under the n-gram counts of the corpus.

Documents are dealt to batches of about ``BATCH_BYTES``.  A batch explodes its texts into
n-grams of all orders, hashed to 64 bits, and sums them up: one count for each distinct
n-gram.  The counts are cut by hash range into buckets, a sorted block for each batch and
bucket, and shuffled once.  A bucket is one partition of the count table: it adds up its
blocks and answers each with the counts of all other batches, in the block's order.  The
answers join their batch again, where every position takes its counts by look-up and the
logs are summed per document.

An n-gram that every document holds is one entry in each block, so no key is hot.  Blocks
hold the differences of the sorted hashes and the counts in as few bytes as they need, and
are compressed: less than six bytes for a distinct n-gram where a row would take thirty.
Texts are shuffled to their batches in compressed blocks too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import utf8
from veilframe.llm.words import LOWER, ngrams, numbers, word_bounds, word_hashes

ORDER = 3
#: Factor of each step to a shorter context.
BACKOFF = 0.4
#: Bytes of text in a batch, and of text whose n-grams fill a bucket.
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
#: Bytes of text that a task holds while it deals them to batches.
HELD_BYTES = 32 << 20

#: The empty n-gram, whose count is the number of words.
_NOTHING = numbers(1, 21)


def squeeze(data: bytes) -> bytes:
    """``data`` compressed, behind its length.  The codec that Spark shuffles with by default
    finds no repeats in hashes and leaves half as much again of prose."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Non-negative 64-bit numbers as byte planes, the lowest first, without empty planes;
    the first byte tells their number."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences; the first one stands apart in 8 bytes."""
    return values[:1].tobytes() + pack(np.diff(values))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, count=1), unpack(data[8:])]), dtype=np.uint64)


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the column ``batch`` put together to compressed blocks, one for each batch
    of about ``HELD_BYTES`` of rows."""

    def blocks() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("batch").combine_chunks()
        batch = table.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
        rows = table.drop_columns("batch")
        packed = []
        for start, end in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows.slice(start, end - start))
            packed.append(squeeze(sink.getvalue().to_pybytes()))
        return pa.record_batch({"batch": pa.array(batch[cuts[:-1]], pa.int64()), "block": pa.array(packed, pa.binary())})

    held, size = [], 0
    for rows in batches:
        if rows.num_rows:
            held.append(rows)
            size += rows.nbytes
        if size >= HELD_BYTES:
            yield blocks()
            held, size = [], 0
    if held:
        yield blocks()


def dealt(table: pa.Table) -> pa.Table:
    """The rows of blocks that ``deal`` made."""
    return pa.concat_tables(pa.ipc.open_stream(unsqueeze(block)).read_all() for block in table.column("block").to_pylist())


def positions(offsets: np.ndarray, data: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``(docs, grams, place)``: word bounds of texts; for n = 0 to ``order`` the hash of
    the n-gram that ends at each word (where there are as many words); the word's place
    in its text."""
    data = LOWER[data]
    starts, ends, docs = word_bounds(offsets, data)
    words = word_hashes(data, starts, ends)
    place = np.arange(len(words)) - np.repeat(docs[:-1], np.diff(docs))
    grams = [np.broadcast_to(_NOTHING, words.shape)]
    for n in range(1, order + 1):
        ending = np.zeros(len(words), np.uint64)
        ending[place >= n - 1] = ngrams(words, docs, n, whole_if_shorter=False)[1]
        grams.append(ending)
    return docs, grams, place


def distinct_grams(grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct n-grams, sorted, and their counts."""
    return np.unique(np.concatenate([g[place >= n - 1] for n, g in enumerate(grams)]), return_counts=True)


def places_of(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each value stands in the sorted ``keys``, looked up in the order of the values:
    in any other, most look-ups wait for the memory."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.searchsorted(keys, values[order])
    return out


def log_scores(docs: np.ndarray, grams: list[np.ndarray], place: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Natural log of the score at each word, from the counts of all other documents."""
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    n_words = np.diff(docs)[doc]
    others = []  # counts without the own document's, by order; 0 where there is no n-gram
    for n, gram in enumerate(grams):
        valid = place >= n - 1
        at = places_of(gram[valid], keys) if n else np.searchsorted(keys, gram[:1]).repeat(len(gram))
        if n:
            _, inverse, own = np.unique(doc[valid] * np.int64(len(keys)) + at, return_inverse=True, return_counts=True)
            own = own[inverse]
        else:
            own = n_words[valid]
        count = np.zeros(len(place), np.int64)
        count[valid] = totals[at] - own
        others.append(count)
    out = -np.log(others[0] + 1.0)  # an unseen word
    steps = np.minimum(place, len(grams) - 2)  # words of context there are
    out += np.maximum(steps, 0) * math.log(BACKOFF)
    for n in range(1, len(grams)):
        context = others[0] if n == 1 else np.concatenate([[0], others[n - 1][:-1]])
        seen = (others[n] > 0) & (place >= n - 1)
        ratio = np.log(others[n][seen]) - np.log(context[seen])
        out[seen] = ratio + (steps[seen] - (n - 1)) * math.log(BACKOFF)
    return out


def score_documents(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` (sum over words) and ``mean_log_score``, a row
    for each input row.

    Words are runs without white space, A-Z in lower case.  A word's score is the share
    of its n-gram among those of its context, at the longest context of ``order`` - 1
    words at most in which *other documents* have the word, times ``BACKOFF`` for each word
    left out of the context; a word that no other document has counts as seen once in
    one word more than there are.  Texts without words, and null ones, have the sum 0 and
    a null mean.  Rows with the same id and text count as different documents."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_batches = size // BATCH_BYTES + 1
    bits = max(0, math.ceil(math.log2(max(1, order * size / BUCKET_BYTES / 2))))
    placed = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)))
    batches = placed.mapInArrow(deal, "batch long, block binary")

    def explode(table: pa.Table) -> pa.Table:
        _, grams, place = positions(*utf8(dealt(table).column("text")), order)
        keys, counts = distinct_grams(grams, place)
        bounds = np.searchsorted(keys, [b << (64 - bits) for b in range(1, 1 << bits)] if bits else [])
        bounds = np.concatenate([[0], bounds, [len(keys)]]).astype(int)
        blocks = [(b, s, e) for b, (s, e) in enumerate(zip(bounds, bounds[1:])) if s < e]
        return pa.table(
            {
                "batch": pa.array([table.column("batch")[0].as_py()] * len(blocks), pa.int64()),
                "bucket": pa.array([b for b, _, _ in blocks], pa.int64()),
                "grams": pa.array([squeeze(pack_sorted(keys[s:e])) for _, s, e in blocks], pa.binary()),
                "counts": pa.array([squeeze(pack(counts[s:e])) for _, s, e in blocks], pa.binary()),
            }
        )

    def add_up(table: pa.Table) -> pa.Table:
        grams = [unpack_sorted(unsqueeze(x)) for x in table.column("grams").to_pylist()]
        counts = [unpack(unsqueeze(x)).astype(np.int64) for x in table.column("counts").to_pylist()]
        ends = np.cumsum([len(x) for x in grams])
        keys, at = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, at, np.concatenate(counts))
        answers = [squeeze(pack(totals[at[e - len(own) : e]] - own)) for own, e in zip(counts, ends)]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "others": pa.array(answers, pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = dealt(table)
        bounds, grams, place = positions(*utf8(table.column("text")), order)
        keys, counts = distinct_grams(grams, place)
        ordered = answers.sort_by("bucket").column("others").to_pylist()
        totals = counts + np.concatenate([np.zeros(0, np.uint64), *(unpack(unsqueeze(x)) for x in ordered)]).astype(np.int64)
        logs = np.concatenate([[0.0], log_scores(bounds, grams, place, keys, totals)])
        n_words = np.diff(bounds)
        sums = np.zeros(len(n_words))
        full = n_words > 0
        if full.any():
            sums[full] = np.add.reduceat(logs[1:], bounds[:-1][full])
        return pa.table(
            {
                "doc_id": table.column("id"),
                "n_words": pa.array(n_words, pa.int64()),
                "log_score": pa.array(sums),
                "mean_log_score": pa.array(sums / np.maximum(n_words, 1), mask=~full),
            }
        )

    blocks = batches.groupBy("batch").applyInArrow(explode, "batch long, bucket long, grams binary, counts binary")
    answers = blocks.groupBy("bucket").applyInArrow(add_up, "batch long, bucket long, others binary")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, log_score double, mean_log_score double"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)
