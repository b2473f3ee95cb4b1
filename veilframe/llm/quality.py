"""Quality rules: base counts of every text, and a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: one of trusted texts (the
target) and one of the whole raw corpus.  A text's score is the sum of the logs of
their ratio over its n-grams, divided by their number; texts below a fixed threshold
go.  Both multinomials have ``2 ** BUCKET_BITS`` buckets, so the model has a fixed size.

The raw counts cover every text.  The trusted ones come from a bounded sample of the
labelled rows.  Byte n-grams see marks, capitals and broken words whatever the language,
where word n-grams of a rich vocabulary are mostly seen once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import let_go, slices, utf8
from veilframe.llm.words import mix

GRAM = 3
BUCKET_BITS = 16
#: Labelled documents whose texts make the target.
TRUSTED_DOCS = 20_000
#: Texts whose mean log ratio (in nats per n-gram) is below are dropped.
THRESHOLD = -0.7
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Rules of the base counts.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
SLICE_BYTES = 2 << 20


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at space and \\t\\n\\v\\f\\r only, being bytes
    n_spaces = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(words), len(text) - n_spaces, n_symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n = end = 0
    for at in compress(range(len(windows)), [seen[w] > 1 for w in windows]):
        n += at + WINDOW - max(at, end)
        end = at + WINDOW
    return n


def grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, buckets)``: buckets of the byte n-grams of each text, in order; those
    of text ``i`` are ``bounds[i]`` to ``bounds[i + 1]``.  Shorter texts have none."""
    if len(data) < GRAM:
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        code = (code << np.uint64(8)) | data[j : len(data) - GRAM + 1 + j]
    inside = np.ones(len(code), bool)
    for end in range(1, GRAM):  # n-grams that would run over a text's end
        cut = offsets[1:-1] - end
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    table = _buckets()
    buckets = table[code[inside].astype(np.int64)]
    bounds = np.concatenate([[0], np.cumsum(inside)])
    return bounds[np.minimum(offsets, len(code))], buckets


_table: list[np.ndarray] = []


def _buckets() -> np.ndarray:
    """The hash of every n-gram, tabulated once in a process."""
    if not _table:
        table, block = np.empty(1 << 8 * GRAM, np.uint16), 1 << 16
        for at in range(0, len(table), block):
            table[at : at + block] = mix(np.arange(at, at + block, dtype=np.uint64)) >> np.uint64(64 - BUCKET_BITS)
        _table.append(table)
    return _table[0]


def learn_ratio(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target and raw multinomial for every bucket.

    Trusted are documents that ``labels`` (``doc_id, quality, toxic``) calls good and
    not toxic, and never otherwise; of these, ``TRUSTED_DOCS`` with the least hash."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select(F.col("doc_id").alias("trusted_id"))
    trusted = trusted.orderBy(F.xxhash64("trusted_id", F.lit(4)), "trusted_id").limit(TRUSTED_DOCS)
    marked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(trusted), F.col("id") == F.col("trusted_id"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                bounds, buckets = grams(*utf8(part.column("text")))
                raw += np.bincount(buckets, minlength=len(raw))
                is_trusted = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False), np.diff(bounds))
                target += np.bincount(buckets[is_trusted], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])
        _table.clear()
        let_go()

    counts = (
        marked.select("text", F.col("trusted_id").isNotNull().alias("trusted"))
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    sums = np.zeros((2, 1 << BUCKET_BITS))
    for bucket, raw, target in counts.collect():  # one row per bucket, a fixed number
        sums[:, bucket] = raw, target
    if not sums[1].any():
        return np.zeros(1 << BUCKET_BITS)  # nothing to trust: no verdict against any text
    raw, target = sums + SMOOTHING
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return np.round(ratio * 2**20) / 2**20  # sums of these are exact in any order


def judge_quality(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr`` and ``kept``; columns of these names are replaced.

    ``base_failed``: fewer than 10 words, or over 20 percent of them in repeated windows
    of 5.  ``llr``: mean log ratio, 0 for texts of fewer than 3 bytes.  ``kept``: neither
    failed nor below the threshold.  Null and empty texts have no words and fail."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** BUCKET_BITS numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                column = part.column(text)
                counts = np.array([base_counts(t) for t in column.to_pylist()], np.int64).reshape(-1, 5)
                bounds, buckets = grams(*utf8(column))
                sums = np.concatenate([[0.0], np.cumsum(shared.value[buckets])])
                llr = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(x) for x in counts.T] + [pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                    [*kept, *names],
                )
        _table.clear()
        let_go()

    schema = docs.select(kept).schema
    for name in names:
        schema = schema.add(name, {"base_failed": "boolean", "kept": "boolean", "llr": "double"}.get(name, "long"))
    return docs.select(kept).mapInArrow(judge, schema)
