import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import quality as q
from veilframe.llm.queries import op4_quality_rules

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#|", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " "]), max_size=60).map("".join))
def test_base_counts(text):
    assert q.base_counts(text) == brute(text)


def test_base_counts_of_odd_texts():
    assert q.base_counts(None) == q.base_counts("") == (0, 0, 0, 0, 0)
    assert q.base_counts("a b c d e " * 40_000) == brute("a b c d e " * 40_000)


def test_whole_table(spark):
    got = {r.doc_id: r for r in op4_quality_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    raw, target = Counter(), Counter()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    bucket = {}

    def buckets(data):
        for i in range(len(data) - 2):
            gram = data[i : i + 3]
            if gram not in bucket:
                bucket[gram] = int(q._buckets()[int.from_bytes(gram, "big")])
            yield bucket[gram]

    for doc_id, data in texts.items():
        own = Counter(buckets(data))
        raw += own
        if doc_id in good:
            target += own
    size = 2**q.BUCKET_BITS
    n_raw, n_target = sum(raw.values()) + size, sum(target.values()) + size
    ratio = {b: round((np.log((target[b] + 1) / n_target) - np.log((raw[b] + 1) / n_raw)) * 2**20) / 2**20 for b in range(size)}
    for doc_id, data in texts.items():
        counts, r = brute(data.decode()), got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        llr = sum(ratio[b] for b in buckets(data)) / max(1, len(data) - 2)
        assert r.base_failed == failed and abs(r.llr - llr) < 1e-6
        assert r.kept == (not failed and llr >= q.THRESHOLD)


def test_verdicts_follow_the_labels(spark):
    judged = op4_quality_rules(spark, SF).where("NOT base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    shares = {r.quality: r.share for r in judged.where("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.1


def test_edges(spark, rows):
    labels = spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = rows([(1, "x " * 20, "a"), (None, None, "b"), (2, "", "c"), (2, "", "c")], "doc_id long, text string, kept string")
    ratio = q.learn_ratio(docs, labels)
    assert not ratio.any()  # nobody is trusted
    out = q.judge_quality(docs, ratio)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("kept") == 1
    assert [(r.doc_id, r.n_words, r.kept) for r in out.collect()] == [(1, 20, False), (None, 0, False), (2, 0, False), (2, 0, False)]
    assert q.judge_quality(docs.limit(0), q.learn_ratio(docs.limit(0), labels)).count() == 0
