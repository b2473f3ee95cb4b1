import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import crc
from veilframe.llm import importance as im
from veilframe.llm.queries import op11_resample

SF = "/root/testdata/sf0.001"


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=2, max_size=12))
def test_crc(parts):
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    got = crc.crc32(data, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]
    sizes = np.array([len(p) for p in parts[1:]])
    assert crc.joined(got[:-1], got[1:], sizes).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A", "b", "Z9", "É", "ß", "日本", "İ", " ", ".", "\x00", "\x7f", "\x80", "x" * 300]), max_size=30).map("".join), max_size=4))
def test_features(texts):
    docs, buckets, words = im.features(im.splitter(), pa.array([*texts, None, ""], pa.string()))
    for i, text in enumerate([*texts, None, ""]):
        wanted, n = brute(text)
        assert sorted(buckets[docs == i]) == sorted(wanted) and words[i] == n


def test_features_of_a_slice():
    texts = pa.array(["Ab c"] * 5 + [None, "", "Cd E"])
    docs, buckets, words = im.features(im.splitter(), texts.slice(4))
    assert words.tolist() == [2, 0, 0, 2] and sorted(buckets[docs == 3]) == sorted(brute("cd e")[0])


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(im, "PIECE_CHARS", 7)
    text = "é1 " + "abcdefghij" * 3 + " xÿ  y, z" * 9
    assert [text.encode()[a:b].decode() for a, b in im.word_offsets(im.splitter(), text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def by_hand(docs, target, percent=5):
    made = {i: brute(t) for i, t in docs}
    corpus, aim = Counter(b for f, _ in made.values() for b in f), Counter(b for t in target for b in brute(t)[0])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = {}
    for i, (f, _) in made.items():
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i in out if made[i][1] >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(fit[: percent * len(fit) // 100], 1):
        out[i][3] = rank
    return out


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: [r.n_features, r.weight, r.score, r.rank] for r in op11_resample(spark, SF).collect()}
    assert got == by_hand(docs.items(), target)
    assert {r for *_, r in got.values()} - {None} == set(range(1, 1 + sum(v[3] is not None for v in got.values())))


def test_edges(spark, rows):
    words = " ".join(f"w{i}" for i in range(20))
    docs = rows([(1, words, "a"), (1, words, "b"), (None, words, "c"), (2, None, "d"), (3, "", "e"), (4, words + " x", "f")], "doc_id long, text string, weight string")
    target = rows([(words,), (None,)], "text string")
    out = im.resample(docs, target, percent=100)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted(out.collect(), key=lambda r: (r.rank or 99, r.doc_id or 0))
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and {r.doc_id for r in got if r.rank} == {1, 4}
    assert [(r.doc_id, r.n_features, r.score is None) for r in got[3:]] == [(None, 57, True), (2, 0, False), (3, 0, False)]
    assert im.resample(docs.limit(0), target).count() == 0
    assert im.resample(docs, target.limit(0), percent=100).where(F.col("rank").isNotNull()).count() == 3


def test_ties_go_to_the_smaller_id(spark, rows):
    scored = rows([(9, "a"), (3, "a")])
    gains = np.zeros(im.BUCKETS, np.int64)
    assert [r.weight for r in im.weigh(scored, gains).collect()] == [0, 0]
    docs = rows([(i, "x " * 25) for i in range(300)])
    got = {r.doc_id: (r.score, r.rank) for r in im.resample(docs, docs, percent=50).collect()}
    drawn = sorted(got, key=lambda i: (-got[i][0], i))[:150]
    assert [got[i][1] for i in drawn] == list(range(1, 151)) and len({s for s, _ in got.values()}) < 300
