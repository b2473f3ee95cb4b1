import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import periodic as pr
from veilframe.llm.queries import with_repeats
from veilframe.llm.suffixes import Suffixes

SF = "/root/testdata/sf0.001"


def brute(words):
    """``start, end, period`` of all runs, by trying every period at every word."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng):
    n, kinds = rng.choice([0, 1, 11, 12, 13, 40, 100, 300]), rng.choice([1, 2, 3, 8, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("points", [1 << 20, 40])
@pytest.mark.parametrize("seed", range(60))
def test_find_runs(monkeypatch, seed, points):
    monkeypatch.setattr(pr, "POINTS", points)
    rng = random.Random(seed)
    texts = [repeating(rng) for _ in range(rng.randrange(6))]
    got = pr.find_runs(np.array([w for t in texts for w in t], np.int32), np.cumsum([0] + [len(t) for t in texts]))
    assert got.tolist() == [[d, *r] for d, t in enumerate(texts) for r in brute(t)]


def test_words_of_fibonacci():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert pr.find_runs(np.array(b, np.int32), np.array([0, len(b)])).tolist() == [[0, *r] for r in brute(b)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=150))
def test_common(codes):
    codes = np.array([*codes, 3], np.int32)
    a, b = np.array([(i, j) for i in range(len(codes)) for j in range(len(codes)) if i != j]).T
    for i, j, n in zip(a, b, Suffixes(codes).common(a, b)):
        assert (codes[i : i + n] == codes[j : j + n]).all() and codes[i + n] != codes[j + n]


def test_long_texts():
    n = 300_000
    one = np.zeros(n, np.int32)
    assert pr.find_runs(one, np.array([0, n])).tolist() == [[0, 0, n, 1]]
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1_000_000, n).astype(np.int32)
    words[1000:] = words[1000 + (np.arange(1000, n) - 1000) % 99_000]
    assert pr.find_runs(words, np.array([0, n])).tolist() == [[0, 1000, n, 99_000]]


def test_planted_repeats(spark, rows):
    texts = {i: " ".join(f"w{k}" for k in range(i % 40)) for i in range(200)}
    docs = rows([*texts.items(), (None, "a b"), (6, None)])
    for r in with_repeats(docs).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words = (texts[r.doc_id] if r.doc_id is not None else "a b").split() if r.text is not None else []
        n, g = len(words), h // 10
        if r.doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert (r.text or "").split() == words


def test_edges(spark, rows):
    x = "p q " * 8
    docs = rows([(1, f"a {x}b", "k"), (1, f"a {x}b", "k"), (None, None, "l"), (2, "", "m"), (3, "  \t\n", "n"), (4, "é " * 13, "o"), (5, "é " * 11, None)], "doc_id long, text string, runs string")
    out = pr.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = [(r.doc_id, [tuple(q) for q in r.runs], r.collapsed) for r in out.collect()]
    once = (1, [(1, 16, 2)], "a p q b")
    assert got == [once, once, (None, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 13, 1)], "é"), (5, [], " ".join("é" * 11))]
    assert pr.periodic_runs(docs.limit(0)).count() == 0
