import math
import re
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import lm_score as lm
from veilframe.llm.queries import op2_lm_score


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counted(words, order):
    return Counter(tuple(words[i : i + n]) for n in range(order + 1) for i in range(len(words) - n + (n > 0)))


def brute(texts, order):
    own = [counted(words_of(t), order) for t in texts]
    every = sum(own, Counter())
    for text, mine in zip(texts, own):
        words, total = words_of(text), 0.0
        count = lambda gram: every[gram] - mine[gram]
        for i, word in enumerate(words):
            n = min(order - 1, i)
            factor = 1.0
            while True:
                context = tuple(words[i - n : i])
                if count((*context, word)) > 0:
                    total += math.log(factor * count((*context, word)) / count(context))
                    break
                if not n:
                    total += math.log(factor / (count(()) + 1))
                    break
                n, factor = n - 1, factor * lm.BACKOFF
        yield len(words), total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_small_corpus(spark, rows, monkeypatch, order):
    monkeypatch.setattr(lm, "BATCH_BYTES", 60)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20)
    texts = ["the cat sat on the mat", "The cat ran", "a dog sat on the cat", None, "", " \n", "cat", "the the the the", "a dog sat on the cat", "unseen words only"]
    got = {r.doc_id: r for r in lm.score_documents(rows(list(enumerate(texts))), order=order).collect()}
    for i, (n, total) in enumerate(brute(texts, order)):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(total, abs=1e-9)
        assert got[i].mean_log_score == (pytest.approx(total / n) if n else None)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.log_score for r in op2_lm_score(spark, sf).collect()}
    for doc, (_, total) in zip(docs, brute([d.text for d in docs], lm.ORDER)):
        assert got[doc.doc_id] == pytest.approx(total, rel=1e-9, abs=1e-9)


def test_query_scores_in_contexts_of_two_words(spark, rows, tmp_path):
    texts = ["a b c", "a b c", "x b d", "y b d", "z b d"]
    rows(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in op2_lm_score(spark, str(tmp_path)).collect()}
    for i, ((_, total), (_, shorter)) in enumerate(zip(brute(texts, 3), brute(texts, 2))):
        assert got[i] == pytest.approx(total, abs=1e-9) and got[i] != pytest.approx(shorter, abs=1e-3)


def test_edges(spark, rows):
    assert lm.score_documents(rows([])).count() == 0
    nothing = lm.score_documents(rows([(1, None), (2, ""), (3, " \n")])).collect()
    assert sorted((r.doc_id, r.n_words, r.log_score, r.mean_log_score) for r in nothing) == [(i, 0, 0.0, None) for i in (1, 2, 3)]
    docs = rows([(None, "a b"), (None, "a b"), (1, "a b")]).selectExpr("doc_id", "text", "1 AS batch", "2 AS id")
    out = lm.score_documents(docs).collect()
    assert len(out) == 3 and len({round(r.log_score, 9) for r in out}) == 1


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in ([0], [5, 5, 9], [2**64 - 1], [1, 2**63, 2**64 - 1], rng.integers(0, 2**64, 1000, np.uint64), rng.integers(0, 300, 70)):
        values = np.sort(np.array(values, np.uint64))
        assert np.array_equal(lm.unpack(lm.pack(values)), values)
        assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(values)), values)
    assert len(lm.unpack(lm.pack(np.zeros(0, np.uint64)))) == 0


def test_blocks_of_batches_hold_all_rows_in_less_room(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "text", "doc_id % 7 AS batch").toArrow()
    odd = lm.pa.table({"id": [None, None, 5, 5], "text": [None, "", "a b", "a b"], "batch": [3, 3, 3, 9]}, table.schema)
    given = [*odd.to_batches(), *table.to_batches(max_chunksize=100), table.to_batches()[0].slice(0, 0)]
    for held in (1, 1 << 20, lm.HELD_BYTES):
        monkeypatch.setattr(lm, "HELD_BYTES", held)
        blocks = lm.pa.Table.from_batches(lm.deal(iter(given)))
        got = [
            (row["id"], row["text"], batch)
            for i, batch in enumerate(blocks.column("batch").to_pylist())
            for row in lm.dealt(blocks.slice(i, 1)).to_pylist()
        ]
        assert sorted(got, key=repr) == sorted(((r["id"], r["text"], r["batch"]) for r in lm.pa.concat_tables([odd, table]).to_pylist()), key=repr)
    assert blocks.num_rows == 8 and sum(map(len, blocks.column("block").to_pylist())) < 0.5 * table.nbytes
    assert list(lm.deal(iter([]))) == []


def test_sorted_hashes_take_no_more_than_they_need():
    values = np.sort(np.random.default_rng(2).integers(0, 2**64, 1 << 18, np.uint64))
    data = lm.squeeze(lm.pack_sorted(values))
    assert np.array_equal(lm.unpack_sorted(lm.unsqueeze(data)), values)
    assert len(data) < 6.1 * len(values) < len(lm.pack_sorted(values)) * 1.02  # 46 bits of differences and 1.44 of their spread


def test_places_of_unsorted_values():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 1000, np.uint64))
    values = np.random.default_rng(4).choice(keys, 5000)
    assert np.array_equal(keys[lm.places_of(values, keys)], values)
    assert len(lm.places_of(values[:0], keys)) == 0
