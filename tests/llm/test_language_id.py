import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import language_id as lid
from veilframe.llm.queries import op6_language_id

SF = "/root/testdata/sf0.01"
TEXTS = {"x": [b"abcabcabc abd", b"abababab", b""], "y": [b"cbacba zz", "é cba é".encode()], "z": [b"q"]}


def test_table_is_the_definition():
    trees = {language: lid.ppm_counts(texts, min_context=2) for language, texts in TEXTS.items()}
    model = lid.Model(trees)
    asked = [b"abcabc zz", b"", b"q", "é\x00abq".encode(), b"abababab" * 50, bytes(range(256))]
    offsets = np.cumsum([0, *map(len, asked)])
    got = model.code_lengths(offsets, np.frombuffer(b"".join(asked), np.uint8))
    for i, text in enumerate(asked):
        for j, language in enumerate(model.languages):
            bits = sum(lid.code_length(trees[language], text[max(0, n - lid.ORDER) : n], text[n]) for n in range(len(text)))
            assert got[i, j] == pytest.approx(bits, rel=1e-6)


def test_chances_of_a_context_sum_to_one_at_most():
    tree = lid.ppm_counts(TEXTS["x"])
    for context in tree:
        assert sum(2 ** -lid.code_length(tree, context, b) for b in range(256)) <= 1 + 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = op6_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    both = got.join(docs, "doc_id").where("held_out AND lang_pred <> 'und'")
    assert both.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, "wrong").otherwise(F.col("lang")))
    models = [lid.train(d, ~held) for d in (docs, changed)]
    assert models[0].languages == models[1].languages
    assert np.array_equal(models[0].bits, models[1].bits)


def test_edges(spark, rows):
    schema = "doc_id long, text string, lang string, score string"
    docs = rows([(1, "hello world " * 30, "a", "s"), (2, "xyz zyx " * 30, "b", "s"), (None, "nobody", None, "s"), (3, None, "a", None), (4, "", "a", None), (5, "12 !", "a", None)], schema)
    out = lid.identify(docs, lid.train(docs, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"]
    assert [r.lang_pred for r in out.collect()][:2] == ["a", "b"]
    assert [(r.lang_pred, r.score) for r in out.collect()][3:] == [("und", 0.0)] * 3
    nothing = lid.identify(docs, lid.train(docs.limit(0), F.lit(True))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    tie = lid.Model({"b": lid.ppm_counts([b"aa"]), "a": lid.ppm_counts([b"aa"])})
    assert [(r.lang_pred, r.score) for r in lid.identify(rows([(1, "aa", None, None)], schema), tie).collect()] == [("a", 0.5)]
    assert [lid.has_letter(t) for t in ("²Ⅷ_1", "ß", "語", "A")] == [False, True, True, True]


def test_whole_table_is_the_definition(spark):
    """Language and score of every text, coded byte by byte."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    sample = {}
    for language, text in lid.training_sample(docs, ~held_out).collect():
        sample.setdefault(language, []).append(text.encode())
    trees = {language: lid.ppm_counts(sorted(texts)) for language, texts in sample.items()}
    cost = {}

    def bits(language, text):
        total = 0.0
        for n in range(len(text)):
            key = language, text[max(0, n - lid.ORDER) : n], text[n]
            if key not in cost:
                cost[key] = lid.code_length(trees[language], *key[1:])
            total += cost[key]
        return total

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op6_language_id(spark, sf).collect():
        if not texts[r.doc_id] or not lid.has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lengths = {language: bits(language, texts[r.doc_id].encode()) for language in trees}
        best = min(lengths, key=lambda language: (round(lengths[language], 3), language))
        chance = 1 / sum(2 ** max(lengths[best] - n, -1000) for n in lengths.values())
        assert r.lang_pred == best and r.score == pytest.approx(chance, abs=1e-3)


def test_long_texts_are_learnt_by_a_piece(spark, rows):
    docs = rows([(1, "ab cd " * 5000, "a"), (2, "xy zw " * 5000, "b"), (3, "é" * lid.TEXT_BYTES, "c")], "doc_id long, text string, lang string")
    sample = {r.lang: r.text for r in lid.training_sample(docs, F.lit(True)).collect()}
    assert set(sample) == {"a", "b", "c"} and all(0 < len(t.encode()) <= lid.TEXT_BYTES for t in sample.values())
    model = lid.train(docs, F.lit(True))
    assert [r.lang_pred for r in lid.identify(docs, model).collect()] == ["a", "b", "c"]
    assert all(0 < rate < 8 for rate in model.rates.values())
