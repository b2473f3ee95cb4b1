import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_near_dedup import brute as near_brute
from test_quality import brute as base_counts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "sentencepiece"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    spoken = cp.language_id(spark, docs, SF)
    assert spoken.columns == docs.columns
    spoken_ids = {r.doc_id for r in spoken.collect()}
    assert {i for i, t in texts.items() if t is None or not any(map(str.isalpha, t))}.isdisjoint(spoken_ids)

    good = cp.quality(spark, spoken, SF)
    good_ids = {r.doc_id for r in good.collect()}
    assert good_ids <= spoken_ids
    for i in good_ids:
        n, _, _, _, repeated = base_counts(texts[i])
        assert n >= 10 and 100 * repeated <= 20 * n

    alone = cp.near_dedup(spark, good, SF)
    kept = {i for i, (_, c) in near_brute({i: texts[i] for i in good_ids}, 5).items() if i == c}
    assert {r.doc_id for r in alone.collect()} == kept

    mixed = cp.mixing(spark, alone, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= kept

    encoded = cp.pieces(spark, mixed, SF)
    assert encoded.count() == mixed.count()
    for r in encoded.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark):
    first, second = (sorted((r.doc_id, r.ids_sha256) for r in cp.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first


def test_stages_survive_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for values in ([], [(None, None, None, None, None), (1, "", None, "src0", 0), (1, "x " * 30, "en", "src0", 60)] * 2):
        docs = spark.createDataFrame(values, schema)
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, SF)
            docs.write.parquet(f"{tmp_path}/{len(values)}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(values)}/{k}")


def test_columns_with_names_of_the_operators_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "lang_pred", "bits_per_byte", "_score", "n_words", "kept", "llr", "copy", "mix_key"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), "doc_id"))
    for stage in (cp.language_id, cp.quality, cp.mixing):
        docs = stage(spark, docs, SF)
        assert docs.columns[-len(names) :] == names
    rows = docs.collect()
    assert rows and all(r[name] == f"{i}-{r.doc_id}" for r in rows for i, name in enumerate(names))


def test_noise_and_unknown_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = ["QUJD" * 300, "zxqvkj wqpz " * 40, "кириллица русский текст " * 20, "3f9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c" * 10]
    more = spark.createDataFrame([(10**6 + i, t, None, None, len(t)) for i, t in enumerate(noise)], docs.schema)
    left = {r.doc_id for r in cp.language_id(spark, docs.unionByName(more), SF).collect()}
    texts = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert left == texts
