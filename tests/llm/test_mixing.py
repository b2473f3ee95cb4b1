import math

import pytest
from pyspark.sql import functions as F

from veilframe.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string"


def test_counts_follow_the_poisson_distribution(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 18_000, "a").otherwise("b").alias("source"))
    mixed = mix_sources(docs, {"a": 1.0, "b": 3.0}, seed=3)
    n = dict(mixed.groupBy("source").count().collect())
    assert abs(n["a"] - 5_000) < 300 and abs(n["b"] - 15_000) < 500
    counts = dict(mixed.where("source = 'b'").groupBy("doc_id").count().groupBy("count").agg(F.count("*")).collect())
    rate = 7.5
    for k in range(4, 12):
        expected = 2_000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts[k] - expected) < 5 * math.sqrt(expected)


def test_high_rates_are_sums_of_parts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    n = mix_sources(docs, {"a": 1}, total=300 * 100).count()
    assert abs(n - 30_000) < 5 * math.sqrt(30_000)


def test_nulls_repeats_clashes_and_unwanted_sources(spark):
    values = [(1, "x", "a", 5), (1, "x", "a", 5), (None, "y", "a", 6), (None, None, "a", 7), (2, "z", None, 8), (3, "z", "q", 9)] * 20
    docs = spark.createDataFrame(values, SCHEMA + ", copy long")
    mixed = mix_sources(docs, {"a": 1.0}, other=0.0, total=600)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    assert {r.source for r in mixed.collect()} == {"a"}
    assert {r.source for r in mix_sources(docs, {"a": 1.0}, other=1.0, total=600).collect()} == {"a", None, "q"}
    assert mixed.collect() == mix_sources(docs, {"a": 1.0}, total=600).collect()
    per_row = {c for (c,) in mixed.where("doc_id = 1").groupBy("copy").count().select("count").collect()}
    assert per_row == {40}


def test_empty_and_bad_weights(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty, {"a": 1.0}).count() == 0
    for weights in ({}, {"a": 0.0}, {"a": -1.0}):
        with pytest.raises(ValueError):
            mix_sources(empty, weights)


def test_order_is_spread(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    mixed = mix_sources(docs, {"a": 1.0}).withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in mixed}:
        keys = [r.mix_key for r in mixed if r.p == p]
        assert keys == sorted(keys)
