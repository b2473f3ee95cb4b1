"""A prefilter must let through every text that its pattern matches."""

import re

import pytest
from hypothesis import HealthCheck, Phase, given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from veilframe.functions import detection, prefilter
from veilframe.functions.dialect import plain_words, to_java
from veilframe.functions.registry import REGISTRY

# Characters newer than the JVM are left out: it cannot know whether they are digits.
KNOWN = r"NOT rlike(text, '\\p{Cn}')"


def _matches(pattern: re.Pattern, count: int) -> list[str]:
    texts: list[str] = []

    @seed(11)
    @settings(max_examples=count, database=None, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern, fullmatch=False))
    def collect(text):
        texts.append(text.encode("utf-8", "ignore").decode())

    collect()
    return [t for t in texts if pattern.search(t)]


def test_every_type_has_a_prefilter():
    assert {e.entity_type for e in REGISTRY} == set(prefilter.NEEDS)


def test_prefilters_let_all_matches_through(spark):
    samples = [(e.entity_type, t) for e, p in zip(REGISTRY, plain.COMPILED) for t in _matches(p, 150)]
    df = spark.createDataFrame(samples, "entity_type string, text string").where(KNOWN).repartition(8)
    for columns in detection.views(REGISTRY, F.col("text")):
        df = df.withColumns(columns)
    held_back = F.lit(False)
    for entity in REGISTRY:
        needs = prefilter.may_match(prefilter.NEEDS[entity.entity_type])
        passes = F.expr(" AND ".join(f"({n})" for n in needs))
        held_back = held_back | ((F.col("entity_type") == entity.entity_type) & ~passes)
    wrong = df.where(held_back).select("entity_type", "text").collect()
    assert not wrong, wrong[:5]


def test_words_are_looked_for_behind_one_look_ahead(spark):
    """The letters that may follow are checked once, and every word is still found where a
    word starts and nowhere else; plain strings need no pattern."""
    words = " ".join(dict.fromkeys(" ".join(n.words for n in prefilter.NEEDS.values()).split()))
    pattern = prefilter._word_start(words)
    assert pattern.startswith("[^a-z](?=[")
    texts = [f"{before}{w[:n]}{after}" for w in words.split() for n in (len(w) - 1, len(w)) for before in (" ", "x", " 9", " \U0001d7ce", "é") for after in ("", "z", " ")]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.rlike("text", F.lit(pattern)).alias("got")).collect()
    plainly = re.compile(f"[^a-z](?:{'|'.join(words.split())})")
    assert [r.text for r in rows if r.got != bool(plainly.search(r.text))] == []
    assert prefilter.may_match(prefilter.NEEDS["CARDHOLDER_NAME"]) == ["(contains(_folded, 'card'))"]


@pytest.mark.parametrize("plain_text", [True, False])
def test_dialect_agrees_with_python(spark, plain_text):
    """Both forms of every pattern find what Python finds."""
    samples = [(i, t) for i, p in enumerate(plain.COMPILED) for t in _matches(p, 40)]
    df = spark.createDataFrame(samples, "i int, text string").where(KNOWN).repartition(8)
    text = plain_words(F.col("text")) if plain_text else F.col("text")
    matched = F.lit(False)
    for i, entity in enumerate(REGISTRY):
        java = to_java(entity.pattern, entity.ignore_case, plain=plain_text)
        matched = matched | ((F.col("i") == i) & F.rlike("_t", F.lit(java)))
    wrong = df.withColumn("_t", text).where(~matched).collect()
    assert not wrong, wrong[:5]
