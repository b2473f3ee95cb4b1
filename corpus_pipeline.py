"""Corpus pipeline: stages applied to ``documents`` one after the other.

Language identification drops texts without a language, quality rules drop failing
texts, one document of each group of near duplicates stays, sources are mixed to their
target weights, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.language_id import identify, train
from veilframe.llm.mixing import mix_sources
from veilframe.llm.near_dedup import drop_near_duplicates
from veilframe.llm.pieces import encode_texts
from veilframe.llm.quality import judge_quality, learn_ratio
from veilframe.llm.queries import MIX_OTHER, MIX_SEED, MIX_WEIGHTS, piece_model, table
from veilframe.llm.shared import written

#: Texts whose best language is less likely than this are rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Bits a byte above a language's own rate from which texts are rejected.
MAX_EXTRA_BITS = 8.0


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns that an operator would replace renamed, and its own
    columns as they are found afterwards."""
    moved = {}
    for name in docs.columns:
        if name in names:
            new = f"_{name}"
            while new in docs.columns:
                new = f"_{new}"
            moved[name] = new
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the labelled texts: likelier
    than in all others together, and without costing a byte more for each byte than the
    language's own texts do, as other languages, codes and noise would."""
    model = train(docs, F.lit(True))
    docs, own = _aside(docs, ("lang_pred", "score", "bits_per_byte"))
    likely = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
    spoken = F.lit(False)
    for language, rate in model.rates.items():
        spoken |= (F.col("lang_pred") == language) & (F.col("bits_per_byte") <= rate + MAX_EXTRA_BITS)
    return identify(docs, model).where(likely & spoken).select(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    ratio = learn_ratio(docs, table(spark, sf_dir, "labels"))
    docs, own = _aside(docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"))
    return judge_quality(docs, ratio).where("kept").select(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    docs, own = _aside(docs, ("copy", "mix_key"))
    return mix_sources(docs, MIX_WEIGHTS, MIX_OTHER, seed=MIX_SEED).select(own)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of what they decode to."""
    return encode_texts(docs.select("doc_id", "lang", "source", "text"), piece_model(), with_ids=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", pieces),
]

#: Trained models and sketches are not expressible in SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
