"""Entity detection over DataFrames of texts: no shuffle, one pass, any size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import detection
from veilframe.functions.registry import REGISTRY, Entity, select


def detect_entities(
    df: DataFrame,
    text: str = "text",
    types: Iterable[str] | None = None,
    registry: Sequence[Entity] = REGISTRY,
    output: str = "entities",
) -> DataFrame:
    """Add ``output``, the array of entities found in ``text``, ordered by offset."""
    views, found = _columns(tuple(select(types, registry)), text, df.sparkSession.sparkContext.applicationId)
    viewed = df
    for columns in views:
        viewed = viewed.withColumns(columns)
    # One row in, one row out.  As a generator's output the array is computed once: a plain
    # projection would be copied into every filter and expression that reads the column.
    return viewed.select(*df.columns, F.explode(F.array(found)).alias(output))


@lru_cache(maxsize=16)
def _columns(rows: tuple[Entity, ...], text: str, application: str) -> tuple[list[dict[str, Column]], Column]:
    """The expressions of a registry, assembled once in an application."""
    return detection.views(rows, F.col(text)), detection.entities(rows, F.col(text))


def explode_entities(df: DataFrame, *keep: str | Column, entities: str = "entities") -> DataFrame:
    """One row per entity: ``keep``, then the nine fields of the entity."""
    rows = df.select(*keep, F.explode_outer(entities).alias("_e"))
    return rows.where(F.col("_e.start").isNotNull()).select(*[c for c in rows.columns if c != "_e"], "_e.*")


def batch_counts(df: DataFrame, *keep: str) -> DataFrame:
    """Entities per text of a batch."""
    return df.select(*keep, F.size("entities").alias("entity_count"))


def batch_totals(df: DataFrame) -> DataFrame:
    """One row: texts and entities of a batch."""
    return df.agg(
        F.count("*").alias("total_texts"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("total_entities")
    )


def residual_check(df: DataFrame, text: str = "sanitized_text") -> DataFrame:
    """Whether a sanitized text is clean, and what is still found in it."""
    found = detect_entities(df, text, output="remaining_entities")
    left = F.size("remaining_entities")
    return found.withColumn("entities_found", left).withColumn("clean", left == 0)


def filter_entities(
    df: DataFrame, min_confidence: float = 0.75, enabled: Iterable[str] | None = None
) -> DataFrame:
    """Keep only sure enough entities of the enabled types (all for ``None``)."""
    wanted = None if enabled is None else list(enabled)

    def keep(e):
        sure = e["confidence"] >= min_confidence
        return sure if wanted is None else sure & e["entity_type"].isin(wanted)

    return df.withColumn("entities", F.filter("entities", keep))


def merge_validations(detections: DataFrame, validations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the verdict of an outside reviewer (``key, text, seq, valid, confidence,
    reason``) to entities of the same text.  The last verdict counts; an entity
    without one counts as valid."""
    last = validations.groupBy(key, F.col("text").alias("original_text")).agg(
        F.max_by(F.struct("valid", "confidence", "reason"), "seq").alias("_v")
    )
    judged = F.col("_v").isNotNull()
    return detections.join(last, [key, "original_text"], "left").select(
        *detections.columns,
        F.coalesce("_v.valid", F.lit(True)).alias("ai_validated"),
        F.when(judged, F.coalesce("_v.confidence", "confidence")).alias("ai_confidence"),
        F.when(judged, F.coalesce("_v.reason", F.lit(""))).alias("ai_reason"),
    )


def quality_share(detections: DataFrame) -> DataFrame:
    """Percentage of entities with a confidence above 0.9."""
    return detections.agg(
        F.coalesce(F.round(F.avg(F.when(F.col("confidence") > 0.9, 100.0).otherwise(0.0)), 1), F.lit(0.0)).alias(
            "detection_accuracy"
        )
    )


def registry_frame(spark: SparkSession, registry: Sequence[Entity] = REGISTRY) -> DataFrame:
    """The registry as a small table, one row per entity type."""
    rows = [
        (e.entity_type, e.category, e.base_confidence, e.regulatory_basis, e.default_action, e.risk_level,
         list(e.keywords), e.strict)
        for e in registry
    ]
    return spark.createDataFrame(
        rows,
        "entity_type string, category string, base_confidence double, regulatory_basis string, default_action string, "
        "risk_level string, context_keywords array<string>, format_strict boolean",
    )


def registry_stats(registry: DataFrame, detections: DataFrame) -> DataFrame:
    """Types per category and how many entities of it were found, with a TOTAL row."""
    found = detections.groupBy("entity_type").agg(F.count("*").alias("n"))
    return (
        registry.select("category", "entity_type")
        .join(found, "entity_type", "left")
        .rollup("category")
        .agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.grouping_id().alias("gid"))
        .select(F.when(F.col("gid") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "types", "entities")
    )
