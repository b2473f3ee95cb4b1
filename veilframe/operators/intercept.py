"""Interception: risk, action and masked payload per row, in batch or on a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import lookup, masking
from veilframe.functions.constants import BLOCK_RISK, MAX_RISK, OTHER_RISK_WEIGHT, POLICY_ESCALATION, RISK_WEIGHTS
from veilframe.functions.registry import REGISTRY
from veilframe.operators.detect import detect_entities
from veilframe.operators.reports import counts_by, latest_hours, mean, newest
from veilframe.sources.staging import stage_files

PREVIEW_CHARS = 200


def risk_points(entities: Column) -> Column:
    """Risk points of an entity array before the cap."""
    weights = lookup.int_map(RISK_WEIGHTS)
    return F.aggregate(
        entities, F.lit(0), lambda total, e: total + lookup.get(weights, e["entity_type"], OTHER_RISK_WEIGHT)
    )


def capped(points: Column) -> Column:
    return F.least(points, F.lit(MAX_RISK)).cast("double")


def action_for(risk: Column, found: Column) -> Column:
    return F.when(risk >= BLOCK_RISK, "BLOCKED").when(found > 0, "TOKENIZED").otherwise("PASSED")


def recommendation(action: Column, points: Column, found: Column) -> Column:
    shown = F.when(points > MAX_RISK, F.lit(f"{MAX_RISK}.0")).otherwise(points.cast("string"))
    facts = F.concat(F.lit("("), found.cast("string"), F.lit(" entities, risk "), shown, F.lit(")"))
    # The advice's texts.
    blocked = F.concat(
        F.lit("High-risk payload blocked "), facts, F.lit(". Review agent permissions and apply stricter policy rules.")
    )
    tokenized = F.concat(
        F.lit("Payload tokenized "), facts, F.lit(". Entities replaced with vault tokens. Safe to forward.")
    )
    return (
        F.when(action == "BLOCKED", blocked)
        .when(action == "TOKENIZED", tokenized)
        .otherwise("No sensitive entities detected. Payload passed without modification.")
    )


def _hitting_rules(rules: DataFrame) -> DataFrame:
    """Per policy the distinct (type, action) rules that a payload can hit: at most
    one row per known type and action, so the array stays small."""
    known = [e.entity_type for e in REGISTRY]
    distinct = (
        rules.where(F.col("entity_type").isin(known))
        .groupBy("policy_id", "entity_type", F.coalesce("action", F.lit("LOG")).alias("action"))
        .agg(F.min("pos").alias("pos"))
    )
    return distinct.groupBy("policy_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "entity_type", "action"))).alias("_policy")
    )


def assess(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Risk, action, advice and masked payload for rows with ``payload`` and
    ``entities``; with ``rules``, also what the row's ``policy_id`` says.

    A stream keeps the rules it is started with; if they are small, its payloads are not
    shuffled, whatever share of them a policy has."""
    decisions = F.array().cast("array<struct<entity_type:string,action:string>>")
    if rules is not None:
        folded = _hitting_rules(rules)
        if df.isStreaming:  # of stored rules Spark knows the size, and a stream's plan is not mended as it runs
            folded = stage_files(folded, "rules")
        df = df.join(folded, "policy_id", "left")
        types = F.transform("entities", lambda e: e["entity_type"])
        hit = F.filter("_policy", lambda r: F.array_contains(types, r["entity_type"]))
        decisions = F.coalesce(
            F.transform(hit, lambda r: F.struct(r["entity_type"].alias("entity_type"), r["action"].alias("action"))),
            decisions,
        )
    df = df.withColumn("policy_decisions", decisions).withColumn("entities_found", F.size("entities"))
    escalated = F.exists("policy_decisions", lambda d: d["action"] == "REDACT")
    df = df.withColumn(
        "_points", risk_points(F.col("entities")) + F.when(escalated, POLICY_ESCALATION).otherwise(0)
    ).withColumn("risk_score", capped(F.col("_points")))
    df = df.withColumn("action_taken", action_for(F.col("risk_score"), F.col("entities_found")))
    return df.withColumns(
        {
            "sanitized_payload": masking.splice(F.col("payload"), F.col("entities"), lambda e: masking.label(e["entity_type"])),
            "recommendation": recommendation(F.col("action_taken"), F.col("_points"), F.col("entities_found")),
        }
    ).drop("_points", "_policy")


def intercept(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Detect and assess ``payload``.  Row by row, so it also runs on a stream."""
    return assess(detect_entities(df, "payload"), rules)


def with_vault_ref(df: DataFrame, key: str) -> DataFrame:
    ref = F.concat(F.lit("vault://"), F.substring(F.sha2(F.concat_ws("|", key, "payload"), 256), 1, 32))
    return df.withColumn("vault_ref", F.when(F.col("action_taken") == "TOKENIZED", ref))


def log_rows(df: DataFrame, direction: str = "INBOUND") -> DataFrame:
    """Rows for the interceptor log: the payload is cut, a missing agent is 'unknown'."""
    return df.select(
        "surface",
        F.lit(direction).alias("direction"),
        F.coalesce("agent_id", F.lit("unknown")).alias("agent_id"),
        F.substring("payload", 1, PREVIEW_CHARS).alias("payload_preview"),
        "entities_found",
        "action_taken",
        *[c for c in ("id", "latency_ms", "timestamp") if c in df.columns],
    )


def batch_totals(df: DataFrame) -> DataFrame:
    """One row: payloads, entities and blocked payloads."""
    return df.agg(
        F.count("*").alias("total_payloads"),
        F.coalesce(F.sum("entities_found"), F.lit(0)).alias("total_entities"),
        F.count_if(F.col("action_taken") == "BLOCKED").alias("total_blocked"),
    )


def list_logs(
    logs: DataFrame,
    surface: str | None = None,
    direction: str | None = None,
    agent_id: str | None = None,
    action_taken: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Log rows, newest first; only the filters that are set reach the scan."""
    equal = {"surface": surface, "direction": direction, "agent_id": agent_id, "action_taken": action_taken}
    return newest(logs, equal, "timestamp", "id", date_from, date_to, limit, offset, after)


def log_stats(logs: DataFrame) -> DataFrame:
    """Counts by surface, action and agent in one pass: ``dimension, value, n``."""
    return counts_by(logs, ["surface", "action_taken", "agent_id"])


def log_totals(logs: DataFrame) -> DataFrame:
    action = F.col("action_taken")
    return logs.agg(
        F.count("*").alias("total"),
        F.count_if(action == "BLOCKED").alias("total_blocked"),
        F.count_if(action == "TOKENIZED").alias("total_tokenized"),
        F.count_if(action.isin("PASSED", "LOGGED")).alias("total_passed"),
        F.coalesce(mean("latency_ms", 1), F.lit(0.0)).alias("avg_latency"),
    )


def log_hours(logs: DataFrame) -> DataFrame:
    return latest_hours(logs, "timestamp")
