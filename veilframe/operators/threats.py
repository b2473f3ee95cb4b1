"""Threat analysis of payloads and reports over threat events.  The texts of signals and
advice are fixed values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.constants import (
    BROAD_QUERY_PATTERNS,
    ESCALATION_PATTERNS,
    INJECTION_PATTERNS,
    LOW_ROLES,
    OVERBROAD_PATTERNS,
    SEVERITY_WEIGHTS,
    TITLED_NAME,
    WRITE_VERB,
)
from veilframe.functions.dialect import strip, to_java
from veilframe.functions.prefilter import fold
from veilframe.operators.detect import detect_entities
from veilframe.operators.reports import counts_by, latest_days, latest_hours, mean, newest

THREAT_TYPES = ("PROMPT_INJECTION", "UNCONTROLLED_RAG", "PRIVILEGE_ESCALATION", "SALAMI_SLICING", "OVERBROAD_API")
BLOCK_RISK = 50

# What to do about each kind of threat.
RESPONSES = {
    "UNCONTROLLED_RAG": ("Block retrieval", "Quarantine vector chunk", "Alert SOC team", "Require scope filter"),
    "PRIVILEGE_ESCALATION": (
        "Deny access", "Revoke session token", "Flag agent for review", "Escalate to admin",
    ),
    "SALAMI_SLICING": (
        "Rate-limit agent", "Alert SOC team", "Quarantine session", "Require supervisor approval",
    ),
    "PROMPT_INJECTION": (
        "Block request", "Log injection attempt", "Alert security team", "Quarantine agent session",
    ),
    "OVERBROAD_API": (
        "Reject API call", "Flag for review", "Revoke token", "Enforce manifest constraints",
    ),
}


# A word that a text must hold, in lower case, for the pattern to match; most texts fail it quickly.
_NEEDS = {
    INJECTION_PATTERNS: (
        "ignore", "forget", "disregard", "you", "admin", "pretend", "forward", "send", "http", "output",
    ),
    BROAD_QUERY_PATTERNS: ("select", "get", "everything", "fetch", "retrieve", "filter", "where"),
    ESCALATION_PATTERNS: ("delete|drop|truncate|alter", "override", "grant", "/admin/", "privileged"),
    OVERBROAD_PATTERNS: ("getall", "filter", "bulk", "pagination", "delete"),
}


def _first_matches(patterns: Sequence[str], prefix: str, text: Column) -> list[Column]:
    """One signal per pattern that matches, showing its first match."""
    signals = []
    for pattern, need in zip(patterns, _NEEDS[patterns], strict=True):
        java = to_java(pattern, ignore_case=True)
        shown = strip(F.regexp_extract(text, java, 0))
        found = F.rlike("_folded", F.lit(need)) & F.rlike(text, F.lit(java))
        signals.append(F.when(found, F.concat(F.lit(f"{prefix}: '"), shown, F.lit("'"))))
    return signals


def _verdict(name: str, signals: Sequence[Column], per_signal: int, per_entity: int, severity, response: str) -> Column:
    """The struct of one threat type; ``severity`` is a function of the signal array."""
    found = F.array_compact(F.array(*signals))

    def build(s: Column) -> Column:
        risk = F.least(F.size(s) * per_signal + F.col("_pii") * per_entity, F.lit(100)).cast("double")
        return F.struct(
            F.lit(name).alias("threat_type"),
            (F.size(s) > 0).alias("threat_detected"),
            s.alias("signals"),
            severity(s).alias("severity"),
            risk.alias("risk_score"),
            F.when(F.size(s) > 0, response).otherwise("Log for review").alias("response_action"),
        )

    return F.get(F.transform(F.array(found), build), F.lit(0))


def _threat(name: str) -> Column:
    text, pii, role = F.col("_combined"), F.col("_pii"), F.col("agent_role")
    types = F.transform("entities", lambda e: e["entity_type"])
    low_role = F.lower(role).isin(*LOW_ROLES)

    def worst_with_pii(s):
        return F.when((F.size(s) > 0) & (pii > 0), "CRITICAL").when(F.size(s) > 0, "HIGH").otherwise("LOW")

    if name == "PROMPT_INJECTION":
        found = _first_matches(INJECTION_PATTERNS, "Injection keyword matched", text)
        found.append(F.when(pii > 0, F.concat(F.lit("PII detected in payload: "), pii.cast("string"), F.lit(" entities"))))
        return _verdict(name, found, 20, 10, worst_with_pii, "Block request and log attempt")
    if name == "UNCONTROLLED_RAG":
        found = _first_matches(BROAD_QUERY_PATTERNS, "Broad query pattern", text)
        found.append(
            F.when(
                pii > 0,
                F.concat(
                    F.lit("PII in RAG context: "), pii.cast("string"), F.lit(" entities ("),
                    F.array_join(types, ", "), F.lit(")"),
                ),
            )
        )
        return _verdict(name, found, 18, 12, worst_with_pii, "Block retrieval, quarantine chunk")
    if name == "PRIVILEGE_ESCALATION":
        found = _first_matches(ESCALATION_PATTERNS, "Escalation indicator", text)
        found.append(
            F.when(low_role, F.concat(F.lit("Low-privilege role '"), role, F.lit("' attempting restricted action")))
        )
        return _verdict(
            name, found, 25, 0, lambda s: F.when(F.size(s) > 0, "HIGH").otherwise("LOW"),
            "Deny access, revoke session token",
        )
    if name == "SALAMI_SLICING":
        distinct = F.array_sort(F.array_distinct(types))
        titled = F.regexp_extract_all(text, F.lit(to_java(TITLED_NAME)), F.lit(0))
        names = F.when(F.rlike(text, F.lit(r"[MD](?:rs?|s)")), F.array_sort(F.array_distinct(titled)))
        found = [
            F.when(
                F.size(distinct) >= 2,
                F.concat(F.lit("Multiple PII types in single request: "), F.array_join(distinct, ", ")),
            ),
            F.when(pii >= 3, F.concat(F.lit("High PII density: "), pii.cast("string"), F.lit(" entities in payload"))),
            F.when(F.size(names) > 0, F.concat(F.lit("Named subject references: "), F.array_join(names, ", "))),
        ]
        return _verdict(
            name, found, 20, 8,
            lambda s: F.when(F.size(s) >= 2, "HIGH").when(F.size(s) > 0, "MEDIUM").otherwise("LOW"),
            "Rate-limit agent, alert SOC",
        )
    if name == "OVERBROAD_API":
        found = _first_matches(OVERBROAD_PATTERNS, "Overbroad pattern", text)
        writes = F.rlike("_folded", F.lit("post|put|delete|patch")) & F.rlike(
            text, F.lit(to_java(WRITE_VERB, ignore_case=True))
        )
        found.append(F.when(low_role & writes, F.concat(F.lit("Write operation from '"), role, F.lit("' role"))))
        return _verdict(
            name, found, 22, 0, lambda s: F.when(F.size(s) > 0, "MEDIUM").otherwise("LOW"),
            "Reject API call, flag for review",
        )
    found = [F.when(pii > 0, F.concat(F.lit("PII detected: "), pii.cast("string"), F.lit(" entities")))]
    return _verdict(name, found, 0, 10, lambda s: F.lit("LOW"), "Log for review")


def recommendation() -> Column:
    risk, kind = F.col("risk_score"), F.lower(F.replace("threat_type", F.lit("_"), F.lit(" ")))
    advice = (
        F.when(risk >= 70, "Immediate action required. Block and escalate to security team.")
        .when(risk >= 40, "Moderate risk. Apply containment and monitor agent behavior.")
        .otherwise("Low risk. Log and continue monitoring.")
    )
    found = F.concat(
        F.lit("Detected "), F.size("signals").cast("string"), F.lit(" threat signal(s) (risk score: "),
        risk.cast("string"), F.lit("). "), advice,
    )
    nothing = F.concat(F.lit("No "), kind, F.lit(" indicators found. Payload appears safe."))
    return F.when(F.col("threat_detected"), found).otherwise(nothing)


def analyze(df: DataFrame, types: Sequence[str] = THREAT_TYPES) -> DataFrame:
    """One row per payload and threat type.

    Needs ``payload``; ``context``, ``agent_role`` and ``entities`` are used where
    present (entities are detected otherwise).  No shuffle.
    """
    if "entities" not in df.columns:
        df = detect_entities(df, "payload")
    keep = [F.col(c) for c in df.columns if c != "entities"]
    for name in ("context", "agent_role"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    ready = df.withColumns(
        {
            "_combined": F.concat("payload", F.lit(" "), F.coalesce("context", F.lit(""))),
            "_pii": F.size("entities"),
        }
    ).withColumn("_folded", fold(F.col("_combined")))
    verdicts = ready.select(*keep, F.inline(F.array(*[_threat(t) for t in types])))
    blocked = F.col("threat_detected") & (F.col("risk_score") >= BLOCK_RISK)
    return verdicts.withColumns(
        {
            "recommendation": recommendation(),
            "blocked": blocked,
            "status": F.when(blocked, "BLOCKED").when(F.col("threat_detected"), "FLAGGED").otherwise("PASSED"),
        }
    )


def event_rows(analyzed: DataFrame) -> DataFrame:
    """Rows for the threat event table."""
    count = F.size("signals")
    return analyzed.select(
        "threat_type",
        "severity",
        F.coalesce("agent_id", F.lit("unknown")).alias("agent_id"),
        F.concat(F.lit("Simulated "), "threat_type", F.lit(": "), count.cast("string"), F.lit(" signal(s) detected")).alias(
            "description"
        ),
        F.when(count > 0, F.array_join("signals", "; ")).otherwise("No signals").alias("detection_signal"),
        "response_action",
        "status",
        *[c for c in ("timestamp",) if c in analyzed.columns],
    )


def list_threats(
    events: DataFrame,
    threat_type: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    agent_id: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    equal = {"threat_type": threat_type, "severity": severity, "status": status, "agent_id": agent_id}
    return newest(events, equal, "timestamp", "id", date_from, date_to, limit, offset, after)


def get_threat(events: DataFrame, threat_id: int) -> DataFrame:
    return events.where(F.col("id") == threat_id)


def stats(events: DataFrame) -> DataFrame:
    """Counts by type, severity, status and agent: ``dimension, value, n``."""
    return counts_by(events, ["threat_type", "severity", "status", "agent_id"])


def hours(events: DataFrame) -> DataFrame:
    return latest_hours(events, "timestamp")


def severity_weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def risk_trend(events: DataFrame, days: int = 14) -> DataFrame:
    """Mean severity weight per day, over the last days that have events."""
    daily = latest_days(events, days).groupBy(F.to_date("timestamp").alias("day")).agg(
        mean(severity_weight(F.col("severity")), 2).alias("avg_severity")
    )
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def resolve(events: DataFrame, resolutions: DataFrame, order: str = "requested_at") -> tuple[DataFrame, DataFrame]:
    """Apply ``resolutions`` (``id, note`` and the column ``order``).  The first request
    for an open threat resolves it (the smaller note, if two are first); every other
    one is rejected.  Returns the new event table and the rejected requests, a row each,
    with a ``reason``."""
    # equal requests are counted before they are joined
    asked = resolutions.groupBy("id", F.col(order).alias("_order"), F.coalesce("note", F.lit("")).alias("note")).agg(F.count("*").alias("n"))
    first = asked.groupBy("id").agg(F.min(F.struct("_order", "note")).alias("_first"))
    marked = events.join(first, "id", "left")
    applies = F.col("_first").isNotNull() & ~F.col("status").eqNullSafe("RESOLVED")
    updated = marked.select(
        *[c for c in events.columns if c not in ("response_action", "status")],
        F.when(applies, F.concat(F.lit("RESOLVED: "), "_first.note")).otherwise(F.col("response_action")).alias("response_action"),
        F.when(applies, "RESOLVED").otherwise(F.col("status")).alias("status"),
    ).select(*events.columns)
    mine = F.col("id").eqNullSafe(F.col("_id"))
    known = asked.join(first.withColumnRenamed("id", "_id"), mine).join(events.select("id", F.coalesce("status", F.lit("")).alias("status")), "id", "left")
    wins = (F.col("status") != "RESOLVED") & F.struct("_order", "note").eqNullSafe(F.col("_first"))
    left = F.col("n") - F.when(wins, 1).otherwise(0)
    reason = F.when(F.col("status").isNull(), "threat event not found").otherwise("threat is already resolved")
    refused = known.withColumn("_left", left).where("_left > 0").select(
        "id", "note", reason.alias("reason"), F.explode(F.sequence(F.lit(1), F.col("_left").cast("int")))
    )
    return updated, refused.drop("col")


def catalogue(spark: SparkSession) -> DataFrame:
    """The known threat types and the responses to them."""
    return spark.createDataFrame(
        [(t, list(r)) for t, r in RESPONSES.items()], "threat_type string, response_actions array<string>"
    )
