"""Dashboard reports.  Every table is aggregated before it meets another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import lookup
from veilframe.functions.constants import CATEGORIES, CATEGORY_NAMES, SEVERITY_WEIGHTS
from veilframe.operators.reports import hour_of, latest_days, mean, one_row
from veilframe.operators.threats import severity_weight


def category_of(entity_type: Column) -> Column:
    return lookup.get(lookup.text_map(CATEGORIES), entity_type, "CUSTOM")


def stats(
    sessions: DataFrame, entities: DataFrame, threats: DataFrame, events: DataFrame, frameworks: DataFrame
) -> DataFrame:
    """The eleven headline figures in one row."""
    scans = sessions.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum("entities_protected"), F.lit(0)).alias("entities_protected"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_sessions"),
        F.count_if(F.col("status") == "EXPIRED").alias("expired_sessions"),
    )
    danger = threats.agg(
        F.count_if(F.col("status") == "BLOCKED").alias("threats_blocked"),
        F.count_if(F.col("status") == "FLAGGED").alias("threats_flagged"),
        F.coalesce(mean(severity_weight(F.col("severity")), 2), F.lit(0.0)).alias("risk_score"),
    )
    latency = events.agg(F.coalesce(mean("latency_ms", 1), F.lit(0.0)).alias("avg_latency_ms"))
    total = F.sum("controls_total")
    score = frameworks.agg(
        F.coalesce(F.round(F.when(total > 0, F.sum("controls_passing") / total * 100), 1), F.lit(0.0)).alias(
            "compliance_score"
        )
    )
    # Tokens per session first: the join then meets one row per session on both sides.
    tokens = entities.groupBy("session_id").agg(
        F.count_if(F.col("action") == "TOKENIZE").alias("tokens"),
        F.count("*").alias("entities"),
        F.count_if(F.col("confidence") > 0.9).alias("sure"),
    )
    active = sessions.where("status = 'ACTIVE'").select(F.col("id").alias("session_id"), F.lit(True).alias("active"))
    vault = tokens.join(active, "session_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("active"), F.col("tokens"))), F.lit(0)).alias("vault_utilization"),
        F.coalesce(F.round(F.sum("sure") / F.sum("entities") * 100, 1), F.lit(0.0)).alias("detection_accuracy"),
    )
    return one_row(scans, danger, latency, score, vault)


def timeline(entities: DataFrame, hours: int = 24) -> DataFrame:
    """Entities per hour, in total and by category, newest hours first."""
    category = category_of(F.col("entity_type"))
    columns = [F.count_if(category == name).alias(name) for name in CATEGORY_NAMES]
    counts = latest_days(entities, hours).groupBy(hour_of("detected_at").alias("hour")).agg(F.count("*").alias("total"), *columns)
    return counts.orderBy(F.desc("hour")).limit(hours)


def distribution(entities: DataFrame) -> DataFrame:
    """Counts by type and by category: ``level`` tells rows of a type from those of a
    category, whose ``entity_type`` is null, too."""
    by_type = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    return (
        by_type.withColumn("category", category_of(F.col("entity_type")))
        .rollup("category", "entity_type")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
        .where("gid < 3")
        .select("category", "entity_type", F.when(F.col("gid") == 0, "type").otherwise("category").alias("level"), "n")
    )


def recent_threats(threats: DataFrame, limit: int = 20) -> DataFrame:
    shown = threats.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return shown.select("id", "threat_type", "severity", "agent_id", "description", "status", "timestamp")


def threat_summary(threats: DataFrame, now: Column) -> DataFrame:
    """One row: threats by severity, of the last day and of the day before, and the trend."""
    day = F.make_interval(days=F.lit(1))
    time = F.col("timestamp")
    counted = threats.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_WEIGHTS],
        F.count_if(time >= now - day).alias("last_24h"),
        F.count_if((time >= now - day - day) & (time < now - day)).alias("previous_24h"),
    )
    last, before = F.col("last_24h"), F.col("previous_24h")
    return counted.withColumn(
        "trend", F.when(last > before, "increasing").when(last < before, "decreasing").otherwise("stable")
    )


def agent_activity(sessions: DataFrame, threats: DataFrame) -> DataFrame:
    """Scans, entities and threats per agent, for agents that have any."""
    scans = sessions.where("agent_id IS NOT NULL").groupBy("agent_id").agg(
        F.count("*").alias("scan_count"), F.sum("entities_protected").alias("entities_detected")
    )
    triggered = threats.where("agent_id IS NOT NULL").groupBy("agent_id").agg(F.count("*").alias("threats_triggered"))
    return scans.join(triggered, "agent_id", "full_outer").fillna(
        0, ["scan_count", "entities_detected", "threats_triggered"]
    )


def top_entities(entities: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent types with their mean confidence."""
    counts = entities.groupBy("entity_type").agg(
        F.count("*").alias("n"), mean("confidence", 3).alias("avg_confidence")
    )
    top = counts.orderBy(F.desc("n"), "entity_type").limit(limit)
    return top.withColumn("category", category_of(F.col("entity_type")))


def surface_activity(logs: DataFrame) -> DataFrame:
    action = F.col("action_taken")
    return logs.groupBy("surface").agg(
        F.count("*").alias("total_intercepts"),
        F.count_if(action == "BLOCKED").alias("blocked"),
        F.count_if(action == "TOKENIZED").alias("tokenized"),
        F.count_if(action == "LOGGED").alias("logged"),
        F.sum("entities_found").alias("total_entities"),
        mean("latency_ms", 1).alias("avg_latency_ms"),
    )


def risk_heatmap(sessions: DataFrame, entities: DataFrame, threats: DataFrame) -> DataFrame:
    """Risk per agent and entity type, at most 10: frequent types detected with
    little confidence, plus a tenth of the agent's threat weight."""
    per_session = entities.groupBy("session_id", "entity_type").agg(
        F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(20,6)")).alias("sum_confidence")
    )
    owners = sessions.where("agent_id IS NOT NULL").select(F.col("id").alias("session_id"), "agent_id")
    cells = per_session.join(owners, "session_id").groupBy("agent_id", "entity_type").agg(
        F.sum("n").alias("n"), F.sum("sum_confidence").alias("s")
    )
    weights = threats.where("agent_id IS NOT NULL").groupBy("agent_id").agg(
        F.sum(severity_weight(F.col("severity"))).alias("weight")
    )
    # n * (1 - mean) is n minus the sum; all in decimals, so the order of rows does not matter.
    bonus = F.coalesce("weight", F.lit(0)).cast("decimal(20,6)") / 10
    risk = F.least(F.col("n") - F.col("s") + bonus, F.lit(10))
    return cells.join(weights, "agent_id", "left").select(
        "agent_id",
        "entity_type",
        "n",
        F.round(F.col("s") / F.col("n"), 3).cast("double").alias("avg_confidence"),
        F.round(risk, 2).cast("double").alias("risk_score"),
   
    )


def heatmap_axes(cells: DataFrame) -> DataFrame:
    """The two axes of the heat map as ``axis, value`` rows."""
    agents = cells.select(F.lit("agent").alias("axis"), F.col("agent_id").alias("value")).distinct()
    types = cells.select(F.lit("entity_type").alias("axis"), F.col("entity_type").alias("value")).distinct()
    return agents.union(types)
