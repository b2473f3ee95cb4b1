"""Scan sessions: listing, detail, extension and erasure as table-to-table jobs.

Changes return new tables, which the caller writes, or change stored tables in place
(``purge_stored``).  Requests that cannot be carried out come back in a ``rejected`` frame.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.reports import chosen, newest
from veilframe.sources.rewrite import erase_rows, finish_rewrites, rewrite_rows
from veilframe.sources.staging import stage
from veilframe.sources.tables import read_table

TTL_HOURS = 24
MAX_EXTENSION_HOURS = 168


def create_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """New ACTIVE sessions for ``id, name, agent_id, policy_id``, open for a day."""
    return requests.select(
        "id",
        "name",
        now.alias("created_at"),
        (now + F.make_interval(hours=F.lit(TTL_HOURS))).alias("expires_at"),
        F.lit("ACTIVE").alias("status"),
        "agent_id",
        "policy_id",
        F.lit(0).cast("bigint").alias("entities_protected"),
        F.lit(0).cast("bigint").alias("tokens_generated"),
    )


def list_sessions(
    sessions: DataFrame,
    status: str | None = None,
    agent_id: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    equal = {"status": status, "agent_id": agent_id}
    return newest(sessions, equal, "created_at", "id", date_from, date_to, limit, offset, after)


def count_sessions(
    sessions: DataFrame,
    status: str | None = None,
    agent_id: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
) -> DataFrame:
    equal = {"status": status, "agent_id": agent_id}
    return chosen(sessions, equal, "created_at", date_from, date_to).agg(F.count("*").alias("total"))


def session_detail(sessions: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Every session with its vault figures.  The entities and events themselves are
    rows of ``session_entities`` and ``audit.session_trail``."""
    action = F.col("action")
    vault = entities.groupBy("session_id").agg(
        F.count_if(action == "TOKENIZE").alias("tokenized"),
        F.count_if(action == "REDACT").alias("redacted"),
        F.count_if(action == "MASK").alias("masked"),
        F.count("*").alias("total_entities"),
    )
    trail = events.groupBy("session_id").agg(F.count("*").alias("total_audit_events"))
    figures = ["tokenized", "redacted", "masked", "total_entities", "total_audit_events"]
    joined = sessions.join(vault, F.col("id") == vault["session_id"], "left").drop("session_id")
    joined = joined.join(trail, F.col("id") == trail["session_id"], "left").drop("session_id")
    return joined.fillna(0, figures)


def session_entities(entities: DataFrame, session_id) -> DataFrame:
    """The entities of one session in order of detection."""
    return entities.where(F.col("session_id") == F.lit(session_id)).orderBy("detected_at", "id")


def session_counts(entities: DataFrame) -> DataFrame:
    """Protected entities per session, each with its token."""
    return entities.groupBy("session_id").agg(
        F.count("*").alias("entities_protected"), F.count("*").alias("tokens_generated")
    )


def _event(kind: str, now: Column, details: Column, number: Column) -> list[Column]:
    """An audit event about a session; ``number`` tells its events of one kind apart."""
    digest = F.sha2(F.concat_ws("|", F.lit(kind), F.col("id").cast("string"), now.cast("string"), number), 256)
    return [
        F.concat(F.lit("evt_"), F.substring(digest, 1, 32)).alias("event_id"),
        F.lit(kind).alias("event_type"),
        F.col("id").alias("session_id"),
        "agent_id",
        F.lit(None).cast("string").alias("agent_role"),
        "policy_id",
        F.to_json(details).alias("entities_json"),
        F.lit(0.0).alias("latency_ms"),
        F.lit("session-manager").alias("target_service"),
        now.alias("timestamp"),
    ]


def extend_sessions(sessions: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Push the expiry of the sessions in ``requests`` (``session_id, hours``) and set
    them ACTIVE.  Every request is judged by itself: a session gets the sum of its
    accepted hours.  Returns the new sessions, an audit event for each accepted request
    (to be numbered by ``audit.number_events`` and chained) and the rejected requests, a
    row each, with a ``reason``."""
    # equal requests are counted before they are joined
    asked = requests.groupBy("session_id", "hours").agg(F.count("*").alias("n"))
    in_range = F.coalesce(F.col("hours").between(1, MAX_EXTENSION_HOURS), F.lit(False))
    added = asked.where(in_range).groupBy("session_id").agg(F.sum(F.col("hours") * F.col("n")).alias("_hours"))
    marked = sessions.join(added, sessions["id"] == added["session_id"], "left").drop("session_id")
    extends = F.coalesce(F.col("_hours").isNotNull() & (F.col("status") != "PURGED"), F.lit(False))
    updated = marked.select(
        *[c for c in sessions.columns if c not in ("expires_at", "status")],
        F.when(extends, F.coalesce("expires_at", now) + F.make_interval(hours=F.col("_hours").cast("int")))
        .otherwise(F.col("expires_at"))
        .alias("expires_at"),
        F.when(extends, "ACTIVE").otherwise(F.col("status")).alias("status"),
    ).select(*sessions.columns)
    known = asked.join(sessions.select("id", "status", "agent_id", "policy_id"), F.col("session_id") == F.col("id"), "left")
    reason = (
        F.when(F.col("id").isNull(), "session not found")
        .when(F.col("status") == "PURGED", "cannot extend a purged session")
        .when(~in_range, f"hours must be between 1 and {MAX_EXTENSION_HOURS}")
    )
    singly = known.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).withColumn("reason", reason)
    number = F.concat_ws("|", F.col("hours").cast("string"), F.col("_i").cast("string"))
    events = singly.where("reason IS NULL").select(
        *_event("SESSION_EXTEND", now, F.struct(F.col("hours").alias("hours_added")), number)
    )
    return updated, events, singly.where("reason IS NOT NULL").select("session_id", "hours", "reason")


def _erased(sessions: DataFrame, flags: DataFrame) -> DataFrame:
    """Sessions, those in ``flags`` (``id, _purge``) marked PURGED and without counts."""
    hit = F.coalesce("_purge", F.lit(False))
    return sessions.join(flags, "id", "left").withColumns(
        {
            "status": F.when(hit, "PURGED").otherwise(F.col("status")),
            "entities_protected": F.when(hit, 0).otherwise(F.col("entities_protected")),
            "tokens_generated": F.when(hit, 0).otherwise(F.col("tokens_generated")),
        }
    ).select(*sessions.columns)


def purge(
    sessions: DataFrame, entities: DataFrame, requests: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Right to erasure for the sessions in ``requests`` (``session_id``).  Returns the
    new sessions, the remaining entities, audit events and the rejected requests."""
    asked = requests.select("session_id").distinct()
    flags = asked.select(F.col("session_id").alias("id"), F.lit(True).alias("_purge"))
    updated = _erased(sessions, flags)
    remaining = entities.join(asked, "session_id", "left_anti")
    lost = entities.join(asked, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("_n"))
    erased = sessions.join(flags, "id").join(lost, F.col("id") == lost["session_id"], "left").drop("session_id")
    events = erased.select(
        *_event("SESSION_PURGE", now, F.struct(F.coalesce("_n", F.lit(0)).alias("entities_purged")), F.lit(1))
    )
    rejected = asked.join(sessions, asked["session_id"] == sessions["id"], "left_anti").select(
        "session_id", F.lit("session not found").alias("reason")
    )
    return updated, remaining, events, rejected


def purge_stored(
    spark: SparkSession, sessions_path: str, entities_path: str, requests: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """The same in place, on stored ``scan_sessions`` and ``entities_detected``: only files
    that hold rows of the sessions are rewritten (``sources.rewrite``).  Returns the audit
    events, to be chained and appended, and the rejected requests.

    Events and requests are worked out and kept before the first row goes.  Entities go
    first: a run that is cut off after them is repeated, and its events then count what
    was left; a session is only PURGED once its entities are gone."""
    def stored(name: str, path: str):
        return lambda: read_table(spark, name, path)

    for path in (sessions_path, entities_path):
        finish_rewrites(spark, path)
    sessions, entities = stored("scan_sessions", sessions_path), stored("entities_detected", entities_path)
    _, _, events, rejected = purge(sessions(), entities(), requests, now)
    events, rejected = stage(events), stage(rejected)
    asked = events.select("session_id")
    erase_rows(spark, entities_path, entities, asked, "session_id")
    flags = asked.select(F.col("session_id").alias("id"), F.lit(True).alias("_purge"))
    rewrite_rows(spark, sessions_path, sessions, flags, "id", lambda rows: _erased(rows, flags))
    return events, rejected
