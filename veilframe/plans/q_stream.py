"""Queries: the streaming operators, run as streams over the test files.

A stream in append mode only gives windows that the watermark has passed, so the
SQL keeps those that end an hour or more before the last event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.functions.constants import BLOCK_RISK, POLICY_ESCALATION, VAULT_TYPES
from veilframe.operators import audit
from veilframe.plans.catalog import joined, query, shown, shown_sql
from veilframe.plans.derived import AGENTS, SURFACES, _case, sql, table
from veilframe.plans.detection_sql import spliced
from veilframe.plans.q_detect import ENTS
from veilframe.plans.q_traffic import _WEIGHT
from veilframe.sources.appends import append_chain_stream, append_stream, read_chain
from veilframe.sources.staging import checkpoint_dir
from veilframe.sources.tables import read_table
from veilframe.streaming import traffic
from veilframe.streaming.expiry import expiry_events, timers

_EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_EVENT = {
    "event_id": "event_id",
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "event_type": "event_type",
    "agent_id": f"concat('agent-', CAST(user_id % {AGENTS} AS STRING))",
    "entity_type": _case("event_id % 11", VAULT_TYPES),
}
_DETECTIONS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVENT.items()) + " FROM events)"
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _files(sf_dir, name):
    """A pattern that a table meets both as one file and as a folder of part files."""
    return f"{sf_dir}/{name}.parque[t]"


def _events(spark, sf_dir):
    stream = traffic.read_stream(spark, _files(sf_dir, "events"), _EVENT_SCHEMA)
    return stream.selectExpr(*[f"{expr} AS {name}" for name, expr in _EVENT.items()])


def _in_files(spark, df, files: int = 4) -> str:
    """A folder with the rows in some files, so that a stream has several batches."""
    path = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return path


def _batches(spark, df):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(_in_files(spark, df))


def run(df):
    """The rows a stream appends when it is run over all files."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    traffic.write_stream(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query(
    "str_intercept_log",
    f"""{ENTS}, sums AS (SELECT k, count(*) AS found, sum({_WEIGHT.replace('x.ent', 'ent')})::INT AS points FROM ents GROUP BY k)
SELECT {_case('doc_id % 4', SURFACES)} AS surface, 'INBOUND' AS direction, 'unknown' AS agent_id,
  substr(text, 1, 200) AS payload_preview, coalesce(found, 0) AS entities_found,
  CASE WHEN points >= 60 THEN 'BLOCKED' WHEN found > 0 THEN 'TOKENIZED' ELSE 'PASSED' END AS action_taken
FROM documents LEFT JOIN sums ON k = doc_id""",
)
def _(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = traffic.read_stream(spark, _files(sf_dir, "documents"), schema).selectExpr(
        "text AS payload", f"{_case('doc_id % 4', SURFACES)} AS surface", "CAST(NULL AS STRING) AS agent_id"
    )
    return run(traffic.intercept_log(texts))


@query(
    "str_hourly_counts",
    f"SELECT {shown_sql('hour')} AS hour, event_type, n FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n "
    f"FROM events GROUP BY ALL) WHERE hour + INTERVAL 1 HOUR <= {_CLOSED}",
)
def _(spark, sf_dir):
    out = run(traffic.hourly_counts(_events(spark, sf_dir), "event_type"))
    return out.withColumn("hour", shown("hour"))


def _windowed(length: int, slide: int, least: int) -> str:
    """Windows of ``length`` minutes that begin every ``slide`` minutes."""
    latest = f"time_bucket(INTERVAL {slide} MINUTE, timestamp)"
    return f"""SELECT {shown_sql('w')} AS window_start, {shown_sql(f'w + INTERVAL {length} MINUTE')} AS window_end, agent_id, entities, types
FROM (SELECT agent_id, w, count(*) AS entities, string_agg(DISTINCT entity_type, '; ' ORDER BY entity_type) AS types,
        count(DISTINCT entity_type) AS kinds
      FROM (SELECT *, unnest(generate_series({latest} - INTERVAL {length - slide} MINUTE, {latest}, INTERVAL {slide} MINUTE)) AS w
            FROM {_DETECTIONS}) GROUP BY agent_id, w)
WHERE kinds >= 2 AND entities >= {least} AND w + INTERVAL {length} MINUTE <= {_CLOSED}"""


def _shown(out):
    return out.select(
        shown("window_start").alias("window_start"), shown("window_end").alias("window_end"), "agent_id", "entities",
        joined("types").alias("types"),
    )


@query("str_salami_sliding", _windowed(60, 15, 2))
def _(spark, sf_dir):
    return _shown(run(traffic.salami_windows(_events(spark, sf_dir), min_entities=2)))


@query("str_salami_tumbling", _windowed(360, 360, 3))
def _(spark, sf_dir):
    return _shown(run(traffic.salami_windows(_events(spark, sf_dir), window="6 hours", slide=None)))


@query(
    "str_salami_sessions",
    f"""WITH d AS (SELECT *, lag(timestamp) OVER (PARTITION BY agent_id ORDER BY timestamp) AS before FROM {_DETECTIONS}),
g AS (SELECT *, count(*) FILTER (before IS NULL OR timestamp >= before + INTERVAL 2 HOUR) OVER (PARTITION BY agent_id ORDER BY timestamp) AS burst FROM d),
b AS (SELECT agent_id, burst, min(timestamp) AS a, max(timestamp) + INTERVAL 2 HOUR AS z, count(*) AS entities,
  string_agg(DISTINCT entity_type, '; ' ORDER BY entity_type) AS types, count(DISTINCT entity_type) AS kinds FROM g GROUP BY 1, 2)
SELECT {shown_sql('a')} AS window_start, {shown_sql('z')} AS window_end, agent_id, entities, types FROM b
WHERE kinds >= 2 AND entities >= 3 AND z <= {_CLOSED}""",
)
def _(spark, sf_dir):
    return _shown(run(traffic.salami_sessions(_events(spark, sf_dir), gap="2 hours")))


@query("str_drop_repeats", f"SELECT event_id, event_type, agent_id FROM {_DETECTIONS}")
def _(spark, sf_dir):
    events = _events(spark, sf_dir)
    doubled = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return run(traffic.drop_repeats(doubled).select("event_id", "event_type", "agent_id"))


@query("str_open_entries", f"SELECT event_id FROM {_DETECTIONS} WHERE timestamp + INTERVAL 1 DAY >= TIMESTAMP '2024-01-15'")
def _(spark, sf_dir):
    entries = _events(spark, sf_dir).select(
        "event_id", F.col("timestamp").alias("created_at"), F.lit(86_400).alias("ttl_seconds")
    )
    return run(traffic.open_entries(entries, F.to_timestamp(F.lit("2024-01-15"))).select("event_id"))


# ---------------------------------------------------------------- rules, appends, expiry

_RULES = [("pol-0", 0, "EMAIL", "REDACT"), ("pol-0", 1, "IP_ADDRESS", "LOG"), ("pol-1", 0, "PHONE", "REDACT")]


@query(
    "str_intercept_rules",
    f"""{ENTS}, sums AS (SELECT k, count(*) AS found, sum({_WEIGHT.replace('x.ent', 'ent')})::INT AS points,
  bool_or(k % 3 = 0 AND ent = 'EMAIL' OR k % 3 = 1 AND ent = 'PHONE') AS escalated FROM ents GROUP BY k)
SELECT doc_id AS id, {_case('doc_id % 4', SURFACES)} AS surface, coalesce(found, 0) AS entities_found,
  CASE WHEN points + CASE WHEN escalated THEN {POLICY_ESCALATION} ELSE 0 END >= {BLOCK_RISK} THEN 'BLOCKED' WHEN found > 0 THEN 'TOKENIZED' ELSE 'PASSED' END AS action_taken
FROM documents LEFT JOIN sums ON k = doc_id""",
)
def _(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = traffic.read_stream(spark, _files(sf_dir, "documents"), schema).selectExpr(
        "doc_id AS id", "text AS payload", f"{_case('doc_id % 4', SURFACES)} AS surface", "CAST(NULL AS STRING) AS agent_id",
        "concat('pol-', CAST(doc_id % 3 AS STRING)) AS policy_id",
    )
    rules = spark.createDataFrame(_RULES, "policy_id string, pos int, entity_type string, action string")
    return run(traffic.intercept_log(texts, rules)).select("id", "surface", "entities_found", "action_taken")


def _appended_chain(spark, sf_dir):
    folder = f"{checkpoint_dir(spark)}/chain-{uuid.uuid4().hex}"
    trail = table(spark, sf_dir, "audit").drop("seq")
    append_chain_stream(_batches(spark, trail), folder, f"{folder}-state").awaitTermination()
    return read_chain(spark, folder)


@query("str_append_chain", "SELECT true AS verified, count(*) AS total_events, 0 AS broken_links, 0 AS wrong_hashes FROM events")
def _(spark, sf_dir):
    whole = audit.verify_chain(_appended_chain(spark, sf_dir))
    return whole.select("verified", "total_events", "broken_links", "wrong_hashes")


@query(
    "str_append_chain_rows",
    f"SELECT event_id, event_type, agent_id, entities_json, {shown_sql('timestamp')} AS at FROM {sql('audit')}",
)
def _(spark, sf_dir):
    return _appended_chain(spark, sf_dir).select("event_id", "event_type", "agent_id", "entities_json", shown("timestamp").alias("at"))


def _appended(spark, sf_dir, view, name):
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    append_stream(_batches(spark, table(spark, sf_dir, view)), name, path, f"{path}-state").awaitTermination()
    return read_table(spark, name, path)


@query("str_append_logs", f"SELECT id, surface, agent_id, action_taken, {shown_sql('timestamp')} AS at FROM {sql('logs')}")
def _(spark, sf_dir):
    logs = _appended(spark, sf_dir, "logs", "interceptor_logs")
    return logs.select("id", "surface", "agent_id", "action_taken", shown("timestamp").alias("at"))


@query("str_append_threats", f"SELECT id, threat_type, severity, status, {shown_sql('timestamp')} AS at FROM {sql('threats')}")
def _(spark, sf_dir):
    found = _appended(spark, sf_dir, "threats", "threat_events")
    return found.select("id", "threat_type", "severity", "status", shown("timestamp").alias("at"))


@query(
    "str_expiry_events",
    f"SELECT 'vlt_' || event_id AS vault_ref, agent_id AS session_id, {shown_sql('ends')} AS expired_at FROM "
    f"(SELECT *, timestamp + INTERVAL 1 HOUR * (1 + event_id % 72) AS ends FROM {_DETECTIONS}) WHERE ends <= {_CLOSED}",
)
def _(spark, sf_dir):
    entries = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "concat('vlt_', CAST(event_id AS STRING)) AS vault_ref", f"{_EVENT['timestamp']} AS created_at",
        "CAST(3600 * (1 + event_id % 72) AS INT) AS ttl_seconds", f"{_EVENT['agent_id']} AS session_id",
    )
    low, high = entries.agg(F.min("created_at"), F.max("created_at")).first()
    path = f"{checkpoint_dir(spark)}/entries-{uuid.uuid4().hex}"
    cuts = [low + (high - low) * i / 3 for i in (1, 2)]
    for part in range(3):  # files in the order of time
        at = F.when(F.col("created_at") < F.lit(cuts[0]), 0).when(F.col("created_at") < F.lit(cuts[1]), 1).otherwise(2)
        entries.where(at == part).repartition(1).write.mode("append").parquet(path)
    with timers(spark):
        out = run(expiry_events(spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(path)))
    return out.select("vault_ref", "session_id", shown("expired_at").alias("expired_at"))


@query(
    "str_salami_bursts",
    f"""WITH d AS (SELECT *, lag(timestamp) OVER (PARTITION BY agent_id ORDER BY timestamp) AS before FROM {_DETECTIONS}),
g AS (SELECT *, count(*) FILTER (before IS NULL OR timestamp > before + INTERVAL 2 HOUR) OVER (PARTITION BY agent_id ORDER BY timestamp) AS burst FROM d),
b AS (SELECT agent_id, burst, min(timestamp) AS a, max(timestamp) + INTERVAL 2 HOUR AS z, count(*) AS entities,
  string_agg(DISTINCT entity_type, '; ' ORDER BY entity_type) AS types, count(DISTINCT entity_type) AS kinds FROM g GROUP BY 1, 2)
SELECT {shown_sql('a')} AS window_start, {shown_sql('z')} AS window_end, agent_id, entities, types FROM b WHERE kinds >= 2 AND entities >= 3""",
)
def _(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{expr} AS {name}" for name, expr in _EVENT.items()])
    return _shown(traffic.salami_sessions(found, gap="2 hours"))
