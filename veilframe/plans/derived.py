"""The ten tables as views of the test tables, for Spark and for the SQL check.

``orders`` stand for scan sessions and policies, ``lineitem`` for entities and
policy rules, ``events`` for audit events, interceptor logs and threat events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.constants import VAULT_TYPES
from veilframe.sources.staging import spread

AGENTS = 97
ROLES = ("data-processor", "auditor", "admin", "analyst", "read-only")
SURFACES = ("MCP", "A2A", "LLM_API", "RAG")

# The expressions below are valid in Spark SQL and in DuckDB alike.
_TYPES = "CASE {n} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VAULT_TYPES)) + " END"


def _case(n: str, values) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _agent(column: str) -> str:
    return f"CASE WHEN {column} % 50 <> 0 THEN concat('agent-', CAST({column} % {AGENTS} AS STRING)) END"


TABLES = {
    "sessions": (
        "orders",
        {
            "id": "o_orderkey",
            "name": "concat('scan-', CAST(o_orderkey AS STRING))",
            "created_at": "CAST(o_orderdate AS TIMESTAMP)",
            "expires_at": "CAST(o_orderdate AS TIMESTAMP) + INTERVAL '24' HOUR",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'EXPIRED' ELSE 'PURGED' END",
            "agent_id": _agent("o_custkey"),
            "policy_id": "concat('pol-', substring(o_orderpriority, 1, 1))",
            "entities_protected": "CAST(floor(o_totalprice / 1000) AS BIGINT)",
            "tokens_generated": "CAST(floor(o_totalprice / 2000) AS BIGINT)",
        },
    ),
    "entities": (
        "lineitem",
        {
            "id": "l_partkey * 100 + l_suppkey",
            "session_id": "l_orderkey",
            "entity_type": _TYPES.format(n="l_partkey % 11"),
            "original_text": "concat('value-', CAST(l_partkey AS STRING))",
            "confidence": "0.7 + l_discount * 3",
            "action": "CASE l_returnflag WHEN 'R' THEN 'REDACT' WHEN 'A' THEN 'TOKENIZE' ELSE 'MASK' END",
            "detected_at": "CAST(l_shipdate AS TIMESTAMP)",
        },
    ),
    "rules": (
        "lineitem",
        {
            "policy_id": "concat('pol-', CAST(l_orderkey AS STRING))",
            "pos": "(l_partkey * 10 + l_linenumber) * 100000 + l_suppkey",
            "entity_type": _TYPES.format(n="l_partkey % 11"),
            "action": _case("l_suppkey % 4", ("REDACT", "TOKENIZE", "MASK", "PASS")),
            "role": "CASE WHEN l_partkey % 3 <> 0 THEN " + _case("l_partkey % 5", ROLES) + " END",
            "classification": "CASE WHEN l_partkey % 2 = 0 THEN 'INTERNAL' END",
        },
    ),
    "audit": (
        "events",
        {
            "seq": "event_id",
            "event_id": "concat('evt_', lpad(CAST(event_id AS STRING), 10, '0'))",
            "event_type": "upper(event_type)",
            "session_id": "CASE WHEN event_id % 11 <> 0 THEN user_id % 37 END",
            "agent_id": _agent("user_id"),
            "agent_role": _case("user_id % 5", ROLES),
            "policy_id": "concat('pol-', CAST(user_id % 5 + 1 AS STRING))",
            "latency_ms": "value",
            "timestamp": "CAST(ts AS TIMESTAMP)",
            "entities_json": "CASE event_id % 5 "
            "WHEN 0 THEN concat('[{{\"type\": \"', upper(event_type), '\", \"action\": \"REDACT\"}}, {{\"action\": \"MASK\"}}]') "
            "WHEN 1 THEN concat('[\"', upper(event_type), '\", \"EMAIL\"]') "
            "WHEN 2 THEN concat('\"', upper(event_type), ', PHONE,\"') "
            "WHEN 3 THEN props "
            "ELSE concat('[\"', event_type) END".replace("{{", "{").replace("}}", "}"),
        },
    ),
    "logs": (
        "events",
        {
            "id": "event_id",
            "surface": _case("event_id % 4", SURFACES),
            "direction": "CASE WHEN event_id % 2 = 0 THEN 'INBOUND' ELSE 'OUTBOUND' END",
            "agent_id": _agent("user_id"),
            "payload_preview": "props",
            "entities_found": "CAST(user_id % 6 AS INT)",
            "action_taken": _case("event_id % 5", ("BLOCKED", "TOKENIZED", "LOGGED", "PASSED", "REDACTED")),
            "latency_ms": "value",
            "timestamp": "CAST(ts AS TIMESTAMP)",
        },
    ),
    "threats": (
        "events",
        {
            "id": "event_id",
            "threat_type": "CASE event_type WHEN 'error' THEN 'PROMPT_INJECTION' WHEN 'click' THEN 'UNCONTROLLED_RAG' "
            "WHEN 'view' THEN 'SALAMI_SLICING' WHEN 'signup' THEN 'PRIVILEGE_ESCALATION' ELSE 'OVERBROAD_API' END",
            "severity": "CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' "
            "WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END",
            "agent_id": _agent("user_id"),
            "description": "concat('seen in ', event_type)",
            "detection_signal": "props",
            "response_action": "'Log for review'",
            "status": _case("event_id % 4", ("BLOCKED", "BLOCKED", "FLAGGED", "RESOLVED")),
            "timestamp": "CAST(ts AS TIMESTAMP)",
        },
    ),
    "traffic": (
        "conversations",
        {
            "id": "conv_id * 1000 + turn",
            "session_id": "conv_id",
            "agent_id": "concat('agent-', CAST(conv_id % 8 AS STRING))",
            "agent_role": "CASE role WHEN 'user' THEN 'analyst' WHEN 'system' THEN 'admin' ELSE 'Viewer' END",
            "payload": "text",
        },
    ),
    "payloads": (
        "documents",
        {
            "doc_id": "doc_id",
            "session_id": "concat('vs_', source)",
            "doc_seq": "doc_id",
            "source": "source",
            "surface": _case("doc_id % 4", SURFACES),
            "agent_id": "concat('agent-', CAST(doc_id % 8 AS STRING))",
            "agent_role": _case("doc_id % 5", ROLES),
            "policy_id": "concat('pol-', CAST(doc_id % 7 AS STRING))",
            "text": "text",
        },
    ),
    "vault_sessions": (
        "(SELECT DISTINCT source FROM documents)",
        {
            "session_id": "concat('vs_', source)",
            "agent_id": "concat('agent-', source)",
            "policy_id": "'default'",
            "created_at": "CAST('2025-01-01 00:00:00' AS TIMESTAMP)",
            "ttl_seconds": "CAST(CAST(substring(source, 4) AS INT) * 600 AS INT)",
        },
    ),
}
NOW = "2025-01-01 02:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``TABLES`` over the parquet files in ``sf_dir``."""
    source, columns = TABLES[name]
    if source.startswith("("):
        base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    else:
        base = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if source in ("documents", "conversations", "pages"):
        base = spread(base)
    return base.selectExpr(*[f"{expr} AS {alias}" for alias, expr in columns.items()])


def sql(name: str) -> str:
    """The same table as a SQL subquery."""
    source, columns = TABLES[name]
    return "(SELECT " + ", ".join(f"{expr} AS {alias}" for alias, expr in columns.items()) + f" FROM {source})"


def now():
    return F.to_timestamp(F.lit(NOW))
