"""Queries: sessions, compliance, dashboard."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from veilframe.functions.constants import CATEGORIES, CONTROLS, FRAMEWORKS, REQUIRED_TYPES, VAULT_TYPES
from veilframe.operators import audit, compliance, dashboard, sessions
from veilframe.plans.catalog import joined, mean_sql, query, shown, shown_sql
from veilframe.plans.derived import sql, table
from veilframe.plans.detection_sql import quote
from veilframe.plans.q_policy import _LISTED_SQL, listed
from veilframe.plans.q_traffic import WEIGHT_SQL
from veilframe.sources.staging import checkpoint_dir, stage
from veilframe.sources.tables import append_table, read_table

_S, _E, _A, _T, _L = (sql(n) for n in ("sessions", "entities", "audit", "threats", "logs"))
_SINCE = datetime(1999, 1, 1)


def tables(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


# -- sessions


@query(
    "ses_list",
    f"SELECT id, name, {shown_sql('created_at')} AS created FROM {_S} WHERE status = 'ACTIVE' AND agent_id = 'agent-5' "
    f"AND created_at >= TIMESTAMP '{_SINCE}' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 3",
)
def _(spark, sf_dir):
    page = sessions.list_sessions(*tables(spark, sf_dir, "sessions"), "ACTIVE", "agent-5", _SINCE, limit=20, offset=3)
    return page.select("id", "name", shown("created_at").alias("created"))


@query("ses_count", f"SELECT count(*) AS total FROM {_S} WHERE status = 'ACTIVE' AND created_at >= TIMESTAMP '{_SINCE}'")
def _(spark, sf_dir):
    return sessions.count_sessions(*tables(spark, sf_dir, "sessions"), "ACTIVE", date_from=_SINCE)


@query(
    "ses_detail",
    f"""SELECT id, status, coalesce(tokenized, 0) AS tokenized, coalesce(redacted, 0) AS redacted, coalesce(masked, 0) AS masked,
  coalesce(e, 0) AS total_entities, coalesce(a, 0) AS total_audit_events FROM {_S} s
LEFT JOIN (SELECT session_id, count(*) FILTER (action = 'TOKENIZE') AS tokenized, count(*) FILTER (action = 'REDACT') AS redacted,
  count(*) FILTER (action = 'MASK') AS masked, count(*) AS e FROM {_E} GROUP BY 1) e ON e.session_id = id
LEFT JOIN (SELECT session_id, count(*) AS a FROM {_A} GROUP BY 1) a ON a.session_id = id""",
)
def _(spark, sf_dir):
    out = sessions.session_detail(*tables(spark, sf_dir, "sessions", "entities", "audit"))
    return out.select("id", "status", "tokenized", "redacted", "masked", "total_entities", "total_audit_events")


@query("ses_entities", f"SELECT id, entity_type, {shown_sql('detected_at')} AS at FROM {_E} WHERE session_id = 5")
def _(spark, sf_dir):
    rows = sessions.session_entities(*tables(spark, sf_dir, "entities"), 5)
    return rows.select("id", "entity_type", shown("detected_at").alias("at"))


@query(
    "ses_counts",
    f"SELECT session_id, count(*) AS entities_protected, count(*) AS tokens_generated FROM {_E} GROUP BY 1",
)
def _(spark, sf_dir):
    return sessions.session_counts(*tables(spark, sf_dir, "entities"))


_CREATED = "2025-03-01 12:00:00"


@query(
    "ses_create",
    f"SELECT id, name, '{_CREATED}' AS created, '2025-03-02 12:00:00' AS expires, 'ACTIVE' AS status, agent_id, "
    f"0 AS entities_protected FROM {_S} WHERE status = 'PURGED'",
)
def _(spark, sf_dir):
    asked = table(spark, sf_dir, "sessions").where("status = 'PURGED'")
    new = sessions.create_sessions(asked, F.to_timestamp(F.lit(_CREATED)))
    return new.select(
        "id", "name", shown("created_at").alias("created"), shown("expires_at").alias("expires"), "status", "agent_id",
        "entities_protected",
    )


# Requests name some sessions that do not exist and some extensions that are too long; some sessions
# are asked for several times, also with the same hours.
_EXTEND = """(SELECT o_orderkey + CASE WHEN o_custkey % 13 = 0 THEN 1000000000 ELSE 0 END AS session_id, unnest(CASE o_orderkey % 4
  WHEN 0 THEN [o_custkey % 200] WHEN 1 THEN [10, o_custkey % 200, 200] WHEN 2 THEN [5, 5, o_custkey % 200] ELSE [NULL, 24] END) AS hours
  FROM orders)"""
_IN_RANGE = "coalesce(hours BETWEEN 1 AND 168, false)"
_ADDED = f"(SELECT session_id, sum(hours)::BIGINT AS added FROM {_EXTEND} WHERE {_IN_RANGE} GROUP BY 1)"
_EXTENDED = "added IS NOT NULL AND status <> 'PURGED'"


def _extend(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey + CASE WHEN o_custkey % 13 = 0 THEN 1000000000 ELSE 0 END AS session_id",
        "explode(CASE o_orderkey % 4 WHEN 0 THEN array(CAST(o_custkey % 200 AS INT)) WHEN 1 THEN array(10, CAST(o_custkey % 200 AS INT), 200) "
        "WHEN 2 THEN array(5, 5, CAST(o_custkey % 200 AS INT)) ELSE array(NULL, 24) END) AS hours",
    )
    return sessions.extend_sessions(table(spark, sf_dir, "sessions"), asked, F.to_timestamp(F.lit(_CREATED)))


@query(
    "ses_extend",
    f"SELECT id, CASE WHEN {_EXTENDED} THEN {shown_sql('expires_at + to_hours(added)')} ELSE {shown_sql('expires_at')} END AS expires, "
    f"CASE WHEN {_EXTENDED} THEN 'ACTIVE' ELSE status END AS status FROM {_S} LEFT JOIN {_ADDED} ON session_id = id",
)
def _(spark, sf_dir):
    return _extend(spark, sf_dir)[0].select("id", shown("expires_at").alias("expires"), "status")


@query(
    "ses_extend_events",
    f"SELECT session_id, 'SESSION_EXTEND' AS event_type, agent_id, '{{\"hours_added\":' || hours || '}}' AS entities_json, true AS own_id "
    f"FROM {_S} JOIN {_EXTEND} ON session_id = id WHERE {_IN_RANGE} AND status <> 'PURGED'",
)
def _(spark, sf_dir):
    events = _extend(spark, sf_dir)[1]
    own = events.groupBy("event_id").agg(F.count("*").alias("n"))
    return events.join(own, "event_id").select("session_id", "event_type", "agent_id", "entities_json", (F.col("n") == 1).alias("own_id"))


@query(
    "ses_extend_rejected",
    f"SELECT session_id, hours, CASE WHEN id IS NULL THEN 'session not found' WHEN status = 'PURGED' THEN 'cannot extend a purged session' "
    f"ELSE 'hours must be between 1 and 168' END AS reason FROM {_EXTEND} LEFT JOIN {_S} ON session_id = id "
    f"WHERE id IS NULL OR status = 'PURGED' OR NOT {_IN_RANGE}",
)
def _(spark, sf_dir):
    return _extend(spark, sf_dir)[2]


@query(
    "ses_extend_chained",
    f"SELECT count(*) AS total_events, true AS verified, 0 AS broken_links FROM (SELECT session_id FROM {_S} JOIN {_EXTEND} ON session_id = id "
    f"WHERE {_IN_RANGE} AND status <> 'PURGED' UNION ALL SELECT event_id FROM events)",
)
def _(spark, sf_dir):
    """The events of extensions, chained after the audit trail."""
    trail = stage(audit.build_chain(table(spark, sf_dir, "audit").select("seq", "event_id", "event_type", "timestamp")))
    events = _extend(spark, sf_dir)[1].select("event_id", "event_type", "timestamp")
    new = audit.number_events(events, trail.agg(F.max("seq")).first()[0])
    whole = stage(trail.unionByName(audit.build_chain(new, audit.seal_segments(trail))))
    return audit.verify(audit.check_links(whole)).select("total_events", "verified", "broken_links")


_PURGE = "(SELECT DISTINCT o_orderkey + CASE WHEN o_custkey % 13 = 0 THEN 1000000000 ELSE 0 END AS session_id FROM orders WHERE o_orderkey % 4 = 0)"


def _purge(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 4 = 0").selectExpr(
        "o_orderkey + CASE WHEN o_custkey % 13 = 0 THEN 1000000000 ELSE 0 END AS session_id"
    )
    return sessions.purge(*tables(spark, sf_dir, "sessions", "entities"), asked, F.to_timestamp(F.lit(_CREATED)))


@query(
    "ses_purge",
    f"SELECT id, CASE WHEN session_id IS NOT NULL THEN 'PURGED' ELSE status END AS status, CASE WHEN session_id IS NOT NULL THEN 0 "
    f"ELSE entities_protected END AS entities_protected FROM {_S} LEFT JOIN {_PURGE} ON session_id = id",
)
def _(spark, sf_dir):
    return _purge(spark, sf_dir)[0].select("id", "status", "entities_protected")


@query(
    "ses_purge_entities",
    f"SELECT session_id, count(*) AS n FROM {_E} WHERE session_id NOT IN (SELECT session_id FROM {_PURGE}) GROUP BY 1",
)
def _(spark, sf_dir):
    return _purge(spark, sf_dir)[1].groupBy("session_id").agg(F.count("*").alias("n"))


@query(
    "ses_purge_events",
    f"SELECT p.session_id, 'SESSION_PURGE' AS event_type, '{{\"entities_purged\":' || (SELECT count(*) FROM {_E} e "
    f"WHERE e.session_id = p.session_id) || '}}' AS entities_json FROM {_PURGE} p JOIN {_S} ON p.session_id = id",
)
def _(spark, sf_dir):
    return _purge(spark, sf_dir)[2].select("session_id", "event_type", "entities_json")


@query("ses_purge_rejected", f"SELECT session_id, 'session not found' AS reason FROM {_PURGE} WHERE session_id NOT IN (SELECT id FROM {_S})")
def _(spark, sf_dir):
    return _purge(spark, sf_dir)[3]



# Stored tables in folders by month; the sessions of one month are erased in place.
_ERASED = "(SELECT o_orderkey AS session_id FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01')"


def _stored_purge(spark, sf_dir):
    """Paths of sessions and entities after the purge, and its events."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/purge-{uuid.uuid4().hex}"
    paths = []
    for view, name, time in (("sessions", "scan_sessions", "created_at"), ("entities", "entities_detected", "detected_at")):
        paths.append(f"{folder}/{name}")
        by_month = table(spark, sf_dir, view).withColumn(time, F.date_trunc("month", time))
        append_table(by_month.withColumn("token", F.lit(None).cast("string")) if view == "entities" else by_month, name, paths[-1])
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01'")
    events, _ = sessions.purge_stored(spark, *paths, asked.select(F.col("o_orderkey").alias("session_id")), F.to_timestamp(F.lit(_CREATED)))
    return *paths, events


_ENTITY_MONTH, _SESSION_MONTH = (shown_sql(f"date_trunc('month', {time})") for time in ("detected_at", "created_at"))


@query(
    "ses_purge_stored",
    f"SELECT id, session_id, entity_type, action, {_ENTITY_MONTH} AS at FROM {_E} WHERE session_id NOT IN {_ERASED}",
)
def _(spark, sf_dir):
    left = read_table(spark, "entities_detected", _stored_purge(spark, sf_dir)[1])
    return left.select("id", "session_id", "entity_type", "action", shown("detected_at").alias("at"))


@query(
    "ses_purge_stored_sessions",
    f"SELECT id, name, CASE WHEN id IN {_ERASED} THEN 'PURGED' ELSE status END AS status, "
    f"CASE WHEN id IN {_ERASED} THEN 0 ELSE entities_protected END AS entities_protected, {_SESSION_MONTH} AS at FROM {_S}",
)
def _(spark, sf_dir):
    left = read_table(spark, "scan_sessions", _stored_purge(spark, sf_dir)[0])
    return left.select("id", "name", "status", "entities_protected", shown("created_at").alias("at"))


@query(
    "ses_purge_stored_events",
    f"SELECT p.session_id, '{{\"entities_purged\":' || (SELECT count(*) FROM {_E} e WHERE e.session_id = p.session_id) || '}}' AS entities_json FROM {_ERASED} p",
)
def _(spark, sf_dir):
    return _stored_purge(spark, sf_dir)[2].select("session_id", "entities_json")


# -- compliance: two types are seen as a third, so that some types stay unseen

_SEEN = f"(SELECT * REPLACE (CASE WHEN entity_type IN ('DATE', 'IBAN') THEN 'PASSPORT' ELSE entity_type END AS entity_type) FROM {_E})"
_FACTS = f"""facts AS (SELECT (SELECT list(DISTINCT entity_type) FROM {_SEEN}) AS types,
  (SELECT count(*) FROM {_SEEN} WHERE action = 'TOKENIZE') AS tokenized, (SELECT count(*) FROM {_SEEN}) AS entities,
  (SELECT count(*) FROM {_A}) AS events, (SELECT count(*) FROM {_S} WHERE status = 'PURGED') AS purged)"""
_CONTROLS = "(VALUES " + ", ".join("(" + ", ".join(map(quote, c)) + ")" for c in CONTROLS) + (
    ") c(framework_code, control_id, name, old_status, evidence_type, severity)"
)
_REQUIRED = "(VALUES " + ", ".join(
    f"({quote(k)}, [{', '.join(map(quote, v))}])" for k, v in REQUIRED_TYPES.items()
) + ") r(framework_code, required)"
_FRAMES = "(VALUES " + ", ".join(f"({quote(a)}, {quote(b)}, {t}, {p})" for a, b, t, p in FRAMEWORKS) + (
    ") f(code, category, controls_total, old_passing)"
)
_ASSESSED = f"""WITH {_FACTS},
cov AS (SELECT framework_code, list_sort(list_filter(required, lambda x: list_contains(types, x))) AS covered,
  list_sort(list_filter(required, lambda x: NOT list_contains(types, x))) AS missing, required FROM {_REQUIRED}, facts),
pct AS (SELECT *, round(len(covered) / len(required) * 100, 1) AS coverage FROM cov),
named AS (SELECT DISTINCT f.code FROM {_FRAMES} JOIN {_LISTED_SQL} ON status = 'ACTIVE' AND compliance_packs ILIKE '%' || f.code || '%'),
judged AS (SELECT c.*, pct.*  EXCLUDE (framework_code), facts.*, CASE evidence_type WHEN 'ENTITY_DETECTION' THEN coverage >= 80
    WHEN 'VAULT_OPERATION' THEN tokenized > 0 WHEN 'AUDIT_TRAIL' THEN events >= 10 WHEN 'ERASURE_CAPABILITY' THEN purged > 0
    ELSE c.framework_code IN (SELECT code FROM named) END AS passed FROM {_CONTROLS} JOIN pct USING (framework_code), facts),
assessed AS (SELECT *, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN NOT passed THEN '[' || control_id || '] ' || name || ': ' ||
    CASE evidence_type WHEN 'ENTITY_DETECTION' THEN 'Entity coverage ' || coverage || '% < 80% threshold'
      WHEN 'POLICY_CONFIG' THEN 'No active policy references ' || framework_code ELSE '?' END END AS finding FROM judged),
result AS (SELECT framework_code AS code, count(*) AS controls_total, count(*) FILTER (passed) AS controls_passing FROM assessed GROUP BY 1),
frames AS (SELECT f.code, f.category, f.controls_total, r.controls_passing, CASE WHEN r.controls_passing / r.controls_total > 0.85 THEN 'COMPLIANT'
  WHEN r.controls_passing / r.controls_total > 0.65 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END AS status FROM {_FRAMES} JOIN result r USING (code))"""


def assessed(spark, sf_dir):
    entities, events, scans = tables(spark, sf_dir, "entities", "audit", "sessions")
    seen = entities.replace(["DATE", "IBAN"], "PASSPORT", ["entity_type"])
    facts = compliance.facts(seen, events, scans, listed(spark, sf_dir))
    return compliance.assess_controls(compliance.controls(spark), facts)


def frames(spark, sf_dir):
    result = compliance.assess_frameworks(assessed(spark, sf_dir))
    return compliance.apply_assessment(compliance.frameworks(spark), result)


@query("cmp_assess_controls", f"{_ASSESSED} SELECT framework_code, control_id, severity, status, finding FROM assessed")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select("framework_code", "control_id", "severity", "status", "finding")


@query(
    "cmp_assess_frameworks",
    f"""{_ASSESSED} SELECT a.framework_code AS code, any_value(frames.status) AS status, count(*) AS controls_total, count(*) FILTER (passed) AS controls_passing,
  count(*) FILTER (NOT passed) AS controls_failing, any_value(coverage) AS entity_coverage_pct, any_value(array_to_string(covered, '; ')) AS entity_types_covered,
  any_value(array_to_string(missing, '; ')) AS entity_types_missing, any_value(tokenized > 0) AS vault_active, any_value(events) AS audit_trail_count,
  coalesce(string_agg(finding, '; ' ORDER BY finding), '') AS findings FROM assessed a JOIN frames ON code = a.framework_code GROUP BY 1""",
)
def _(spark, sf_dir):
    out = compliance.assess_frameworks(assessed(spark, sf_dir))
    texts = ("entity_types_covered", "entity_types_missing", "findings")
    return out.withColumns({c: joined(c) for c in texts})


@query("cmp_frameworks", f"{_ASSESSED} SELECT * FROM frames WHERE category = 'Privacy'")
def _(spark, sf_dir):
    return compliance.list_frameworks(frames(spark, sf_dir), "Privacy")


@query(
    "cmp_summary",
    f"{_ASSESSED} SELECT round(sum(controls_passing) / sum(controls_total) * 100, 1) AS overall_score, count(*) AS frameworks_total, "
    "count(*) FILTER (status = 'COMPLIANT') AS compliant, count(*) FILTER (status = 'PARTIAL') AS partial, "
    "count(*) FILTER (status = 'NON_COMPLIANT') AS non_compliant, sum(controls_total)::BIGINT AS controls_total, "
    "sum(controls_passing)::BIGINT AS controls_passing FROM frames",
)
def _(spark, sf_dir):
    return compliance.summary(frames(spark, sf_dir))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 END"


@query(
    "cmp_gaps",
    f"{_ASSESSED} SELECT framework_code, control_id, name, severity, 'see ' || control_id AS remediation_hint FROM assessed WHERE status = 'FAIL' "
    f"ORDER BY {_RANK} NULLS FIRST, control_id LIMIT 10",
)
def _(spark, sf_dir):
    hinted = assessed(spark, sf_dir).withColumn("remediation_hint", F.concat(F.lit("see "), "control_id"))
    return compliance.gaps(hinted, 10)


@query(
    "cmp_report",
    f"{_ASSESSED} SELECT framework_code AS code, CASE WHEN grouping(framework_code) = 0 THEN 'framework' ELSE 'total' END AS level, "
    "count(*) AS controls, count(*) FILTER (passed) AS passing, "
    "count(*) FILTER (NOT passed) AS failing, round(count(*) FILTER (passed) / count(*) * 100, 1) AS score, "
    "CASE WHEN grouping(framework_code) = 0 THEN string_agg(control_id || '=' || status, '; ' ORDER BY control_id) END AS control_rows "
    "FROM assessed GROUP BY ROLLUP (framework_code)",
)
def _(spark, sf_dir):
    out = compliance.report(frames(spark, sf_dir), assessed(spark, sf_dir))
    return out.withColumn("control_rows", joined(F.transform("control_rows", lambda c: F.concat(c["control_id"], F.lit("="), c["status"]))))


@query(
    "cmp_framework_detail",
    f"{_ASSESSED} SELECT code, frames.status AS framework_status, control_id, assessed.status AS status FROM assessed "
    "JOIN frames ON code = framework_code WHERE code = 'HIPAA'",
)
def _(spark, sf_dir):
    out = compliance.framework_detail(frames(spark, sf_dir), assessed(spark, sf_dir), "HIPAA")
    return out.select("code", "framework_status", "control_id", "status")


# -- dashboard

_CATEGORY = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in CATEGORIES.items()) + " ELSE 'CUSTOM' END"


@query(
    "dsh_stats",
    f"""SELECT * FROM (SELECT count(*) AS total_scans, sum(entities_protected)::BIGINT AS entities_protected,
  count(*) FILTER (status = 'ACTIVE') AS active_sessions, count(*) FILTER (status = 'EXPIRED') AS expired_sessions FROM {_S}),
(SELECT count(*) FILTER (status = 'BLOCKED') AS threats_blocked, count(*) FILTER (status = 'FLAGGED') AS threats_flagged,
  {mean_sql(WEIGHT_SQL, 2)} AS risk_score FROM {_T}),
(SELECT {mean_sql('latency_ms', 1)} AS avg_latency_ms FROM {_A}),
(SELECT round(sum(old_passing) / sum(controls_total) * 100, 1) AS compliance_score FROM {_FRAMES}),
(SELECT count(*) FILTER (e.action = 'TOKENIZE' AND s.status = 'ACTIVE') AS vault_utilization,
  round(count(*) FILTER (confidence > 0.9) / count(*) * 100, 1) AS detection_accuracy FROM {_E} e LEFT JOIN {_S} s ON s.id = e.session_id)""",
)
def _(spark, sf_dir):
    names = ("sessions", "entities", "threats", "audit")
    return dashboard.stats(*tables(spark, sf_dir, *names), compliance.frameworks(spark))


@query(
    "dsh_timeline",
    f"SELECT {shown_sql('hour')} AS hour, * EXCLUDE (hour) FROM (SELECT date_trunc('hour', detected_at) AS hour, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (c = '{n}') AS {n}" for n in ("PII", "PHI", "PCI", "FINANCIAL", "IP_CODE", "CUSTOM"))
    + f" FROM (SELECT *, {_CATEGORY} AS c FROM {_E}) GROUP BY 1 ORDER BY 1 DESC LIMIT 24)",
)
def _(spark, sf_dir):
    return dashboard.timeline(*tables(spark, sf_dir, "entities")).withColumn("hour", shown("hour"))


@query(
    "dsh_distribution",
    f"SELECT category, entity_type, CASE WHEN grouping(entity_type) = 0 THEN 'type' ELSE 'category' END AS level, count(*) AS n "
    f"FROM (SELECT entity_type, {_CATEGORY} AS category FROM (SELECT CASE WHEN id % 9 <> 0 THEN entity_type END AS entity_type FROM {_E})) "
    "GROUP BY GROUPING SETS ((category), (category, entity_type))",
)
def _(spark, sf_dir):
    (entities,) = tables(spark, sf_dir, "entities")
    return dashboard.distribution(entities.withColumn("entity_type", F.when(F.col("id") % 9 != 0, F.col("entity_type"))))


@query(
    "dsh_recent_threats",
    f"SELECT id, threat_type, severity, agent_id, description, status, {shown_sql('timestamp')} AS at FROM {_T} "
    "ORDER BY timestamp DESC, id DESC LIMIT 20",
)
def _(spark, sf_dir):
    recent = dashboard.recent_threats(*tables(spark, sf_dir, "threats"))
    return recent.withColumn("at", shown("timestamp")).drop("timestamp")


_AT = "2024-01-20 10:30:00"


@query(
    "dsh_threat_summary",
    f"""SELECT *, CASE WHEN last_24h > previous_24h THEN 'increasing' WHEN last_24h < previous_24h THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))},
  count(*) FILTER (timestamp >= TIMESTAMP '{_AT}' - INTERVAL 1 DAY) AS last_24h,
  count(*) FILTER (timestamp >= TIMESTAMP '{_AT}' - INTERVAL 2 DAY AND timestamp < TIMESTAMP '{_AT}' - INTERVAL 1 DAY) AS previous_24h FROM {_T})""",
)
def _(spark, sf_dir):
    return dashboard.threat_summary(*tables(spark, sf_dir, "threats"), F.to_timestamp(F.lit(_AT)))


@query(
    "dsh_agent_activity",
    f"""SELECT agent_id, coalesce(s, 0) AS scan_count, coalesce(e, 0)::BIGINT AS entities_detected, coalesce(t, 0) AS threats_triggered FROM
(SELECT agent_id, count(*) AS s, sum(entities_protected) AS e FROM {_S} WHERE agent_id IS NOT NULL GROUP BY 1)
FULL JOIN (SELECT agent_id, count(*) AS t FROM {_T} WHERE agent_id IS NOT NULL GROUP BY 1) USING (agent_id)""",
)
def _(spark, sf_dir):
    return dashboard.agent_activity(*tables(spark, sf_dir, "sessions", "threats"))


@query(
    "dsh_top_entities",
    f"SELECT *, {_CATEGORY} AS category FROM (SELECT entity_type, count(*) AS n, {mean_sql('confidence', 3)} AS avg_confidence FROM {_E} "
    "GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 10)",
)
def _(spark, sf_dir):
    return dashboard.top_entities(*tables(spark, sf_dir, "entities"))


@query(
    "dsh_surface_activity",
    f"SELECT surface, count(*) AS total_intercepts, count(*) FILTER (action_taken = 'BLOCKED') AS blocked, "
    "count(*) FILTER (action_taken = 'TOKENIZED') AS tokenized, count(*) FILTER (action_taken = 'LOGGED') AS logged, "
    f"sum(entities_found)::BIGINT AS total_entities, {mean_sql('latency_ms', 1)} AS avg_latency_ms FROM {_L} GROUP BY 1",
)
def _(spark, sf_dir):
    return dashboard.surface_activity(*tables(spark, sf_dir, "logs"))


_CELLS = f"""(SELECT agent_id, entity_type, n, {{mean}} AS avg_confidence,
  least(((100 * n - s) * 100 + 1000 * coalesce(weight, 0) + 50) // 100, 1000)::DOUBLE / 100 AS risk_score
FROM (SELECT s.agent_id, e.entity_type, count(*) AS n, sum(round(confidence * 100))::BIGINT AS s
  FROM {_E} e JOIN {_S} s ON s.id = e.session_id WHERE s.agent_id IS NOT NULL GROUP BY 1, 2)
LEFT JOIN (SELECT agent_id, sum({WEIGHT_SQL})::BIGINT AS weight FROM {_T} WHERE agent_id IS NOT NULL GROUP BY 1) USING (agent_id))""".format(
    mean="((2 * s * 1000 + n * 100) // (2 * n * 100))::DOUBLE / 1000"
)


@query("dsh_heatmap", f"SELECT * FROM {_CELLS}")
def _(spark, sf_dir):
    return dashboard.risk_heatmap(*tables(spark, sf_dir, "sessions", "entities", "threats"))


@query(
    "dsh_heatmap_axes",
    f"SELECT DISTINCT 'agent' AS axis, agent_id AS value FROM {_CELLS} UNION ALL SELECT DISTINCT 'entity_type', entity_type FROM {_CELLS}",
)
def _(spark, sf_dir):
    cells = stage(dashboard.risk_heatmap(*tables(spark, sf_dir, "sessions", "entities", "threats")))
    return dashboard.heatmap_axes(cells)
