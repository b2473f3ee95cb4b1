"""Queries: audit trail."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.functions.constants import GENESIS_HASH
from veilframe.operators import audit
from veilframe.plans.catalog import mean_sql, query, shown, shown_sql
from veilframe.plans.derived import sql, table
from veilframe.plans.q_traffic import _FROM, _PERIOD, _TO, _counts_sql, _hours_sql
from veilframe.operators.reports import latest_hours
from veilframe.sources.appends import append_chain, verify_new
from veilframe.sources.staging import checkpoint_dir, stage

_AUDIT = sql("audit")
_ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')"


def _chain_sql(events: str, rows: int = audit.SEGMENT_ROWS, name: str = "chained") -> str:
    """Events with ``segment, prev_hash, hash``, for tables within one group of segments."""
    return f"""{name}_ev AS (SELECT *, rn // {rows} AS segment, rn % {rows} AS i FROM
  (SELECT *, {_ISO} AS iso, row_number() OVER (ORDER BY seq) - 1 AS rn FROM {events})),
{name}_blocks AS (SELECT segment, count(*) AS n, sha256(string_agg(sha256(event_id || event_type || iso), '' ORDER BY seq)) AS digest
  FROM {name}_ev GROUP BY segment),
{name}_starts AS (SELECT 0::BIGINT AS segment, '{GENESIS_HASH}' AS start
  UNION ALL SELECT s.segment + 1, sha256(start || digest) FROM {name}_starts s JOIN {name}_blocks b USING (segment)),
{name}_links AS (
  SELECT segment, i, start AS prev_hash, sha256(event_id || event_type || iso || start) AS hash FROM {name}_ev JOIN {name}_starts USING (segment) WHERE i = 0
  UNION ALL
  SELECT e.segment, e.i, c.hash, sha256(event_id || event_type || iso || c.hash)
  FROM {name}_links c JOIN {name}_ev e ON e.segment = c.segment AND e.i = c.i + 1),
{name} AS (SELECT e.* EXCLUDE (rn, i, iso), prev_hash, hash FROM {name}_ev e JOIN {name}_links USING (segment, i))"""


_CHAIN = f"WITH RECURSIVE {_chain_sql(_AUDIT)}"


def events(spark, sf_dir):
    return table(spark, sf_dir, "audit")


def chained(spark, sf_dir):
    return audit.build_chain(events(spark, sf_dir))


@query("aud_build_chain", f"{_CHAIN} SELECT seq, segment, prev_hash, hash FROM chained")
def _(spark, sf_dir):
    return chained(spark, sf_dir).select("seq", "segment", "prev_hash", "hash")


@query("aud_seal_segments", f"{_CHAIN} SELECT segment, n, digest, start FROM chained_blocks JOIN chained_starts USING (segment)")
def _(spark, sf_dir):
    return audit.seal_segments(chained(spark, sf_dir))


_SPARSE = f"(SELECT * REPLACE (seq * 5000 + seq % 7 AS seq) FROM {_AUDIT})"


@query("aud_build_sparse", f"WITH RECURSIVE {_chain_sql(_SPARSE)} SELECT seq, segment, prev_hash, hash FROM chained")
def _(spark, sf_dir):
    sparse = events(spark, sf_dir).withColumn("seq", F.expr("seq * 5000 + seq % 7"))
    return audit.build_chain(sparse).select("seq", "segment", "prev_hash", "hash")


# Two thirds are written first; the rest is chained after their seals.
_CUT = "seq < (SELECT max(event_id) * 2 // 3 FROM events)"
_APPENDED = f"""WITH RECURSIVE {_chain_sql(f"(SELECT * FROM {_AUDIT} WHERE {_CUT})", name="old")},
late_ev AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rn, {_ISO} AS iso FROM {_AUDIT} WHERE NOT ({_CUT})),
new_ev AS (SELECT *, (SELECT max(segment) + 1 FROM old_blocks) + rn // {audit.SEGMENT_ROWS} AS segment, rn % {audit.SEGMENT_ROWS} AS i FROM late_ev),
new_blocks AS (SELECT segment, sha256(string_agg(sha256(event_id || event_type || iso), '' ORDER BY seq)) AS digest FROM new_ev GROUP BY segment),
new_starts AS (SELECT segment, start FROM old_starts WHERE segment > (SELECT max(segment) FROM old_blocks)
  UNION ALL SELECT s.segment + 1, sha256(start || digest) FROM new_starts s JOIN new_blocks b USING (segment)),
new_links AS (
  SELECT segment, i, start AS prev_hash, sha256(event_id || event_type || iso || start) AS hash FROM new_ev JOIN new_starts USING (segment) WHERE i = 0
  UNION ALL SELECT e.segment, e.i, c.hash, sha256(event_id || event_type || iso || c.hash)
  FROM new_links c JOIN new_ev e ON e.segment = c.segment AND e.i = c.i + 1)"""


def appended(spark, sf_dir):
    whole = events(spark, sf_dir)
    cut = whole.agg(F.expr("max(seq) * 2 div 3")).first()[0]
    old = stage(audit.build_chain(whole.where(F.col("seq") < cut)))
    return old, audit.build_chain(whole.where(F.col("seq") >= cut), audit.seal_segments(old))


@query(
    "aud_append_chain",
    f"{_APPENDED} SELECT seq, segment, prev_hash, hash FROM old UNION ALL "
    "SELECT seq, segment, prev_hash, hash FROM new_ev JOIN new_links USING (segment, i)",
)
def _(spark, sf_dir):
    old, new = appended(spark, sf_dir)
    return old.unionByName(new).select("seq", "segment", "prev_hash", "hash")


@query("aud_verify_appended", f"SELECT true AS verified, count(*) AS total_events, 0 AS broken_links FROM {_AUDIT}")
def _(spark, sf_dir):
    old, new = appended(spark, sf_dir)
    return audit.verify(audit.check_links(stage(old.unionByName(new)))).select("verified", "total_events", "broken_links")


# Some hashes and some event types are changed after the chain was built.
_TAMPERED = (
    "SELECT * REPLACE (CASE WHEN seq % 997 = 5 THEN reverse(hash) ELSE hash END AS hash, "
    "CASE WHEN seq % 1499 = 7 THEN 'FORGED' ELSE event_type END AS event_type) FROM chained"
)


def tampered(spark, sf_dir):
    return stage(chained(spark, sf_dir)).withColumns(
        {
            "hash": F.when(F.col("seq") % 997 == 5, F.reverse("hash")).otherwise(F.col("hash")),
            "event_type": F.when(F.col("seq") % 1499 == 7, "FORGED").otherwise(F.col("event_type")),
        }
    )


def _checked_sql(bad: str) -> str:
    """``checked``: the rows of ``bad`` with ``expected, link_ok, hash_ok``."""
    return f"""{_CHAIN}, bad AS ({bad}),
found AS (SELECT segment, sha256(string_agg(sha256(event_id || event_type || {_ISO}), '' ORDER BY seq)) AS digest, min_by(prev_hash, seq) AS start
  FROM bad GROUP BY segment),
wanted AS (SELECT segment, CASE WHEN segment = 0 THEN '{GENESIS_HASH}' WHEN lag(segment) OVER w = segment - 1
  THEN sha256(lag(start) OVER w || lag(digest) OVER w) END AS start FROM found WINDOW w AS (ORDER BY segment)),
linked AS (SELECT bad.*, CASE WHEN row_number() OVER w = 1 THEN wanted.start ELSE lag(hash) OVER w END AS expected
  FROM bad JOIN wanted USING (segment) WINDOW w AS (PARTITION BY segment ORDER BY seq)),
checked AS (SELECT *, coalesce(prev_hash = expected, false) AS link_ok, sha256(event_id || event_type || {_ISO} || prev_hash) = hash AS hash_ok FROM linked)"""


_VERIFY = (
    "SELECT count(*) FILTER (NOT link_ok) = 0 AS verified, count(*) AS total_events, count(*) FILTER (NOT link_ok) AS broken_links, "
    "count(*) FILTER (NOT hash_ok) AS wrong_hashes, min_by(event_id, seq) AS first_event, max_by(event_id, seq) AS last_event FROM checked"
)


@query("aud_verify", f"{_checked_sql(_TAMPERED)} {_VERIFY}")
def _(spark, sf_dir):
    return audit.verify_chain(tampered(spark, sf_dir))


@query(
    "aud_verify_single_chain",
    f"SELECT true AS verified, count(*) AS total_events, 0 AS broken_links, 0 AS wrong_hashes, "
    f"min_by(event_id, seq) AS first_event, max_by(event_id, seq) AS last_event FROM {_AUDIT}",
)
def _(spark, sf_dir):
    return audit.verify_chain(stage(chained(spark, sf_dir)))


_GUTTED = "SELECT * FROM chained WHERE segment <> 1"


@query("aud_verify_gutted", f"{_checked_sql(_GUTTED)} {_VERIFY}")
def _(spark, sf_dir):
    return audit.verify(audit.check_links(stage(chained(spark, sf_dir)).where("segment <> 1")))


@query(
    "aud_changed_segments",
    f"{_checked_sql('SELECT * FROM chained WHERE segment NOT IN (0, (SELECT max(segment) FROM chained)) AND seq % 2003 <> 1500')}, "
    "there AS (SELECT segment, count(*) AS found, min(found.digest) AS digest, min(found.start) AS start FROM bad JOIN found USING (segment) GROUP BY 1) "
    "SELECT segment, n, coalesce(t.found, 0) AS found, CASE WHEN t.digest IS NULL THEN 'missing' ELSE 'changed' END AS state "
    "FROM chained_blocks b JOIN chained_starts s USING (segment) LEFT JOIN there t USING (segment) "
    "WHERE t.digest IS DISTINCT FROM b.digest OR t.start IS DISTINCT FROM s.start",
)
def _(spark, sf_dir):
    whole = stage(chained(spark, sf_dir))
    last = whole.agg(F.max("segment")).first()[0]
    cut = whole.where((F.col("segment") != 0) & (F.col("segment") != F.lit(last)) & (F.col("seq") % 2003 != 1500))
    return audit.changed_segments(cut, audit.seal_segments(whole))


# Without its segments the table reads as a plain chain, which every border breaks.
@query(
    "aud_verify_plain",
    f"{_CHAIN}, checked AS (SELECT *, coalesce(prev_hash = lag(hash) OVER (ORDER BY seq), true) AS link_ok, true AS hash_ok FROM chained) {_VERIFY}",
)
def _(spark, sf_dir):
    return audit.verify(audit.check_links(chained(spark, sf_dir).drop("segment"), width=256))


@query(
    "aud_broken_links",
    f"{_checked_sql(_TAMPERED)} SELECT seq, event_id, expected AS expected_prev_hash, prev_hash AS actual_prev_hash FROM checked WHERE NOT link_ok",
)
def _(spark, sf_dir):
    return audit.broken_links(audit.check_links(tampered(spark, sf_dir)))


@query(
    "aud_neighbours",
    f"{_CHAIN} SELECT seq, hash, lag(hash) OVER (ORDER BY seq) AS prev_event_hash, lead(hash) OVER (ORDER BY seq) AS next_event_hash FROM chained",
)
def _(spark, sf_dir):
    kept = stage(chained(spark, sf_dir).select("seq", "segment", "hash", "prev_hash"))
    return audit.with_neighbours(kept).select("seq", "hash", "prev_event_hash", "next_event_hash")


# A forged event beside some events, and some events gone: order and place tell other neighbours.
_FORKED = f"""{_CHAIN}, forked AS (SELECT seq, event_id, hash, prev_hash FROM chained WHERE seq % 701 <> 9
  UNION ALL SELECT seq, event_id || '-forged', md5(hash), prev_hash FROM chained WHERE seq % 499 = 3 AND seq % 701 <> 9),
starts AS (SELECT start FROM chained_starts JOIN chained_blocks USING (segment)),
linked AS (SELECT *, CASE WHEN prev_hash NOT IN (SELECT start FROM starts) THEN prev_hash END AS too FROM forked)"""


def forked(spark, sf_dir):
    """The events and the seals of the chain they were made from."""
    whole = stage(chained(spark, sf_dir))
    kept = whole.where("seq % 701 <> 9").select("seq", "event_id", "hash", "prev_hash")
    forged = kept.where("seq % 499 = 3").withColumns({"event_id": F.concat("event_id", F.lit("-forged")), "hash": F.md5("hash")})
    return stage(kept.union(forged)), stage(audit.seal_segments(whole))


@query(
    "aud_neighbours_forked",
    f"""{_FORKED} SELECT l.event_id, p.event_id AS prev_event, f.next_event, coalesce(f.n, 0) AS followers,
  l.too IS NOT NULL AND p.event_id IS NULL AS orphan
FROM linked l LEFT JOIN forked p ON p.hash = l.too
LEFT JOIN (SELECT too, min_by(event_id, (seq, event_id)) AS next_event, count(*) AS n FROM linked WHERE too IS NOT NULL GROUP BY too) f ON f.too = l.hash""",
)
def _(spark, sf_dir):
    events, seals = forked(spark, sf_dir)
    return audit.neighbours_by_hash(events, seals).select("event_id", "prev_event", "next_event", "followers", "orphan")


@query(
    "aud_forks",
    f"""{_FORKED} SELECT o.event_id, l.event_id AS follower FROM linked l JOIN forked o ON o.hash = l.too
WHERE l.too IN (SELECT too FROM linked GROUP BY too HAVING count(*) > 1)""",
)
def _(spark, sf_dir):
    return audit.forks(*forked(spark, sf_dir))


@query(
    "aud_verify_new",
    f"SELECT true AS verified, (SELECT count(*) FROM {_AUDIT} WHERE seq % 3 = 2) AS new_events, count(*) AS total_events, 0 AS broken_links, "
    f"0 AS wrong_hashes, 0 AS changed_segments FROM {_AUDIT}",
)
def _(spark, sf_dir):
    """Three appends; the last one is checked by itself."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/chain-{uuid.uuid4().hex}"
    for batch in range(3):
        append_chain(events(spark, sf_dir).where(F.col("seq") % 3 == batch).drop("seq"), path, batch)
        if batch:
            report = verify_new(spark, path)
    return report.select("verified", "new_events", "total_events", "broken_links", "wrong_hashes", "changed_segments")


def _third_page(listed, tiebreak: str, time: str = "timestamp"):
    """The third page, by the last rows of the pages before it."""
    after = None
    for _ in range(2):
        last = listed(after=after).agg(F.min(F.struct(time, tiebreak)).alias("last")).first().last
        after = tuple(last)
    return listed(after=after)


@query(
    "aud_page",
    f"SELECT seq, event_type, {shown_sql('timestamp')} AS at FROM {_AUDIT} ORDER BY timestamp DESC, seq DESC LIMIT 50 OFFSET 100",
)
def _(spark, sf_dir):
    page = _third_page(lambda after: audit.list_events(events(spark, sf_dir), after=after), "seq")
    return page.select("seq", "event_type", shown("timestamp").alias("at"))


@query(
    "aud_list",
    f"SELECT seq, event_type, agent_id, {shown_sql('timestamp')} AS at FROM {_AUDIT} WHERE policy_id = 'pol-2' AND {_PERIOD} "
    "AND seq % 5 = 1 ORDER BY timestamp DESC, seq DESC LIMIT 50 OFFSET 5",
)
def _(spark, sf_dir):
    page = audit.list_events(
        events(spark, sf_dir), policy_id="pol-2", date_from=_FROM, date_to=_TO, entity_type="EMAIL", offset=5
    )
    return page.select("seq", "event_type", "agent_id", shown("timestamp").alias("at"))


@query(
    "aud_export",
    f"SELECT seq, event_id, entities_json, {shown_sql('timestamp')} AS at FROM {_AUDIT} WHERE event_type = 'ERROR' AND {_PERIOD}",
)
def _(spark, sf_dir):
    out = audit.export_events(events(spark, sf_dir), event_type="ERROR", date_from=_FROM, date_to=_TO)
    return out.select("seq", "event_id", "entities_json", shown("timestamp").alias("at"))


@query("aud_stats", _counts_sql(_AUDIT, "event_type", "agent_id"))
def _(spark, sf_dir):
    return audit.stats(events(spark, sf_dir))


@query("aud_hours", _hours_sql(_AUDIT))
def _(spark, sf_dir):
    return latest_hours(events(spark, sf_dir), "timestamp").select(shown("hour").alias("hour"), "n")


@query(
    "aud_totals",
    f"""WITH h AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM {_AUDIT} GROUP BY 1)
SELECT total, avg_latency, unique_agents, unique_sessions, {shown_sql('peak')} AS peak_hour, {shown_sql('busy')} AS busiest_hour
FROM (SELECT count(*) AS total, {mean_sql('latency_ms', 1)} AS avg_latency, count(DISTINCT agent_id) AS unique_agents,
  count(DISTINCT session_id) AS unique_sessions FROM {_AUDIT}), (SELECT max(hour) AS peak FROM h),
  (SELECT hour AS busy FROM h ORDER BY n DESC, hour DESC LIMIT 1)""",
)
def _(spark, sf_dir):
    out = audit.totals(events(spark, sf_dir))
    return out.withColumns({"peak_hour": shown("peak_hour"), "busiest_hour": shown("busiest_hour")})


@query(
    "aud_entity_types",
    """WITH x AS (SELECT upper(event_type) AS t, event_id % 5 AS r FROM events),
named AS (SELECT t AS entity_type FROM x WHERE r IN (0, 1, 2) UNION ALL SELECT 'UNKNOWN' FROM x WHERE r = 0
  UNION ALL SELECT 'EMAIL' FROM x WHERE r = 1 UNION ALL SELECT 'PHONE' FROM x WHERE r = 2)
SELECT entity_type, count(*) AS n FROM named GROUP BY 1""",
)
def _(spark, sf_dir):
    return audit.entity_type_counts(events(spark, sf_dir))


@query("aud_agents", f"SELECT agent_id, count(*) AS event_count FROM {_AUDIT} WHERE agent_id IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return audit.agents(events(spark, sf_dir))


@query("aud_trail", f"SELECT seq, event_type, {shown_sql('timestamp')} AS at FROM {_AUDIT} WHERE session_id = 7")
def _(spark, sf_dir):
    return audit.session_trail(events(spark, sf_dir), 7).select("seq", "event_type", shown("timestamp").alias("at"))
