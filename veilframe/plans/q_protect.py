"""Queries: protection, vault, restore."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.functions import masking
from veilframe.functions.constants import (
    PSEUDONYM_NUMBERS,
    PSEUDONYM_POOLS,
    SYNTHETIC_DOMAINS,
    SYNTHETIC_FIRST_NAMES,
    SYNTHETIC_LAST_NAMES,
    VAULT_TYPES,
)
from veilframe.operators import detect, protect
from veilframe.plans.catalog import query, shown_map
from veilframe.plans.derived import NOW, now, sql, table
from veilframe.plans.detection_sql import entities_cte, quote, spliced
from veilframe.plans.q_detect import ENTS, SAMPLED, detected, payloads, sampled
from veilframe.sources.rewrite import erase_rows
from veilframe.sources.staging import checkpoint_dir, stage

_SESSIONS = sql("vault_sessions")
_DOCS = sql("payloads")
_SID = "concat('vs_', source)"
_JOIN = "JOIN documents d ON d.doc_id = x.k"


def _modulo(m: int) -> str:
    words = "list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 8 + 1, 8))::HUGEINT)"
    return f"list_reduce(list_prepend(0::HUGEINT, {words}), lambda a, w: (a * 4294967296 + w) % {m})"


def _pseudonym_sql() -> str:
    pools = " ".join(
        f"WHEN {quote(t)} THEN ([{', '.join(map(quote, pool))}])[({_modulo(len(pool))})::BIGINT + 1]"
        for t, pool in PSEUDONYM_POOLS.items()
    )
    number = f"lpad(({_modulo(PSEUDONYM_NUMBERS)})::VARCHAR, 4, '0')"
    return (
        f"(SELECT CASE x.ent {pools} ELSE concat('[PSEUDO_', x.ent, '_', {number}, ']') END "
        f"FROM (SELECT sha256(concat_ws(':', {_SID}, x.ent, x.txt)) AS h))"
    )


def _pick_sql(words, number: str) -> str:
    return f"([{', '.join(map(quote, words))}])[{number} + 1]"


def _synthetic_sql(seed: str, place: str) -> str:
    def draw(n: int, low: int, high: int) -> str:
        return f"((SELECT ({_modulo(high - low + 1)})::BIGINT FROM (SELECT sha256(concat_ws(':', {seed}, {place}, '{n}')) AS h)) + {low})"

    def form(*parts) -> str:
        return " || ".join(quote(p) if isinstance(p, str) else draw(*p) for p in parts)

    forms = {
        "PERSON_NAME": _pick_sql(SYNTHETIC_FIRST_NAMES, draw(1, 0, len(SYNTHETIC_FIRST_NAMES) - 1))
        + " || ' ' || "
        + _pick_sql(SYNTHETIC_LAST_NAMES, draw(2, 0, len(SYNTHETIC_LAST_NAMES) - 1)),
        "EMAIL": form("user", (1, 1000, 9999), "@") + " || " + _pick_sql(SYNTHETIC_DOMAINS, draw(2, 0, len(SYNTHETIC_DOMAINS) - 1)),
        "PHONE": form("(", (1, 200, 999), ") ", (2, 100, 999), "-", (3, 1000, 9999)),
        "SSN": form((1, 100, 999), "-", (2, 10, 99), "-", (3, 1000, 9999)),
        "CREDIT_CARD": form((1, 4000, 4999), "-", (2, 1000, 9999), "-", (3, 1000, 9999), "-", (4, 1000, 9999)),
        "IP_ADDRESS": form((1, 10, 192), ".", (2, 0, 255), ".", (3, 0, 255), ".", (4, 1, 254)),
        "IBAN": form("XX", (1, 10, 99), "BANK", (2, 10_000_000, 99_999_999)),
        "API_KEY": f"'sk-fake-' || substr(sha256(concat_ws(':', {seed}, {place})), 1, 16)",
        "DATE": f"'2025-' || lpad({draw(1, 1, 12)}::VARCHAR, 2, '0') || '-' || lpad({draw(2, 1, 28)}::VARCHAR, 2, '0')",
        "PASSPORT": form("X", (1, 10_000_000, 99_999_999)),
        "DRIVERS_LICENSE": form("D", (1, 1000, 9999), " ", (2, 1000, 9999), " ", (3, 10_000, 99_999)),
    }
    return "CASE x.ent " + " ".join(f"WHEN {quote(t)} THEN {f}" for t, f in forms.items()) + " ELSE '[SYNTH_' || x.ent || ']' END"


_GENERALIZED = (
    "CASE x.ent WHEN 'DRIVERS_LICENSE' THEN '[DRIVERS_LICENSE_GENERALIZED]' WHEN 'SSN' THEN '[SSN_GENERALIZED]' "
    "WHEN 'PHONE' THEN '(***) ***-' || right(x.txt, 4) WHEN 'EMAIL' THEN '***@' || split_part(x.txt, '@', 2) "
    "WHEN 'IP_ADDRESS' THEN split_part(x.txt, '.', 1) || '.' || split_part(x.txt, '.', 2) || '.0.0/16' "
    "WHEN 'IBAN' THEN left(x.txt, 4) || '****' || right(x.txt, 4) WHEN 'API_KEY' THEN left(x.txt, 4) || '...' "
    "WHEN 'PERSON_NAME' THEN '[PERSON]' WHEN 'CREDIT_CARD' THEN '****-****-****-' || right(x.txt, 4) "
    "WHEN 'DATE' THEN CASE WHEN contains(x.txt, '-') THEN split_part(x.txt, '-', 1) || '/' || split_part(x.txt, '-', 2) || ' (month)' "
    "WHEN contains(x.txt, '/') THEN split_part(x.txt, '/', 1) || '/' || split_part(x.txt, '/', 1) || ' (month)' ELSE '[DATE_RANGE]' END "
    "ELSE '[' || x.ent || '_GENERALIZED]' END"
)
_ENCODED = (
    f"'ENC:' || replace(replace(replace(to_base64(encode({_SID} || ':' || x.txt)), '=', ''), '+', '-'), '/', '_')"
)
_TOKEN_JOIN = """JOIN (SELECT k, s, row_number() OVER (PARTITION BY source, ent ORDER BY k, s DESC) AS number
  FROM ents JOIN documents ON doc_id = k) n ON n.k = x.k AND n.s = x.s"""
_SQL = {
    "REDACT": ("'[REDACTED]'", ""),
    "PSEUDONYMIZE": (_pseudonym_sql(), _JOIN),
    "GENERALIZE": (_GENERALIZED, ""),
    "ENCRYPT": (_ENCODED, _JOIN),
    "SYNTHESIZE": (_synthetic_sql("'0:' || x.k", "x.s"), ""),
    "TOKENIZE": ("'<<' || x.ent || '_' || n.number || '>>'", _TOKEN_JOIN),
}


def _ref_sql(mode: str) -> str:
    return f"'vlt_' || substr(sha256(concat_ws('|', {_SID}, doc_id::VARCHAR, '{mode}')), 1, 32)"


def _entries_sql(mode: str) -> str:
    """``doc_id, session_id, vault_ref, t, sanitized, pairs, n, mode``"""
    replacement, joins = _SQL[mode]
    return (
        f"(SELECT doc_id, {_SID} AS session_id, {_ref_sql(mode)} AS vault_ref, t, sanitized, pairs, n, '{mode}' AS mode "
        f"FROM ({spliced(replacement, ENTS, joins)}) JOIN documents ON doc_id = k)"
    )


def entries(spark, sf_dir, mode: str):
    """Vault entries of all documents."""
    if mode != "TOKENIZE":
        return protect.protect(detected(spark, sf_dir), mode)
    found = stage(detected(spark, sf_dir).select("doc_id", "session_id", "doc_seq", "entities"))
    return protect.tokenize(payloads(spark, sf_dir), found)


def sessions(spark, sf_dir):
    return table(spark, sf_dir, "vault_sessions")


def _flat(df):
    return df.select("doc_id", "session_id", "vault_ref", "sanitized_text", shown_map("mappings").alias("mappings"), "mode")


for _mode in _SQL:

    @query(
        f"vlt_{_mode.lower()}",
        "SELECT doc_id, session_id, vault_ref, sanitized AS sanitized_text, pairs AS mappings, mode "
        f"FROM {_entries_sql(_mode)}",
    )
    def _(spark, sf_dir, mode=_mode):
        return _flat(entries(spark, sf_dir, mode))


# A value of each vault type, in the form it usually has.
_VALUE = (
    "CASE entity_type WHEN 'SSN' THEN concat('512-44-', right(CAST(10000 + id % 10000 AS STRING), 4)) "
    "WHEN 'EMAIL' THEN concat('user', CAST(id % 100 AS STRING), '@harbor.example') WHEN 'PHONE' THEN concat('312-555-', right(CAST(10000 + id % 10000 AS STRING), 4)) "
    "WHEN 'CREDIT_CARD' THEN concat('4539 1488 0343 ', right(CAST(10000 + id % 10000 AS STRING), 4)) "
    "WHEN 'IP_ADDRESS' THEN concat('10.', CAST(id % 200 AS STRING), '.7.1') WHEN 'PERSON_NAME' THEN concat('Person ', CAST(id % 50 AS STRING)) "
    "WHEN 'IBAN' THEN concat('GB29NWBK', CAST(100000 + id % 1000 AS STRING)) WHEN 'API_KEY' THEN concat('sk-', CAST(id AS STRING), 'abcd') "
    "WHEN 'DATE' THEN CASE id % 3 WHEN 0 THEN concat('2024-0', CAST(id % 9 + 1 AS STRING), '-11') WHEN 1 THEN '07/23/1968' ELSE 'in May' END "
    "ELSE concat('value-', CAST(id AS STRING)) END"
)


@query(
    "vlt_values_by_type",
    f"""SELECT k AS id, ent AS entity_type, {_pseudonym_sql().replace(_SID, "'vs_' || k % 5")} AS pseudonym, {_GENERALIZED} AS generalized,
  {_synthetic_sql("'7:' || x.k", "x.s")} AS synthetic
FROM (SELECT id AS k, session_id AS s, entity_type AS ent, {_VALUE} AS txt FROM {sql('entities')}) x""",
)
def _(spark, sf_dir):
    x = table(spark, sf_dir, "entities").withColumn("value", F.expr(_VALUE))
    kind, value = F.col("entity_type"), F.col("value")
    session = F.concat(F.lit("vs_"), (F.col("id") % 5).cast("string"))
    seed = F.concat(F.lit("7:"), F.col("id").cast("string"))
    return x.select(
        "id",
        "entity_type",
        masking.pseudonym(session, kind, value).alias("pseudonym"),
        masking.generalize(kind, value).alias("generalized"),
        masking.synthesize(kind, seed, F.col("session_id")).alias("synthetic"),
    )


@query(
    "vlt_token_numbers",
    f"{ENTS} SELECT k AS doc_id, ent AS entity_type, s AS start, '<<' || ent || '_' || row_number() OVER "
    "(PARTITION BY source, ent ORDER BY k, s DESC) || '>>' AS token FROM ents JOIN documents ON doc_id = k",
)
def _(spark, sf_dir):
    found = stage(detected(spark, sf_dir).select("doc_id", "session_id", "doc_seq", "entities"))
    return protect.number_tokens(found, width=64).select("doc_id", "entity_type", "start", "token")


@query(
    "vlt_mask_labels",
    f"SELECT k AS doc_id, sanitized FROM ({spliced(chr(39) + '[' + chr(39) + ' || x.ent || ' + chr(39) + ']' + chr(39), ENTS)})",
)
def _(spark, sf_dir):
    return protect.mask_labels(detected(spark, sf_dir)).select("doc_id", "sanitized")


@query("vlt_decode", f"{ENTS} SELECT k AS doc_id, s AS start, txt AS decoded FROM ents")
def _(spark, sf_dir):
    found = detected(spark, sf_dir).select("doc_id", "session_id", F.inline("entities"))
    coded = found.select("doc_id", "start", masking.encode(F.col("session_id"), F.col("original_text")).alias("coded"))
    return coded.select("doc_id", "start", masking.decode(F.col("coded")).alias("decoded"))


_EXPIRED = f"TIMESTAMP '{NOW}' > created_at + to_seconds(ttl_seconds)"
_OPEN = f"(SELECT t.* FROM {SAMPLED} t JOIN {_SESSIONS} s ON s.session_id = {_SID} WHERE NOT ({_EXPIRED}))"
_PROTECTED = spliced("'<<' || x.ent || '_' || n.number || '>>'", entities_cte(_OPEN, "doc_id", "text"), _TOKEN_JOIN)


def _protected(spark, sf_dir, mode="TOKENIZE"):
    """Documents with samples, of which those in expired sessions are rejected."""
    return protect.protect_texts(sampled(spark, sf_dir), sessions(spark, sf_dir), now(), mode)


@query(
    "vlt_protect_texts",
    f"SELECT k AS doc_id, {_SID} AS session_id, {_ref_sql('TOKENIZE')} AS vault_ref, sanitized AS sanitized_text, pairs AS mappings, 'TOKENIZE' AS mode "
    f"FROM ({_PROTECTED}) JOIN documents ON doc_id = k",
)
def _(spark, sf_dir):
    return _flat(_protected(spark, sf_dir).entries)


@query(
    "vlt_protect_synthetic",
    f"SELECT k AS doc_id, {_SID} AS session_id, sanitized AS sanitized_text FROM "
    f"({spliced(_synthetic_sql(chr(39) + '0:' + chr(39) + ' || x.k', 'x.s'), entities_cte(_OPEN, 'doc_id', 'text'))}) JOIN documents ON doc_id = k",
)
def _(spark, sf_dir):
    return _protected(spark, sf_dir, "synthesize").entries.select("doc_id", "session_id", "sanitized_text")


@query(
    "vlt_protect_entities",
    f"{entities_cte(_OPEN, 'doc_id', 'text')} SELECT k AS doc_id, {_SID} AS session_id, s AS start, ent AS entity_type, txt AS original_text, "
    "conf AS confidence, '<<' || ent || '_' || row_number() OVER (PARTITION BY source, ent ORDER BY k, s DESC) || '>>' AS token, 'TOKENIZE' AS action, "
    "true AS own_id FROM ents JOIN documents ON doc_id = k",
)
def _(spark, sf_dir):
    rows = stage(_protected(spark, sf_dir).entities)
    own = rows.groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(own, "id").select(
        "doc_id", "session_id", "start", "entity_type", "original_text", "confidence", "token", "action", (F.col("n") == 1).alias("own_id")
    )


@query(
    "vlt_protect_counts",
    f"{entities_cte(_OPEN, 'doc_id', 'text')}, n AS (SELECT k, count(*) AS n FROM ents GROUP BY k) SELECT s.session_id, s.agent_id, s.policy_id, "
    f"count(*) AS texts, coalesce(sum(n), 0)::BIGINT AS entities_protected FROM {_OPEN} o LEFT JOIN n ON k = doc_id "
    f"JOIN {_SESSIONS} s ON s.session_id = {_SID} GROUP BY ALL",
)
def _(spark, sf_dir):
    return _protected(spark, sf_dir).counts


@query(
    "vlt_protect_rejected",
    f"SELECT doc_id, s.session_id, 'session has expired' AS reason FROM {_DOCS} JOIN {_SESSIONS} s USING (session_id) WHERE {_EXPIRED}",
)
def _(spark, sf_dir):
    return _protected(spark, sf_dir, "REDACT").rejected.select("doc_id", "session_id", "reason")


@query(
    "vlt_tokenize_simple",
    "SELECT k AS doc_id, 'vs_' || substr(sha256(k::VARCHAR), 1, 32) AS session_id, sanitized AS sanitized_text, pairs AS mappings FROM ("
    + spliced(
        "'<<' || x.ent || '_' || (SELECT count(*) FROM ents y WHERE y.k = x.k AND y.ent = x.ent AND y.s >= x.s) || '>>'", entities_cte(SAMPLED)
    )
    + ")",
)
def _(spark, sf_dir):
    simple = protect.tokenize_simple(detect.detect_entities(sampled(spark, sf_dir)))
    return simple.select("doc_id", "session_id", "sanitized_text", shown_map("mappings").alias("mappings"))


@query(
    "vlt_create_sessions",
    f"SELECT 'vs_' || substr(sha256('session|' || o_orderkey || '|{NOW}'), 1, 32) AS session_id, o_clerk AS agent_id, o_orderpriority AS policy_id, "
    f"CASE WHEN o_orderkey % 3 = 0 THEN 1800 ELSE (o_orderkey % 7200)::INT END AS ttl_seconds FROM "
    "(SELECT o_orderkey, 'agent-' || o_custkey AS o_clerk, o_orderpriority FROM orders)",
)
def _(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey AS request_id", "concat('agent-', o_custkey) AS agent_id", "o_orderpriority AS policy_id",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7200 END AS ttl_seconds",
    )
    return protect.create_vault_sessions(asked, now()).drop("created_at")


_WANTED = "(SELECT CASE WHEN doc_id % 3 = 0 THEN 'vlt_none' ELSE " + _ref_sql("GENERALIZE") + " END AS vault_ref, doc_id FROM documents)"


def _requests(spark, sf_dir):
    ref = protect.vault_ref(F.col("session_id"), F.col("doc_id"), "GENERALIZE")
    wanted = F.when(F.col("doc_id") % 3 == 0, "vlt_none").otherwise(ref)
    return payloads(spark, sf_dir).select("doc_id", wanted.alias("vault_ref"))


@query(
    "vlt_restore",
    f"SELECT w.doc_id, w.vault_ref, CASE WHEN NOT ({_EXPIRED}) THEN t END AS original_text, "
    f"CASE WHEN NOT ({_EXPIRED}) THEN n END AS entities_restored FROM {_WANTED} w "
    f"LEFT JOIN {_entries_sql('GENERALIZE')} e USING (vault_ref) LEFT JOIN {_SESSIONS} s USING (session_id)",
)
def _(spark, sf_dir):
    kept = entries(spark, sf_dir, "GENERALIZE").drop("doc_id")
    return protect.restore(_requests(spark, sf_dir), kept, sessions(spark, sf_dir), now())


def _bucketed(spark, sf_dir):
    name = f"vault_entries_{uuid.uuid4().hex}"
    kept = entries(spark, sf_dir, "GENERALIZE").drop("doc_id")
    protect.write_entries(kept, name, f"{checkpoint_dir(spark).rstrip('/')}/{name}", buckets=16)
    return spark.table(name)


@query(
    "vlt_restore_bucketed",
    f"SELECT w.doc_id, w.vault_ref, CASE WHEN NOT ({_EXPIRED}) THEN t END AS original_text, "
    f"CASE WHEN NOT ({_EXPIRED}) THEN n END AS entities_restored FROM {_WANTED} w "
    f"LEFT JOIN {_entries_sql('GENERALIZE')} e USING (vault_ref) LEFT JOIN {_SESSIONS} s USING (session_id)",
)
def _(spark, sf_dir):
    return protect.restore(_requests(spark, sf_dir), _bucketed(spark, sf_dir), sessions(spark, sf_dir), now())


@query(
    "vlt_find_entries",
    f"SELECT vault_ref, session_id, sanitized AS sanitized_text FROM {_entries_sql('GENERALIZE')} "
    "WHERE vault_ref IN (SELECT vault_ref FROM (SELECT " + _ref_sql("GENERALIZE") + " AS vault_ref, doc_id FROM documents) ORDER BY doc_id LIMIT 20)",
)
def _(spark, sf_dir):
    refs = payloads(spark, sf_dir).orderBy("doc_id").limit(20).select(protect.vault_ref(F.col("session_id"), F.col("doc_id"), "GENERALIZE").alias("ref"))
    wanted = [row.ref for row in refs.collect()]
    return protect.find_entries(_bucketed(spark, sf_dir), wanted).select("vault_ref", "session_id", "sanitized_text")


@query(
    "vlt_get_entries",
    f"SELECT e.vault_ref, e.session_id, sanitized AS sanitized_text FROM {_entries_sql('GENERALIZE')} e "
    f"JOIN {_SESSIONS} s USING (session_id) WHERE NOT ({_EXPIRED}) AND vault_ref IN (SELECT vault_ref FROM {_WANTED})",
)
def _(spark, sf_dir):
    found = protect.get_entries(_requests(spark, sf_dir), entries(spark, sf_dir, "GENERALIZE"), sessions(spark, sf_dir), now())
    return found.select("vault_ref", "session_id", "sanitized_text")


@query(
    "vlt_open_sessions",
    f"SELECT p.doc_id, CASE WHEN s.session_id IS NULL THEN 'session not found' WHEN {_EXPIRED} THEN "
    f"'session has expired' ELSE 'accepted' END AS outcome FROM {_DOCS} p LEFT JOIN "
    f"(SELECT * FROM {_SESSIONS} WHERE session_id <> 'vs_src19') s USING (session_id)",
)
def _(spark, sf_dir):
    known = sessions(spark, sf_dir).where("session_id <> 'vs_src19'")
    accepted, rejected = protect.open_sessions(payloads(spark, sf_dir).select("doc_id", "session_id"), known, now())
    return accepted.select("doc_id", F.lit("accepted").alias("outcome")).union(
        rejected.select("doc_id", F.col("reason").alias("outcome"))
    )


@query(
    "vlt_session_info",
    f"SELECT s.session_id, s.agent_id, any_value({_EXPIRED}) AS expired, count(e.n) AS entries_count, "
    f"coalesce(sum(e.n), 0)::BIGINT AS total_tokens FROM {_SESSIONS} s LEFT JOIN {_entries_sql('TOKENIZE')} e "
    "USING (session_id) GROUP BY ALL",
)
def _(spark, sf_dir):
    info = protect.session_info(sessions(spark, sf_dir), entries(spark, sf_dir, "TOKENIZE"), now())
    return info.select("session_id", "agent_id", "expired", "entries_count", "total_tokens")


_TYPED = "CASE " + " ".join(f"WHEN contains(upper(r), '{t}') THEN '{t}'" for t in VAULT_TYPES) + " END"
_TOKENS = (
    f"(SELECT session_id, {_TYPED} AS entity_type, count(*) AS tokens FROM (SELECT session_id, "
    f"split_part(unnest(string_split(pairs, '>>=')), '<<', 2) AS r FROM {_entries_sql('TOKENIZE')} WHERE pairs <> '') "
    "WHERE r <> '' GROUP BY 1, 2 HAVING entity_type IS NOT NULL)"
)


@query(
    "vlt_session_stats",
    f"""SELECT s.session_id, {_EXPIRED} AS expired, coalesce(e.c, 0) AS entries_count, coalesce(e.n, 0) AS total_tokens,
  coalesce(t.m, '') AS tokens_by_type, CASE WHEN e.c IS NULL THEN '' ELSE 'TOKENIZE=' || e.c END AS modes_used,
  7200.0::DOUBLE AS age_seconds, greatest(0.0, ttl_seconds - 7200.0)::DOUBLE AS ttl_remaining
FROM {_SESSIONS} s
LEFT JOIN (SELECT session_id, count(*) AS c, sum(n)::BIGINT AS n FROM {_entries_sql('TOKENIZE')} GROUP BY 1) e USING (session_id)
LEFT JOIN (SELECT session_id, string_agg(entity_type || '=' || tokens, '; ' ORDER BY entity_type) AS m
           FROM {_TOKENS} GROUP BY 1) t USING (session_id)""",
)
def _(spark, sf_dir):
    kept = stage(entries(spark, sf_dir, "TOKENIZE").select("session_id", "mappings", "mode"))
    out = protect.session_stats(sessions(spark, sf_dir), kept, now())
    return out.select(
        "session_id",
        "expired",
        "entries_count",
        "total_tokens",
        F.coalesce(shown_map("tokens_by_type"), F.lit("")).alias("tokens_by_type"),
        F.coalesce(shown_map("modes_used"), F.lit("")).alias("modes_used"),
        "age_seconds",
        "ttl_remaining",
    )


@query(
    "vlt_vault_stats",
    f"SELECT (SELECT count(*) FROM {_SESSIONS}) AS total_sessions, "
    f"(SELECT count(*) FROM {_SESSIONS} WHERE NOT ({_EXPIRED})) AS active_sessions, "
    f"(SELECT count(*) FROM {_SESSIONS} WHERE {_EXPIRED}) AS expired_sessions, "
    f"(SELECT sum(n)::BIGINT FROM {_entries_sql('TOKENIZE')}) AS total_tokens, "
    "(SELECT string_agg(entity_type || '=' || n, '; ' ORDER BY entity_type) FROM (SELECT entity_type, "
    f"sum(tokens)::BIGINT AS n FROM {_TOKENS} GROUP BY 1)) AS tokens_by_type",
)
def _(spark, sf_dir):
    kept = stage(entries(spark, sf_dir, "TOKENIZE").select("session_id", "mappings"))
    out = protect.vault_stats(sessions(spark, sf_dir), kept, now())
    return out.withColumn("tokens_by_type", shown_map("tokens_by_type"))


@query(
    "vlt_purge",
    f"SELECT vault_ref, session_id FROM {_entries_sql('REDACT')} WHERE session_id NOT IN "
    f"(SELECT session_id FROM {_SESSIONS} WHERE ttl_seconds % 1800 = 0)",
)
def _(spark, sf_dir):
    purged = sessions(spark, sf_dir).where("ttl_seconds % 1800 = 0")
    return protect.purge_sessions(entries(spark, sf_dir, "REDACT"), purged).select("vault_ref", "session_id")


@query(
    "vlt_purge_stored",
    f"SELECT vault_ref, session_id, sanitized AS sanitized_text FROM {_entries_sql('REDACT')} WHERE session_id NOT IN "
    f"(SELECT session_id FROM {_SESSIONS} WHERE ttl_seconds % 1800 = 0)",
)
def _(spark, sf_dir):
    """The same on stored entries, erased in place."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vault-{uuid.uuid4().hex}"
    entries(spark, sf_dir, "REDACT").select("vault_ref", "session_id", "sanitized_text").write.parquet(path)
    purged = sessions(spark, sf_dir).where("ttl_seconds % 1800 = 0")
    erase_rows(spark, path, lambda: spark.read.parquet(path), purged, "session_id", None)
    return spark.read.parquet(path)
