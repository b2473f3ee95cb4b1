"""Protection: replace detected entities, remember what was replaced, restore it.

Five of the six modes need nothing but the row, so they run in the scan with no
shuffle.  TOKENIZE numbers tokens per session and type across texts; only the
small entity rows take part in that, and texts are shuffled once, to meet their
own replacements.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import masking
from veilframe.functions.constants import VAULT_TYPES
from veilframe.functions.ordered import WIDTH, running_total
from veilframe.operators.detect import detect_entities
from veilframe.operators.reports import one_row
from veilframe.sources.staging import stage

REF_DIGITS = 32
TTL_SECONDS = 1800


def vault_ref(session_id: Column, doc_id: Column, mode: str) -> Column:
    digest = F.sha2(F.concat_ws("|", session_id, doc_id.cast("string"), F.lit(mode)), 256)
    return F.concat(F.lit("vlt_"), F.substring(digest, 1, REF_DIGITS))


def create_vault_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """New vault sessions for ``request_id, agent_id, policy_id, ttl_seconds``; a null
    ttl is half an hour.  The request's id tells equal requests apart."""
    digest = F.sha2(F.concat_ws("|", F.lit("session"), F.col("request_id").cast("string"), now.cast("string")), 256)
    return requests.select(
        F.concat(F.lit("vs_"), F.substring(digest, 1, REF_DIGITS)).alias("session_id"),
        "agent_id",
        "policy_id",
        now.alias("created_at"),
        F.coalesce(F.col("ttl_seconds").cast("int"), F.lit(TTL_SECONDS)).alias("ttl_seconds"),
    )


def is_expired(now: Column) -> Column:
    """Of a vault session with ``created_at`` and ``ttl_seconds``."""
    return now > F.col("created_at") + F.make_interval(secs=F.col("ttl_seconds"))


def open_sessions(docs: DataFrame, sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Split ``docs`` into those whose session may still write and the rejected
    ones, which get a ``reason``."""
    state = sessions.select("session_id", is_expired(now).alias("_expired"))
    joined = docs.join(state, "session_id", "left")
    accepted = joined.where(~F.col("_expired")).drop("_expired")
    reason = F.when(F.col("_expired").isNull(), "session not found").otherwise("session has expired")
    rejected = joined.where(F.coalesce(F.col("_expired"), F.lit(True))).withColumn("reason", reason).drop("_expired")
    return accepted, rejected


def _entry(df: DataFrame, pairs: Column, sanitized: Column, mode: str, keep: list[str]) -> DataFrame:
    return df.select(
        *keep,
        vault_ref(F.col("session_id"), F.col("doc_id"), mode).alias("vault_ref"),
        F.col("text").alias("original_text"),
        sanitized.alias("sanitized_text"),
        masking.mapping(pairs).alias("mappings"),
        F.lit(mode).alias("mode"),
    )


def mask_labels(df: DataFrame, output: str = "sanitized") -> DataFrame:
    """Replace every entity by ``[TYPE]``."""
    return df.withColumn(output, masking.splice(F.col("text"), F.col("entities"), lambda e: masking.label(e["entity_type"])))


def protect(df: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """Vault entries for ``df`` (``doc_id, session_id, text, entities``) in any mode
    but TOKENIZE: no shuffle."""
    mode = masking.known_mode(mode)
    return _entries(_replaced(df, mode, seed), mode)


def _entries(ready: DataFrame, mode: str) -> DataFrame:
    sanitized = masking.splice(F.col("text"), F.col("spans"), lambda s: s["replacement"])
    return _entry(ready, F.col("spans"), sanitized, mode, ["doc_id", "session_id"])


def _replaced(df: DataFrame, mode: str, seed: int) -> DataFrame:
    """``doc_id, session_id, text`` and the ``spans`` with their replacements."""
    session, kind, value = F.col("session_id"), lambda e: e["entity_type"], lambda e: e["original_text"]
    key = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))
    replacement = {
        "REDACT": lambda e: F.lit("[REDACTED]"),
        "PSEUDONYMIZE": lambda e: masking.pseudonym(session, kind(e), value(e)),
        "GENERALIZE": lambda e: masking.generalize(kind(e), value(e)),
        "ENCRYPT": lambda e: masking.encode(session, value(e)),
        "SYNTHESIZE": lambda e: masking.synthesize(kind(e), key, e["start"]),
    }.get(mode)
    if replacement is None:
        raise ValueError("TOKENIZE numbers tokens across texts: use tokenize()")
    spans = F.transform(
        "entities",
        lambda e: F.struct(
            e["start"].alias("start"),
            e["end"].alias("end"),
            value(e).alias("original"),
            replacement(e).alias("replacement"),
            kind(e).alias("entity_type"),
            e["confidence"].alias("confidence"),
        ),
    )
    # A generator's output is computed once, however often it is read below.
    return df.select("doc_id", "session_id", "text", F.explode(F.array(spans)).alias("spans"))


def number_tokens(detected: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per entity of ``detected`` (``doc_id, session_id, doc_seq,
    entities``) with its token.  Counting runs per session and type over texts in
    ``doc_seq`` order and from the end of each text to its start."""
    rows = detected.select("doc_id", "session_id", "doc_seq", F.inline("entities")).withColumn("one", F.lit(1))
    numbered = running_total(
        rows, ["session_id", "entity_type"], "doc_seq", "one", "number", order=[F.desc("start")], width=width
    )
    return numbered.drop("one").withColumn("token", masking.token(F.col("entity_type"), F.col("number")))


def tokenize(texts: DataFrame, detected: DataFrame, width: int = WIDTH) -> DataFrame:
    """Vault entries with numbered tokens.

    ``texts`` holds ``doc_id, session_id, text``; ``detected`` is the stored
    detection result of the same texts (``doc_id, session_id, doc_seq,
    entities``) and is read without touching any text.
    """
    spans = _token_spans(detected, width)
    joined = texts.select("doc_id", "session_id", "text").join(spans, "doc_id", "left")
    return _entries(joined.withColumn("spans", F.coalesce("spans", _no_spans(spans))), "TOKENIZE")


def _token_spans(detected: DataFrame, width: int) -> DataFrame:
    span = F.struct("start", "end", F.col("original_text").alias("original"), F.col("token").alias("replacement"), "entity_type", "confidence")
    return number_tokens(detected, width).groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _no_spans(spans: DataFrame) -> Column:
    return F.array().cast(spans.schema["spans"].dataType)


def tokenize_simple(df: DataFrame) -> DataFrame:
    """Vault entries with numbered tokens for texts without a session (``doc_id, text,
    entities``): each text gets a session of its own, so its tokens are numbered inside
    the row, from the end of the text to its start, and nothing is shuffled."""
    own = df.withColumn("session_id", F.concat(F.lit("vs_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, REF_DIGITS)))

    def number(e):
        later = F.filter("entities", lambda o: (o["entity_type"] == e["entity_type"]) & (o["start"] >= e["start"]))
        return masking.token(e["entity_type"], F.size(later))

    spans = F.transform(
        "entities",
        lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("end"), e["original_text"].alias("original"), number(e).alias("replacement")
        ),
    )
    return _entries(own.select("doc_id", "session_id", "text", F.explode(F.array(spans)).alias("spans")), "TOKENIZE")


class Protected(NamedTuple):
    """What ``protect_texts`` gives."""

    entries: DataFrame
    entities: DataFrame
    counts: DataFrame
    rejected: DataFrame


def protect_texts(docs: DataFrame, sessions: DataFrame, now: Column, mode: str = "TOKENIZE", seed: int = 0, width: int = WIDTH) -> Protected:
    """Detect and replace in one go.

    ``docs``: ``doc_id, session_id, doc_seq, text``.  Texts whose session is unknown or
    has expired are ``rejected`` with a reason; the others give vault ``entries``,
    ``entities`` (a row each, with the token that stands in the text) and ``counts`` per
    session.  Texts are detected once; of those without entities none is shuffled."""
    mode = masking.known_mode(mode)
    accepted, rejected = open_sessions(docs, sessions, now)
    found = detect_entities(accepted)
    if mode == "TOKENIZE":
        found = stage(found.select("doc_id", "session_id", "doc_seq", "text", "entities"))
        spans = _token_spans(found, width)
        has = F.size("entities") > 0
        hit = found.where(has).select("doc_id", "session_id", "text").join(spans, "doc_id")
        ready = hit.unionByName(found.where(~has).select("doc_id", "session_id", "text", _no_spans(spans).alias("spans")))
    else:
        ready = _replaced(found, mode, seed)
    ready = stage(ready)
    rows = ready.select("doc_id", "session_id", F.inline("spans"))
    entities = rows.select(
        F.xxhash64("session_id", "doc_id", "start", "entity_type", F.lit(mode)).alias("id"),
        "doc_id",
        "session_id",
        "start",
        "entity_type",
        F.col("original").alias("original_text"),
        F.col("replacement").alias("token"),
        "confidence",
        F.lit(mode).alias("action"),
        now.alias("detected_at"),
    )
    counts = ready.groupBy("session_id").agg(F.count("*").alias("texts"), F.sum(F.size("spans")).alias("entities_protected"))
    counts = counts.join(sessions.select("session_id", "agent_id", "policy_id"), "session_id")
    return Protected(_entries(ready, mode), entities, counts, rejected)


def restore(requests: DataFrame, entries: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Original text and number of distinct replacements per requested
    ``vault_ref``; both null where the reference is unknown or has expired."""
    entry = F.struct("session_id", "original_text", F.size("mappings").alias("n"))
    state = sessions.select(F.col("session_id").alias("_session"), is_expired(now).alias("_expired"))
    found = requests.join(entries.select("vault_ref", entry.alias("_entry")), "vault_ref", "left")
    found = found.join(state, F.col("_entry.session_id") == F.col("_session"), "left")
    readable = F.coalesce(~F.col("_expired"), F.lit(False))
    return found.select(
        *requests.columns,
        F.when(readable, F.col("_entry.original_text")).alias("original_text"),
        F.when(readable, F.col("_entry.n")).alias("entities_restored"),
    )


def write_entries(entries: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Store vault entries as the catalog's table ``table`` with its files at ``path``: in
    buckets by ``vault_ref``, sorted, with Bloom filters.  Requests then meet the entries
    where they lie (``restore`` of ``spark.table(table)`` shuffles requests only), and
    ``find_entries`` reads few row groups."""
    dealt = entries.repartition(buckets, "vault_ref")  # a file for each bucket
    (
        dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, "vault_ref").sortBy("vault_ref")
        .option("path", path).option("parquet.bloom.filter.enabled#vault_ref", "true").saveAsTable(table)
    )


def find_entries(entries: DataFrame, refs: Sequence[str]) -> DataFrame:
    """The entries of a few references, without a shuffle: only their buckets' files are
    opened, and Bloom filters and bounds skip row groups."""
    return entries.where(F.col("vault_ref").isin(*refs))


def get_entries(requests: DataFrame, entries: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """The entries of the requested references whose session is still open."""
    live = sessions.where(~is_expired(now)).select("session_id")
    return entries.join(requests.select("vault_ref").distinct(), "vault_ref", "left_semi").join(
        live, "session_id", "left_semi"
    )


def session_info(sessions: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    counts = entries.groupBy("session_id").agg(
        F.count("*").alias("entries_count"), F.sum(F.size("mappings")).cast("bigint").alias("total_tokens")
    )
    return sessions.join(counts, "session_id", "left").select(
        *sessions.columns,
        is_expired(now).alias("expired"),
        F.coalesce("entries_count", F.lit(0)).alias("entries_count"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
    )


def purge_sessions(df: DataFrame, purged: DataFrame) -> DataFrame:
    """What is left of a vault table after erasing the sessions in ``purged``."""
    return df.join(purged.select("session_id"), "session_id", "left_anti")


def token_type(key: Column) -> Column:
    """The first known type whose name a replacement contains."""
    shown = F.upper(key)
    out = F.lit(None).cast("string")
    for name in reversed(VAULT_TYPES):
        out = F.when(F.contains(shown, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def tokens_by_type(entries: DataFrame) -> DataFrame:
    """Replacements per session and type; those of no known type are left out."""
    keys = entries.select("session_id", F.explode(F.map_keys("mappings")).alias("key"))
    typed = keys.withColumn("entity_type", token_type(F.col("key"))).where("entity_type IS NOT NULL")
    return typed.groupBy("session_id", "entity_type").agg(F.count("*").alias("tokens"))


def session_stats(sessions: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Session info with maps of tokens by type and entries by mode, age and time left."""
    types = tokens_by_type(entries).groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "tokens")))).alias("tokens_by_type")
    )
    modes = (
        entries.groupBy("session_id", "mode").agg(F.count("*").alias("n")).groupBy("session_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("modes_used"))
    )
    age = now.cast("double") - F.col("created_at").cast("double")
    return (
        session_info(sessions, entries, now)
        .join(types, "session_id", "left")
        .join(modes, "session_id", "left")
        .withColumn("age_seconds", F.round(age, 1))
        .withColumn("ttl_remaining", F.greatest(F.lit(0.0), F.round(F.col("ttl_seconds") - age, 1)))
    )


def vault_stats(sessions: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """One row: sessions in total, open and expired, tokens, and tokens by type."""
    state = sessions.agg(
        F.count("*").alias("total_sessions"),
        F.count_if(~is_expired(now)).alias("active_sessions"),
        F.count_if(is_expired(now)).alias("expired_sessions"),
    )
    tokens = entries.agg(F.coalesce(F.sum(F.size("mappings")), F.lit(0)).cast("bigint").alias("total_tokens"))
    types = (
        tokens_by_type(entries).groupBy("entity_type").agg(F.sum("tokens").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("entity_type", "n"))).alias("_types"))
    )
    return one_row(state, tokens, types).select(
        *state.columns, "total_tokens", F.map_from_entries("_types").alias("tokens_by_type")
    )
