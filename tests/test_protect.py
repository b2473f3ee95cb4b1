from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.functions import masking
from veilframe.functions.detection import ENTITIES_TYPE
from veilframe.operators import detect, protect

T0 = datetime(2025, 1, 1)
def now():
    return F.lit(T0 + timedelta(minutes=10))


def entity(kind, text, start):
    return (kind, text, start, start + len(text), 0.95, "PII", "", "REDACT", "HIGH")


def docs(spark, rows):
    """Rows of ``doc_id, session_id, doc_seq, text, entities``."""
    return spark.createDataFrame(rows, f"doc_id int, session_id string, doc_seq bigint, text string, entities {ENTITIES_TYPE}")


def sessions(spark, **ttl):
    rows = [(s, "agent", "default", T0, t) for s, t in ttl.items()]
    return spark.createDataFrame(rows, "session_id string, agent_id string, policy_id string, created_at timestamp, ttl_seconds int")


SSN = [(1, "s", 1, "SSN 123-45-6789", [entity("SSN", "123-45-6789", 4)])]


def tokenized(df, **kw):
    return protect.tokenize(df, df.select("doc_id", "session_id", "doc_seq", "entities"), **kw)


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("redact", r"SSN \[REDACTED\]"),
        ("GENERALIZE", r"SSN \[SSN_GENERALIZED\]"),
        ("PSEUDONYMIZE", r"SSN 000-00-000[1-8]"),
        ("ENCRYPT", r"SSN ENC:[A-Za-z0-9_-]+"),
        ("SYNTHESIZE", r"SSN \d{3}-\d{2}-\d{4}"),
    ],
)
def test_modes(spark, mode, expected):
    row = protect.protect(docs(spark, SSN), mode).first()
    import re

    assert re.fullmatch(expected, row.sanitized_text)
    assert list(row.mappings.values()) == ["123-45-6789"]
    assert protect.protect(docs(spark, SSN), mode).first() == row  # a repeated task writes the same


def test_tokenize_and_unknown_mode(spark):
    assert tokenized(docs(spark, SSN)).first().sanitized_text == "SSN <<SSN_1>>"
    assert masking.known_mode("shred") == "TOKENIZE"
    with pytest.raises(ValueError):
        protect.protect(docs(spark, SSN), "shred")


def test_counters_run_from_end_to_start_and_across_texts(spark):
    text = "a@b.co c@d.co 10.0.0.1"
    found = [entity("EMAIL", "a@b.co", 0), entity("EMAIL", "c@d.co", 7), entity("IP_ADDRESS", "10.0.0.1", 14)]
    rows = [(i, "s", i, text, found) for i in (1, 2)] + [(3, "t", 3, text, found)]
    got = {r.doc_id: r.sanitized_text for r in tokenized(docs(spark, rows), width=1).collect()}
    assert got == {
        1: "<<EMAIL_2>> <<EMAIL_1>> <<IP_ADDRESS_1>>",
        2: "<<EMAIL_4>> <<EMAIL_3>> <<IP_ADDRESS_2>>",
        3: "<<EMAIL_2>> <<EMAIL_1>> <<IP_ADDRESS_1>>",
    }


def test_one_session_holds_most_texts(spark):
    rows = [(i, "hot" if i % 3 else "cold", i, "a@b.co", [entity("EMAIL", "a@b.co", 0)]) for i in range(3000)]
    numbered = protect.number_tokens(docs(spark, rows).drop("text"), width=16)
    got = {(r.session_id, r.doc_id): r.number for r in numbered.collect()}
    count = {"hot": 0, "cold": 0}
    for i, session, *_ in rows:
        count[session] += 1
        assert got[(session, i)] == count[session]


def test_text_without_entities_stays(spark):
    df = docs(spark, [(1, "s", 1, "nothing here é", [])])
    for out in (protect.protect(df, "REDACT"), tokenized(df)):
        row = out.first()
        assert (row.sanitized_text, row.mappings) == ("nothing here é", {})


def test_splice_in_other_scripts(spark):
    text = "é😀 a@b.co, ñ 10.0.0.1 ü"
    found = [entity("EMAIL", "a@b.co", 3), entity("IP_ADDRESS", "10.0.0.1", 13)]
    df = docs(spark, [(1, "s", 1, text, found)])
    assert protect.mask_labels(df).first().sanitized == "é😀 [EMAIL], ñ [IP_ADDRESS] ü"


def test_mapping_keeps_the_leftmost_original(spark):
    found = [entity("EMAIL", "a@b.co", 0), entity("EMAIL", "c@d.co", 7)]
    row = protect.protect(docs(spark, [(1, "s", 1, "a@b.co c@d.co", found)]), "REDACT").first()
    assert row.mappings == {"[REDACTED]": "a@b.co"}


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        ("DATE", "2025-01-15", "2025/01 (month)"),
        ("DATE", "03/15/1985", "03/03 (month)"),
        ("DATE", "May 5", "[DATE_RANGE]"),
        ("CREDIT_CARD", "4111-1111-1111-1234", "****-****-****-1234"),
        ("CREDIT_CARD", "123", "[CARD_GENERALIZED]"),
        ("PHONE", "(212) 555-0147", "(***) ***-0147"),
        ("EMAIL", "a@b.co", "***@b.co"),
        ("EMAIL", "ab.co", "[EMAIL_GENERALIZED]"),
        ("IP_ADDRESS", "10.1.2.3", "10.1.0.0/16"),
        ("IP_ADDRESS", "10.1", "[IP_GENERALIZED]"),
        ("PERSON_NAME", "Dr. X", "[PERSON]"),
        ("IBAN", "DE89370400440532013000", "DE89****3000"),
        ("IBAN", "DE89", "[IBAN_GENERALIZED]"),
        ("API_KEY", "sk-abc", "sk-a..."),
        ("PASSPORT", "AB1234567", "[PASSPORT_GENERALIZED]"),
        ("vin", "x", "[VIN_GENERALIZED]"),
    ],
)
def test_generalize(spark, kind, text, expected):
    df = spark.createDataFrame([(kind, text)], "kind string, text string")
    assert df.select(masking.generalize(F.col("kind"), F.col("text"))).first()[0] == expected


def test_encode_round_trip_and_foreign_values(spark):
    values = ["x", "a:b", "é😀" * 40, "", "a?>~"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    coded = df.select("v", masking.encode(F.lit("sess"), F.col("v")).alias("c"))
    assert all("=" not in r.c and "\n" not in r.c for r in coded.collect())
    assert [r[0] for r in coded.select(masking.decode(F.col("c"))).collect()] == values
    bad = spark.createDataFrame([("plain",), ("ENC:!!",), ("ENC:YWJj",), ("ENC:/w",)], "v string")
    assert [r[0] for r in bad.select(masking.decode(F.col("v"))).collect()] == [None] * 4


def test_restore_and_expiry(spark):
    df = docs(spark, [(1, "open", 1, "SSN 123-45-6789", SSN[0][4]), (2, "closed", 2, "SSN 123-45-6789", SSN[0][4])])
    entries = protect.protect(df, "REDACT")
    state = sessions(spark, open=3600, closed=60)
    refs = entries.select("vault_ref").union(spark.createDataFrame([("vlt_none",)], "vault_ref string"))
    got = protect.restore(refs, entries, state, now()).collect()
    assert sorted((r.original_text or "", r.entities_restored or 0) for r in got) == [("", 0), ("", 0), ("SSN 123-45-6789", 1)]
    assert protect.get_entries(refs, entries, state, now()).count() == 1
    accepted, rejected = protect.open_sessions(df.union(docs(spark, [(3, "gone", 3, "", [])])), state, now())
    assert [r.doc_id for r in accepted.collect()] == [1]
    assert {r.doc_id: r.reason for r in rejected.collect()} == {2: "session has expired", 3: "session not found"}
    assert [r.session_id for r in protect.purge_sessions(entries, state.where("session_id = 'open'")).collect()] == ["closed"]


def test_hundred_entities_come_back(spark):
    parts = [f"{100 + i}-45-{1000 + i}" for i in range(100)]
    text, found, at = "", [], 0
    for p in parts:
        found.append(entity("SSN", p, len(text)))
        text += p + " "
    entries = tokenized(docs(spark, [(1, "s", 1, text, found)]))
    row = protect.restore(entries.select("vault_ref"), entries, sessions(spark, s=3600), now()).first()
    assert (row.original_text, row.entities_restored) == (text, 100)


def test_stats(spark):
    entries = tokenized(docs(spark, SSN))
    row = protect.session_stats(sessions(spark, s=3600, empty=60), entries, now()).where("session_id = 's'").first()
    assert (row.entries_count, row.total_tokens, row.tokens_by_type, row.modes_used) == (1, 1, {"SSN": 1}, {"TOKENIZE": 1})
    assert (row.age_seconds, row.ttl_remaining, row.expired) == (600.0, 3000.0, False)
    total = protect.vault_stats(sessions(spark, s=3600, empty=60), entries, now()).first()
    assert (total.total_sessions, total.active_sessions, total.expired_sessions, total.total_tokens) == (2, 1, 1, 1)


def test_protect_end_to_end_leaves_nothing_behind(spark):
    df = spark.createDataFrame([(1, "s", "mail a@b.co or c@d.co from 10.0.0.1")], "doc_id int, session_id string, text string")
    clean = detect.residual_check(protect.protect(detect.detect_entities(df), "PSEUDONYMIZE")).first()
    assert [e.original_text.split("@")[-1] for e in clean.remaining_entities if e.entity_type != "EMAIL"] == []
    labels = detect.residual_check(protect.protect(detect.detect_entities(df), "REDACT")).first()
    # The label itself looks like a bank code, here as in any other scan of it.
    assert {(e.entity_type, e.original_text) for e in labels.remaining_entities} == {("SWIFT_BIC", "REDACTED")}
