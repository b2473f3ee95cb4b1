import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import personal as pd
from veilframe.llm.queries import op13_personal_data

SF = "/root/testdata/sf0.01"


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d)
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def n_digits(text):
    return [c for c in text if c in "0123456789"]


#: The rules as they are stated, with their check.
RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(n_digits(t)) <= 19 and luhn(n_digits(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(n_digits(t)) <= 15),
}


def brute(text):
    return [(kind, *m.span()) for kind, (rule, check) in RULES.items() for m in re.finditer(rule, text or "") if check(m[0])]


PARTS = ["@", ".", "a", "b.c", "x_", "é", "日", " ", "-", "+", "1", "12", "255", "256", "0", "007", "(", ")", "a@b.co", "1.2.3.4", "+1 (743) 555-3824", "4465758382889437", "4465 7583 8288 9437", "\n", "%", "tel "]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_kinds(text):
    assert [tuple(s[:3]) for s in pd.find_spans(text) if s.kind in pd.BASE_KINDS] == brute(text)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_personal_data(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in RULES]
        shown = [":".join(map(str, b)) for b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert r.spans.split(",")[: len(shown)] == shown or not shown
    assert sum(bool(r.spans) for r in rows) > 20


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("Pay to GB82 WEST 1234 5698 7654 32 please", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("DE89370400440532013000", "iban", "DE89370400440532013000"),
        ("my visa is 378282246310005.", "card_short", "378282246310005"),
        ("SSN: 536-90-4399", "national_id", "536-90-4399"),
        ("call (212) 555-0187 now", "phone_local", "(212) 555-0187"),
        ("Tél. / téléphone 212-555-0187", "phone_local", "212-555-0187"),
    ],
)
def test_kinds_of_the_method(text, kind, part):
    (span,) = pd.find_spans(text)
    assert (span.kind, span.text, text[span.start : span.end]) == (kind, part, part) and span.score >= pd.MIN_SCORE


@pytest.mark.parametrize(
    "text",
    [
        "GB82 WEST 1234 5698 7654 33",  # wrong check digits
        "XGB82WEST12345698765432",
        "378282246310005",  # no word speaks for it
        "visa 378282246310006",
        "the isbn of this card book is 9780306406157",  # words against
        "536-90-4399",
        "SSN 000-12-3456 and 666-12-3456 and 123-00-4567",
        "pages 212-555-0187",
        "recall 212-555-0187",  # not the word
        "00000000000000 card",
    ],
)
def test_what_is_left_alone(text):
    assert pd.find_spans(text) == []


def test_base_spans_stay_and_win():
    found = pd.find_spans("phone +1 (743) 555-3824, tel 212-555-0187")
    assert [(s.kind, s.text) for s in found] == [("phone", "+1 (743) 555-3824"), ("phone_local", "212-555-0187")]
    low = pd.find_spans("order 1.2.3.4")[0]
    high = pd.find_spans("server 1.2.3.4")[0]
    assert low.kind == high.kind == "ip" and low.score < high.score


def test_long_texts_take_linear_time():
    n = 400_000
    started = time.perf_counter()
    for text in ("a" * n, "1" * n, "1." * n, "@" * n, "a@" * n, "+1" * n, "+" + "1 " * n, "(" * n, "1-" * n, "A1" * n, "a@b." * n, "GB82" * n):
        assert [tuple(s[:3]) for s in pd.find_spans(text) if s.kind == "card"] == []
    assert time.perf_counter() - started < 60
    rng = random.Random(3)
    text = "".join(rng.choice(PARTS) for _ in range(50_000))
    assert [tuple(s[:3]) for s in pd.find_spans(text) if s.kind in pd.BASE_KINDS] == brute(text)


def test_edges(spark, rows):
    docs = rows([(1, "é a@b.co", "x"), (1, "é a@b.co", "x"), (None, None, "y"), (2, "", "z"), (3, "no", None)], "doc_id long, text string, spans string")
    out = pd.personal_data(docs)
    assert out.columns == ["doc_id", "text", "spans"]
    got = [(r.doc_id, [tuple(s)[:4] for s in r.spans]) for r in out.collect()]
    once = (1, [("email", 2, 8, "a@b.co")])
    assert got == [once, once, (None, []), (2, []), (3, [])]
    assert pd.personal_data(docs.limit(0)).count() == 0
