"""Personal data: regular expressions propose spans, checksums and digit counts confirm
them, and words nearby move their score.

Base kinds (``email, ip, card, phone``) are exact rules: leftmost, non-overlapping matches
that pass their check are always reported.  Further kinds are only reported if their score
reaches ``MIN_SCORE``: an IBAN that passes mod 97 does by itself; short cards that pass
Luhn, national identity numbers and telephone numbers without a country code need a word
nearby that speaks for them, as plain numbers look the same.  A further span that overlaps
a better one goes.

Every search is linear in the text, also in texts without blanks.  No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from veilframe.llm.shared import slices

MIN_SCORE = 0.5
#: Characters before and after a span in which words count.
CONTEXT_CHARS = 50
#: What a word nearby adds or takes.
FOR, AGAINST = 0.35, 0.3
SLICE_BYTES = 8 << 20
SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long").add("text", "string").add("score", "double")

BASE_KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    text: str
    score: float


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    """Is the sum of digits right, every second one from the right doubled?"""
    doubled = (int(d) * 2 for d in number[-2::-2])
    return (sum(map(int, number[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Is the rest 1, the first four characters moved to the end and letters as 10 to 35?"""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


# ---------------------------------------------------------------- base kinds

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A part begins where no digit is before it: from the middle of one nothing else is found
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and domain, found from each ``@`` to both sides: the
    local part reaches back to the last match or to what cannot be in it."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[done:at][::-1])
        domain = local and _DOMAIN.match(text, at + 1)
        if domain:
            yield at - local.end(), domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.groups()):
            yield found.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        number = digits(found[0])
        if 16 <= len(number) <= 19 and luhn(number):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 8 <= len(digits(found[0])) <= 15:
            yield found.span()


# ---------------------------------------------------------------- kinds of the method

_WORD = r"(?<![^\W_])(?:{})(?![^\W_])"


def _words(*words: str) -> re.Pattern:
    return re.compile(_WORD.format("|".join(words)), re.IGNORECASE)


#: Speak against any number: what follows or stands around is a count, a price or a key.
_NO_PERSON = _words("isbn", "issn", "doi", "sku", "serial", "order", "invoice", "version", "build", "tracking", "example", "sample")


class Kind(NamedTuple):
    """A proposal with its ``check``, the score of a confirmed match and the words for it."""

    name: str
    pattern: re.Pattern
    check: Callable[[str], bool]
    score: float
    words: re.Pattern


def _iban(text: str) -> bool:
    account = re.sub("[^A-Z0-9]", "", text)
    return 15 <= len(account) <= 34 and mod97(account)


def _short_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 15 and len(set(number)) > 1 and luhn(number)


def _national_id(text: str) -> bool:
    area, group, serial = text[:3], text[4:6], text[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


METHOD_KINDS = (
    Kind("card_short", re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"), _short_card, 0.3, _words("card", "credit", "debit", "visa", "amex", "mastercard", "carte", "karte", "kreditkarte", "tarjeta")),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, 0.7, _words("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("national_id", re.compile(r"(?<![0-9-])[0-9]{3}([\x20-])[0-9]{2}\1[0-9]{4}(?![0-9-])"), _national_id, 0.3, _words("ssn", "social security", "taxpayer", "tin")),
    Kind("phone_local", re.compile(r"(?<![0-9+)])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"), lambda text: True, 0.25, _words("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono")),
)
KINDS = BASE_KINDS + tuple(kind.name for kind in METHOD_KINDS)


def in_context(score: float, words: re.Pattern, text: str, start: int, end: int) -> float:
    """The score moved by the words near a span, between 0 and 1."""
    around = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    if words.search(around):
        score += FOR
    if _NO_PERSON.search(around):
        score -= AGAINST
    return round(min(1.0, max(0.0, score)), 6)


_FOR_BASE = {
    "email": (emails, 0.9, _words("mail", "e-mail", "email", "contact", "write")),
    "ip": (ips, 0.6, _words("ip", "address", "host", "server", "login")),
    "card": (cards, 0.8, METHOD_KINDS[0].words),
    "phone": (phones, 0.7, METHOD_KINDS[3].words),
}
_ANY_DIGITS = re.compile(r"[0-9][\x20.-]?[0-9]")


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    numbers = _ANY_DIGITS.search(text) is not None
    out = []
    for kind in BASE_KINDS:
        if numbers or kind != "card":
            find, score, words = _FOR_BASE[kind]
            if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
                continue
            out += [Span(kind, a, b, text[a:b], in_context(score, words, text, a, b)) for a, b in find(text)]
    return out + (_more(text, out) if numbers else [])


def _more(text: str, base: list[Span]) -> list[Span]:
    """Spans of the method's own kinds that overlap no base span and no better one."""
    proposed = []
    for kind in METHOD_KINDS:
        for found in kind.pattern.finditer(text):
            if kind.check(found[0]):
                score = in_context(kind.score, kind.words, text, *found.span())
                if score >= MIN_SCORE:
                    proposed.append(Span(kind.name, *found.span(), found[0], score))
    if not proposed:
        return []
    proposed.sort(key=lambda s: (s.start, -s.score, KINDS.index(s.kind)))
    free = _Free(base)
    return sorted((span for span in _best(proposed) if free.holds(span)), key=lambda s: (KINDS.index(s.kind), s.start))


def _best(spans: list[Span]) -> list[Span]:
    """Of spans by start, those that are better than the overlapping one kept before."""
    out: list[Span] = []
    for span in spans:
        if out and out[-1].end > span.start:
            if span.score > out[-1].score:
                out[-1] = span
        else:
            out.append(span)
    return out


class _Free:
    """What spans leave free of a text."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for span in sorted(spans, key=lambda s: s.start):
            if self.ends and span.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], span.end)
            else:
                self.starts.append(span.start)
                self.ends.append(span.end)

    def holds(self, span: Span) -> bool:
        before = bisect_left(self.starts, span.end)
        return not before or self.ends[before - 1] <= span.start


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``spans``: structs of ``kind, start, end`` (code points,
    end exclusive), ``text`` and ``score``, by kind in the order of ``KINDS``, then by start;
    a column of that name is replaced.  Null and empty texts have none."""
    kept = [c for c in docs.columns if c != "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = [[span._asdict() for span in find_spans(value)] for value in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found, _ARROW)], [*kept, "spans"])

    return docs.select(kept).mapInArrow(find, docs.select(kept).schema.add("spans", ArrayType(SPAN)))


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
