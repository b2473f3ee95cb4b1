"""Replacement values for entities, and splicing them into the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.constants import (
    PSEUDONYM_NUMBERS,
    PSEUDONYM_POOLS,
    SYNTHETIC_DOMAINS,
    SYNTHETIC_FIRST_NAMES,
    SYNTHETIC_LAST_NAMES,
)

MODES = ("REDACT", "TOKENIZE", "PSEUDONYMIZE", "GENERALIZE", "ENCRYPT", "SYNTHESIZE")


def known_mode(mode: str) -> str:
    """``mode`` in capitals; anything unknown means TOKENIZE."""
    return mode.upper() if mode.upper() in MODES else "TOKENIZE"


def token(entity_type: Column, number: Column) -> Column:
    return F.concat(F.lit("<<"), entity_type, F.lit("_"), number.cast("string"), F.lit(">>"))


def label(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("]"))


def hex_modulo(digest: Column, modulus: int) -> Column:
    """A 256-bit hex number modulo a small one, 32 bits at a time."""

    def step(rest, k):
        word = F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
        return (rest * F.lit(1 << 32) + word) % F.lit(modulus)

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"), step)


def pseudonym(session_id: Column, entity_type: Column, text: Column) -> Column:
    """The same value in the same session always gets the same stand-in."""
    digest = F.sha2(F.concat_ws(":", session_id, entity_type, text), 256)
    number = F.lpad(hex_modulo(digest, PSEUDONYM_NUMBERS).cast("string"), 4, "0")
    out = F.concat(F.lit("[PSEUDO_"), entity_type, F.lit("_"), number, F.lit("]"))
    for name, pool in PSEUDONYM_POOLS.items():
        choice = F.get(F.array(*map(F.lit, pool)), hex_modulo(digest, len(pool)).cast("int"))
        out = F.when(entity_type == name, choice).otherwise(out)
    return out


def generalize(entity_type: Column, text: Column) -> Column:
    """A coarser value of the same kind."""
    kind = F.upper(entity_type)

    def month(sep):
        parts = F.split(text, sep)
        second = F.when(F.length(F.get(parts, F.lit(0))) == 4, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
        return F.concat(F.get(parts, F.lit(0)), F.lit("/"), second, F.lit(" (month)"))

    octets = F.split(text, r"\.")
    network = F.concat(F.get(octets, F.lit(0)), F.lit("."), F.get(octets, F.lit(1)), F.lit(".0.0/16"))
    last4 = F.right(text, F.lit(4))
    long4, long8 = F.length(text) >= 4, F.length(text) >= 8
    return (
        F.when(kind == "DATE", F.when(F.contains(text, F.lit("-")), month("-"))
               .when(F.contains(text, F.lit("/")), month("/")).otherwise("[DATE_RANGE]"))
        .when(kind == "CREDIT_CARD",
              F.when(long4, F.concat(F.lit("****-****-****-"), last4)).otherwise("[CARD_GENERALIZED]"))
        .when(kind == "PHONE", F.when(long4, F.concat(F.lit("(***) ***-"), last4)).otherwise("[PHONE_GENERALIZED]"))
        .when(kind == "EMAIL", F.when(F.contains(text, F.lit("@")), F.concat(
            F.lit("***@"), F.get(F.split(text, "@"), F.lit(1)))).otherwise("[EMAIL_GENERALIZED]"))
        .when(kind == "IP_ADDRESS", F.when(F.size(octets) == 4, network).otherwise("[IP_GENERALIZED]"))
        .when(kind == "PERSON_NAME", "[PERSON]")
        .when(kind == "IBAN", F.when(long8, F.concat(F.left(text, F.lit(4)), F.lit("****"), last4))
              .otherwise("[IBAN_GENERALIZED]"))
        .when(kind == "API_KEY", F.when(long4, F.concat(F.left(text, F.lit(4)), F.lit("..."))).otherwise(
            "[KEY_GENERALIZED]"))
        .otherwise(F.concat(F.lit("["), kind, F.lit("_GENERALIZED]")))
    )


def encode(session_id: Column, text: Column) -> Column:
    """Reversible URL-safe base64 of session and value.  An encoding, not a cipher."""
    raw = F.encode(F.concat(session_id, F.lit(":"), text), "UTF-8")
    return F.concat(F.lit("ENC:"), F.translate(F.base64(raw), "+/=\r\n", "-_"))


def decode(value: Column) -> Column:
    """What ``encode`` hid, or null for anything it did not write."""
    body = F.translate(F.substring(value, 5, 1 << 30), "-_", "+/")
    width = F.ceil(F.length(body) / 4).cast("int") * 4
    padded = F.rpad(body, width, F.lit("="))
    plain = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    cut = F.instr(plain, ":")
    return F.when(F.startswith(value, F.lit("ENC:")) & (cut > 0), F.substring(plain, cut + 1, F.length(plain)))


def synthesize(entity_type: Column, seed: Column, position: Column) -> Column:
    """A made-up value of the same kind.  Drawn from hashes of the text ``seed`` and
    the position and not at random, so that a repeated task writes the same text."""
    kind, place = F.upper(entity_type), position.cast("string")

    def draw(n: int, low: int, high: int) -> Column:
        digest = F.sha2(F.concat_ws(":", seed, place, F.lit(str(n))), 256)
        return hex_modulo(digest, high - low + 1) + low

    def pick(n: int, words) -> Column:
        return F.get(F.array(*map(F.lit, words)), draw(n, 0, len(words) - 1).cast("int"))

    hex_digits = F.substring(F.sha2(F.concat_ws(":", seed, place), 256), 1, 16)
    forms = {
        "PERSON_NAME": F.concat_ws(" ", pick(1, SYNTHETIC_FIRST_NAMES), pick(2, SYNTHETIC_LAST_NAMES)),
        "EMAIL": F.format_string("user%d@%s", draw(1, 1000, 9999), pick(2, SYNTHETIC_DOMAINS)),
        "PHONE": F.format_string("(%d) %d-%d", draw(1, 200, 999), draw(2, 100, 999), draw(3, 1000, 9999)),
        "SSN": F.format_string("%d-%d-%d", draw(1, 100, 999), draw(2, 10, 99), draw(3, 1000, 9999)),
        "CREDIT_CARD": F.format_string(
            "%d-%d-%d-%d", draw(1, 4000, 4999), draw(2, 1000, 9999), draw(3, 1000, 9999), draw(4, 1000, 9999)
        ),
        "IP_ADDRESS": F.format_string("%d.%d.%d.%d", draw(1, 10, 192), draw(2, 0, 255), draw(3, 0, 255), draw(4, 1, 254)),
        "IBAN": F.format_string("XX%dBANK%d", draw(1, 10, 99), draw(2, 10_000_000, 99_999_999)),
        "API_KEY": F.concat(F.lit("sk-fake-"), hex_digits),
        "DATE": F.format_string("2025-%02d-%02d", draw(1, 1, 12), draw(2, 1, 28)),
        "PASSPORT": F.format_string("X%d", draw(1, 10_000_000, 99_999_999)),
        "DRIVERS_LICENSE": F.format_string("D%d %d %d", draw(1, 1000, 9999), draw(2, 1000, 9999), draw(3, 10_000, 99_999)),
    }
    out = F.concat(F.lit("[SYNTH_"), kind, F.lit("]"))
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def splice(text: Column, spans: Column, replacement) -> Column:
    """``text`` with every span of ``spans`` (ordered, disjoint, with ``start``
    and ``end``) replaced by ``replacement(span)``.

    Offsets count characters.  In a text of one-byte characters they are byte
    offsets too, and slicing bytes does not walk the text from its beginning.
    """
    raw = F.encode(text, "UTF-8")
    one_byte = F.octet_length(text) == F.length(text)

    def cut(start, length):
        return F.when(one_byte, F.decode(F.substring(raw, start + 1, length), "UTF-8")).otherwise(
            F.substring(text, start + 1, length)
        )

    def piece(span, i):
        left = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(cut(left, span["start"] - left), replacement(span))

    tail_from = F.get(spans, F.size(spans) - 1)["end"]
    pieces = F.concat(F.transform(spans, piece), F.array(cut(tail_from, F.length(text) - tail_from)))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def mapping(pairs: Column) -> Column:
    """Map from replacement to original.  Where several originals share a
    replacement the leftmost one stays.  ``pairs`` has fields ``replacement``,
    ``start`` and ``original``."""
    ordered = F.array_sort(
        F.transform(pairs, lambda p: F.struct(p["replacement"].alias("r"), p["start"].alias("s"), p["original"].alias("o")))
    )
    first = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["r"] != p["r"]))
    return F.map_from_arrays(F.transform(first, lambda p: p["r"]), F.transform(first, lambda p: p["o"]))
