"""Detection in a few lines of plain Python, to compare with."""

from __future__ import annotations

import re

from veilframe.functions.registry import CONTEXT_CHARS, NEGATIVE_KEYWORDS, REGISTRY, confidence_table

COMPILED = [re.compile(e.pattern, re.I if e.ignore_case else 0) for e in REGISTRY]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdecimal()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return len(digits) > 1 and sum(doubled) % 10 == 0


def entities(text: str) -> list[tuple]:
    """``(type, text, start, end, confidence)`` by offset."""
    ranked = []
    for position, (entity, pattern) in enumerate(zip(REGISTRY, COMPILED)):
        table = confidence_table(entity)
        for match in pattern.finditer(text):
            if entity.entity_type == "CREDIT_CARD_PAN" and not luhn(match[0]):
                continue
            start, end = match.span()
            around = text[max(0, start - CONTEXT_CHARS) : end + CONTEXT_CHARS].lower()
            near = min(2, sum(word in around for word in entity.keywords))
            against = sum(word in around for word in NEGATIVE_KEYWORDS.get(entity.entity_type, ()))
            confidence = table[near][against]
            ranked.append((start - end, -confidence, start, position, (entity.entity_type, match[0], start, end, confidence)))
    taken: list[tuple] = []
    free = bytearray(b"\x01") * len(text)
    for *_, hit in sorted(ranked):
        if all(free[hit[2] : hit[3]]):
            free[hit[2] : hit[3]] = bytes(hit[3] - hit[2])
            taken.append(hit)
    return sorted(taken, key=lambda h: h[2])
