"""Detection as Column expressions: text in, array of entity structs out.

The steps, all inside one row and all on the JVM:

1. every pattern that can match marks its hits in the text and splits there,
   so hits and the gaps between them alternate (``_pieces``);
2. running sums over the pieces give offsets, and the pieces around a hit its 80
   characters of context (``_locate``), so no substring walks the text again;
3. keywords in that window pick the confidence from a precomputed table;
4. overlapping hits are resolved island by island (``_resolve``).

Work per text is about linear in its length plus its hits.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import folding, prefilter
from veilframe.functions.dialect import plain_words, to_java
from veilframe.functions.prefilter import literal
from veilframe.functions.registry import CONTEXT_CHARS, NEGATIVE_KEYWORDS, Entity, confidence_table

ENTITY_TYPE = (
    "struct<entity_type:string,original_text:string,start:int,end:int,confidence:double,"
    "category:string,regulatory_basis:string,default_action:string,risk_level:string>"
)
ENTITIES_TYPE = f"array<{ENTITY_TYPE}>"

_MARK = "\ue000"
_HIT = "struct<start:int,end:int,idx:int,conf:double,txt:string>"


def _metadata(registry: Sequence[Entity]) -> Column:
    """The registry as one constant array, looked up by position."""
    rows = [
        {
            "entity_type": e.entity_type,
            "category": e.category,
            "regulatory_basis": e.regulatory_basis,
            "default_action": e.default_action,
            "risk_level": e.risk_level,
            "keywords": [k.lower() for k in e.keywords],
            "negatives": list(NEGATIVE_KEYWORDS.get(e.entity_type, ())),
            "confidence": confidence_table(e),
        }
        for e in registry
    ]
    schema = (
        "array<struct<entity_type:string,category:string,regulatory_basis:string,default_action:string,"
        "risk_level:string,keywords:array<string>,negatives:array<string>,confidence:array<array<double>>>>"
    )
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _pieces(registry: Sequence[Entity], text: str = "_text") -> Column:
    """``array<struct<idx, parts>>``: one element per type found, its parts being
    gap, hit, right context, gap, hit, right context, ..., gap.

    Written as one SQL expression: 57 patterns are quicker to parse than to
    assemble call by call.
    """
    found = []
    for idx, entity in enumerate(registry):
        pattern = to_java(entity.pattern, entity.ignore_case, plain=True)
        conditions = [f"rlike({text}, {literal(pattern)})"]
        if _KNOWN_PATTERNS.get(entity.entity_type) == entity.pattern:
            need = prefilter.NEEDS.get(entity.entity_type, prefilter.Need())
            conditions = prefilter.may_match(need) + conditions
        with_context = f"(?:{pattern})(?=((?s:.{{0,{CONTEXT_CHARS}}})))"
        marked = f"regexp_replace({text}, {literal(with_context)}, '{_MARK}$0{_MARK}$1{_MARK}')"
        found.append(
            f"CASE WHEN {' AND '.join(conditions)} "
            f"THEN named_struct('idx', {idx}, 'parts', split({marked}, '{_MARK}')) END"
        )
    return F.expr(f"array_compact(array({', '.join(found)}))")


def _locate(found: Column) -> Column:
    """The hits of one type with offsets and context window."""
    parts = found.parts
    last = ((F.size(parts) - 1) / 3).cast("int") - 1

    def gap(k):
        return F.get(parts, k * 3)

    def hit(k):
        return F.get(parts, k * 3 + 1)

    def left_of(k, hits):
        """The end of what stands between the start of hit ``k - hits`` and hit ``k``."""
        earlier = F.filter(F.sequence(k - hits, k - 1), lambda j: j >= 0)
        ends = F.transform(
            earlier, lambda j: F.concat(F.right(gap(j), F.lit(CONTEXT_CHARS)), F.right(hit(j), F.lit(CONTEXT_CHARS)))
        )
        return F.right(F.concat(F.array_join(ends, ""), gap(k)), F.lit(CONTEXT_CHARS))

    def context(k):
        # Mostly the gap alone is long enough; else the hits before it are put back, each of
        # which has a character at least.
        near = F.when(F.length(gap(k)) >= CONTEXT_CHARS, F.right(gap(k), F.lit(CONTEXT_CHARS))).otherwise(left_of(k, 12))
        full = folding.bind(near, lambda n: F.when(F.length(n) >= CONTEXT_CHARS, n).otherwise(left_of(k, CONTEXT_CHARS)))
        return F.lower(F.concat(full, hit(k), F.get(parts, k * 3 + 2)))

    numbers = F.sequence(F.lit(0), last)
    offsets = folding.sum_before(F.transform(numbers, lambda k: F.length(gap(k)) + F.length(hit(k))))

    def raw(before, k):
        start = before + F.length(gap(k))
        return F.struct(
            start.alias("start"),
            (start + F.length(hit(k))).alias("end"),
            found.idx.alias("idx"),
            hit(k).alias("txt"),
            context(k).alias("win"),
        )

    return F.transform(offsets, raw)


def _hits_with(words: Column, window: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(window, w)))


def _score(raw: Column, metadata: Column) -> Column:
    rule = F.get(metadata, raw.idx)
    row = F.get(rule["confidence"], F.least(_hits_with(rule["keywords"], raw.win), F.lit(2)))
    return F.struct(
        raw.start.alias("start"),
        raw.end.alias("end"),
        raw.idx.alias("idx"),
        F.get(row, _hits_with(rule["negatives"], raw.win)).alias("conf"),
        raw.txt.alias("txt"),
    )


@cache
def _foreign_digits() -> tuple[str, str]:
    """The decimal digits of other scripts, and the ASCII digits they stand for."""
    digits = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def luhn_valid(number: Column) -> Column:
    """Mod-10 check over the decimal digits of any script; fewer than two fail."""
    plain = F.regexp_replace(number, r"[^0-9\p{Nd}]", "")
    plain = F.when(F.rlike(plain, F.lit("[^0-9]")), F.translate(plain, *_foreign_digits())).otherwise(plain)
    return (F.length(plain) >= 2) & F.call_function("luhn_check", plain)


def _resolve(hits: Column) -> Column:
    """Of overlapping hits keep the longest, then the surest, then the first.

    Hits are cut into islands that do not touch each other; the choice is made
    inside each island, which holds a handful of hits whatever the text.
    """

    def rank(hit):
        return F.struct((hit.start - hit.end).alias("k1"), (-hit.conf).alias("k2"), hit.start.alias("k3"),
                        hit.idx.alias("k4"), hit.alias("hit"))

    def choose(island):
        best_first = F.transform(F.array_sort(F.transform(island, rank)), lambda r: r.hit)
        kept = F.aggregate(
            best_first,
            folding.empty(_HIT),
            lambda kept, h: F.when(F.exists(kept, lambda k: (h.start < k.end) & (h.end > k.start)), kept).otherwise(
                F.concat(kept, F.array(h))
            ),
        )
        return F.when(F.size(island) < 2, island).otherwise(F.array_sort(kept))

    def resolve(ordered):
        ends = F.transform(ordered, lambda h: h.end)

        def split(reach):
            starts = F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda i: (i == 0) | (F.get(ordered, i).start >= F.get(reach, i)),
            )
            return folding.bind(
                starts,
                lambda cut: F.transform(
                    cut, lambda c, j: F.slice(ordered, c + 1, F.coalesce(F.get(cut, j + 1), F.size(ordered)) - c)
                ),
            )

        return F.flatten(F.transform(folding.bind(folding.max_before(ends), split), choose))

    return F.when(F.size(hits) < 2, hits).otherwise(folding.bind(F.array_sort(hits), resolve))


def _publish(hit: Column, text: Column, metadata: Column) -> Column:
    rule = F.get(metadata, hit.idx)
    # A text in which characters were swapped before matching shows its own.
    own = F.when(F.col("_text") != text, F.substring(text, hit.start + 1, hit.end - hit.start))
    return F.struct(
        rule["entity_type"].alias("entity_type"),
        own.otherwise(hit.txt).alias("original_text"),
        hit.start.alias("start"),
        hit.end.alias("end"),
        hit.conf.alias("confidence"),
        rule["category"].alias("category"),
        rule["regulatory_basis"].alias("regulatory_basis"),
        rule["default_action"].alias("default_action"),
        rule["risk_level"].alias("risk_level"),
    )


def views(registry: Sequence[Entity], text: Column) -> list[dict[str, Column]]:
    """The columns that ``entities`` reads, in the order in which they build on each
    other, to be computed once per row."""
    unmarked = F.replace(text, F.lit(_MARK), F.lit("\ufffd"))
    return [
        {"_text": unmarked},
        {"_text": plain_words(F.col("_text"))},
        *prefilter.views([e.entity_type for e in registry]),
    ]


def entities(registry: Sequence[Entity], text: Column) -> Column:
    """All entities of a text, by offset; needs the columns of ``views``."""
    metadata = _metadata(registry)
    raw = F.flatten(F.transform(_pieces(registry), _locate))
    cards = [i for i, e in enumerate(registry) if e.entity_type == "CREDIT_CARD_PAN"]
    if cards:
        raw = F.filter(raw, lambda r: (r.idx != F.lit(cards[0])) | luhn_valid(r.txt))
    scored = F.transform(raw, lambda r: _score(r, metadata))
    kept = folding.bind(scored, _resolve)
    published = F.transform(kept, lambda h: _publish(h, text, metadata))
    return F.coalesce(published, folding.empty(ENTITY_TYPE)).cast(ENTITIES_TYPE)


def _known_patterns() -> dict[str, str]:
    from veilframe.functions.registry import REGISTRY

    return {e.entity_type: e.pattern for e in REGISTRY}


_KNOWN_PATTERNS = _known_patterns()
