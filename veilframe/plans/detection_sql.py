"""Detection written a second time, as DuckDB SQL, to check the Spark results.

Nothing is shared with the Spark expressions but the fixed values of the
registry.  DuckDB's regex engine has no lookaround, so digit runs are put
between two marks first and "not next to a digit" becomes "at a mark".
"""

from __future__ import annotations

from collections.abc import Iterable

from veilframe.functions.registry import NEGATIVE_KEYWORDS, select

_S = "\ue000"  # around a hit
_L, _R = "\ue001", "\ue002"  # before and after a run of digits


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words: Iterable[str]) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]::VARCHAR[]"


def _digits(sep: str, *groups: str) -> str:
    """Digit groups that may be parted by one character of ``sep``."""
    return f"(?:{_R}[{sep}]{_L})?".join(groups)


# Word boundaries are ASCII there too: hits glued to an accented letter are dropped afterwards.
_B = r"\b"

_SEP = r"\s\-."
_PHONE_TAIL = (
    rf"[2-9]\d{{2}}(?:{_R}\)?[{_SEP}]?{_L})?[2-9]\d{{2}}(?:{_R}[{_SEP}]{_L})?\d{{4}}{_R}"
)
_CARD = r"\s\-"

# Lookaround patterns over text with marked digit runs; group 1 stays outside the hit.
_MARKED = {
    "PHONE": (
        rf"((?:^|[^{_R}]))(\+{_L}1(?:{_R}[{_SEP}]?\(?{_L})?{_PHONE_TAIL}|\({_L}{_PHONE_TAIL})"
        rf"|({_L}(?:1(?:{_R}[{_SEP}]?\(?{_L})?)?{_PHONE_TAIL})",
        rf"\1{_S}\2\3{_S}",
    ),
    "SSN": (
        rf"({_L}(?:00[1-9]|0[1-9]\d|[1-578]\d\d|6[0-57-9]\d|66[0-57-9]){_R}-{_L}(?:0[1-9]|[1-9]\d){_R}-"
        rf"{_L}(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{{3}}){_R})",
        rf"{_S}\1{_S}",
    ),
    "CREDIT_CARD_PAN": (
        rf"({_L}(?:"
        + "|".join(
            [
                _digits(_CARD, r"(?:4\d{3}|5[1-5]\d{2}|6011|65\d{2}|2131|1800|35\d{2})", *[r"\d{4}"] * 3),
                _digits(_CARD, r"3[47]\d{2}", r"\d{6}", r"\d{5}"),
                _digits(_CARD, r"35\d{3}", *[r"\d{4}"] * 3),
            ]
        )
        + rf"){_R})",
        rf"{_S}\1{_S}",
    ),
    "BANK_ACCOUNT": (rf"({_L}\d{{8,17}}{_R})", rf"{_S}\1{_S}"),
    "ACCOUNT_NO": (rf"({_L}\d{{10,14}}{_R})", rf"{_S}\1{_S}"),
}
_PLAIN = {"USERNAME": (r"@([A-Za-z_][A-Za-z0-9_.]{2,30}\b)", rf"@{_S}\1{_S}")}

_LUHN = (
    "(SELECT len(d) >= 2 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: "
    "CASE WHEN i % 2 = 0 THEN (d[i] * 2) // 10 + (d[i] * 2) % 10 ELSE d[i] END)) % 10 = 0 FROM "
    "(SELECT list_reverse(list_transform(regexp_extract_all(txt, '[0-9]'), lambda x: x::INT)) AS d))"
)


def _glued(char: str) -> str:
    return f"(unicode({char}) > 127 AND regexp_matches({char}, '[\\pL\\pN]'))"


def _hits(idx: int, entity) -> str:
    source = "tm" if entity.entity_type in _MARKED else "t"
    pattern, repl = _MARKED.get(entity.entity_type) or _PLAIN.get(
        entity.entity_type, (entity.pattern.replace(r"\"", '"').replace(r"\'", "'"), rf"{_S}\0{_S}")
    )
    flags = "gi" if entity.ignore_case else "g"
    ready = f"string_split(regexp_replace({source}, {quote(pattern)}, {quote(repl)}, '{flags}'), '{_S}')"
    test = f"regexp_matches({source}, {quote(pattern)}{', ' + quote('i') if entity.ignore_case else ''})"
    return f"SELECT {idx} AS idx, k, {ready} AS p FROM marked WHERE {test}"


def entities_cte(
    table: str = "documents", key: str = "doc_id", text: str = "text", types: Iterable[str] | None = None
) -> str:
    """``WITH RECURSIVE ... ents AS (...)``: one row per entity, columns ``k``
    (the key), ``ent``, ``txt``, ``s``, ``e``, ``conf``, ``cat``, ``reg``,
    ``act``, ``risk``."""
    rows = select(types)
    hits = "\n  UNION ALL ".join(_hits(i, e) for i, e in enumerate(rows))
    registry = ",\n    ".join(
        f"({i}, {quote(e.entity_type)}, {quote(e.category)}, {e.base_confidence}::DOUBLE, "
        f"{'1.0' if e.strict else '0.9'}::DOUBLE, {_list(e.keywords)}, "
        f"{_list(NEGATIVE_KEYWORDS.get(e.entity_type, ()))}, {quote(e.regulatory_basis)}, "
        f"{quote(e.default_action)}, {quote(e.risk_level)}, {e.pattern.startswith(_B)}, {e.pattern.endswith(_B)})"
        for i, e in enumerate(rows)
    )
    return f"""WITH RECURSIVE
src AS (SELECT {key} AS k, {text} AS t FROM {table}),
marked AS (SELECT k, t, regexp_replace(t, '([0-9]+)', '{_L}\\1{_R}', 'g') AS tm FROM src),
reg(idx, ent, cat, base, form, kw, neg, reg, act, risk, b0, b1) AS (VALUES
    {registry}),
pieces AS ({hits}),
cleaned AS (
  SELECT idx, k, list_transform(p, lambda x: replace(replace(x, '{_L}', ''), '{_R}', '')) AS p FROM pieces),
spread AS (SELECT idx, k, p, unnest(range(2, len(p) + 1, 2)) AS i FROM cleaned),
spans AS (
  SELECT idx, k, p[i] AS txt, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::INT AS s FROM spread),
windows AS (
  SELECT idx, k, txt, s, s + length(txt) AS e,
         lower(substr(t, greatest(s - 80, 0) + 1, s + length(txt) + 80 - greatest(s - 80, 0))) AS win
  FROM spans JOIN src USING (k) JOIN reg USING (idx)
  WHERE NOT (b0 AND {_glued('substr(t, s, 1)')}) AND NOT (b1 AND {_glued('substr(t, s + length(txt) + 1, 1)')})),
counted AS (
  SELECT w.*, reg.*, len(list_filter(kw, lambda x: contains(win, x))) AS nk,
         len(list_filter(neg, lambda x: contains(win, x))) AS nn
  FROM windows w JOIN reg USING (idx)),
scored AS (
  SELECT k, idx, ent, cat, reg, act, risk, txt, s, e, round((base *
      CASE WHEN nk >= 2 THEN 1.15::DOUBLE WHEN nk = 1 THEN 1.08::DOUBLE ELSE 0.85::DOUBLE END *
      CASE WHEN nn > 0 THEN greatest(0.5::DOUBLE, 1 - 0.15::DOUBLE * nn) ELSE 1 END * form)::DECIMAL(38, 17), 4)::DOUBLE AS raw_conf
  FROM counted WHERE ent <> 'CREDIT_CARD_PAN' OR {_LUHN}),
ranked AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, raw_conf)) AS conf,
         row_number() OVER (PARTITION BY k ORDER BY s - e, -least(1.0, raw_conf), s, idx) AS rk
  FROM scored),
greedy AS (
  SELECT k, 1 AS rk, [struct_pack(s := s, e := e, rk := rk)] AS taken FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.k, r.rk::INT, CASE WHEN len(list_filter(g.taken, lambda x: r.s < x.e AND r.e > x.s)) > 0 THEN g.taken
                     ELSE list_append(g.taken, struct_pack(s := r.s, e := r.e, rk := r.rk)) END
  FROM greedy g JOIN ranked r ON r.k = g.k AND r.rk = g.rk + 1),
final AS (SELECT k, max_by(taken, rk) AS taken FROM greedy GROUP BY k),
kept AS (SELECT k, unnest(list_transform(taken, lambda x: x.rk)) AS rk FROM final),
ents AS (
  SELECT k, ent, txt, s, e, conf, cat, reg, act, risk FROM kept JOIN ranked USING (k, rk))"""


def spliced(replacement: str, cte: str | None = None, joins: str = "", table: str = "documents", key: str = "doc_id",
            text: str = "text") -> str:
    """``k, sanitized, pairs``: texts with every entity replaced by the SQL
    expression ``replacement`` over ``ents`` (as ``x``), and the list of
    replacements with the leftmost original of each."""
    return f"""{cte or entities_cte(table, key, text)},
repl AS (SELECT x.k, x.s, x.e, x.txt, {replacement} AS r FROM ents x {joins}),
gaps AS (SELECT repl.*, t, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS prev FROM repl JOIN src USING (k)),
glued AS (SELECT k, string_agg(substr(t, prev + 1, s - prev) || r, '' ORDER BY s) || substr(any_value(t), max(e) + 1) AS sanitized
          FROM gaps GROUP BY k),
firsts AS (SELECT k, r, min_by(txt, s) AS txt FROM repl GROUP BY k, r),
maps AS (SELECT k, string_agg(r || '=' || txt, '; ' ORDER BY r) AS pairs, count(*) AS n FROM firsts GROUP BY k),
result AS (SELECT src.k, t, coalesce(sanitized, t) AS sanitized, coalesce(pairs, '') AS pairs, coalesce(n, 0) AS n
           FROM src LEFT JOIN glued USING (k) LEFT JOIN maps USING (k))
SELECT * FROM result"""
