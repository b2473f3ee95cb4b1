"""Regex dialect: the registry is written for Python's ``re``; Spark runs Java.

``\\d \\s \\w \\b`` mean Unicode classes in Python ``str`` patterns.  Java's
counterparts differ in corners (combining marks, superscripts, file separators),
so the classes are spelled out and both engines accept the same text.

Java's own ``\\b`` is several times faster than one that is spelled out.  It may
be used on text whose few characters that the engines disagree about have been
swapped by ``plain_words``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGIT = r"\p{Nd}"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_WORD = r"\p{L}\p{N}_"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


# Characters that count as part of a word in Python and not in Java, and the reverse.
# A range comes first, so that most characters are told apart by one comparison.
_WORD_IN_PYTHON = r"[\u00B2\u00B3\u00B9\u00BC-\u00BE\u02B0-\x{10FFFF}&&[\p{Nl}\p{No}]]"
_WORD_IN_JAVA = (
    r"[\u02B0-\x{10FFFF}&&[\p{M}\p{Pc}\u200C\u200D\u24B6-\u24E9"
    r"\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]]"
)
_SOME_LETTER, _NO_LETTER = "\u01c2", "\ufffd"


def plain_words(text: Column) -> Column:
    """``text`` with every character whose word-ness is disputed swapped for an
    undisputed one.  Offsets stay; a text of one-byte characters comes back as it is."""
    swapped = F.regexp_replace(F.regexp_replace(text, _WORD_IN_PYTHON, _SOME_LETTER), _WORD_IN_JAVA, _NO_LETTER)
    disputed = F.rlike(text, F.lit(f"{_WORD_IN_PYTHON}|{_WORD_IN_JAVA}"))
    return F.when((F.octet_length(text) > F.length(text)) & disputed, swapped).otherwise(text)


def to_java(pattern: str, ignore_case: bool = False, plain: bool = False) -> str:
    """A Java pattern that accepts what ``pattern`` accepts in Python, on any text
    or, with ``plain``, on the result of ``plain_words``.

    Capturing groups become plain groups: only the whole match is ever used.  Patterns
    that refer back to a group, or name one, are refused.
    """
    if re.search(r"(?<!\\)(?:\\\\)*(?:\\[1-9]|\(\?P)", pattern):
        raise ValueError(f"back references and named groups are not supported: {pattern}")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "d":
                out.append(_DIGIT)
            elif nxt in "sw":
                chars = _SPACE if nxt == "s" else _WORD
                out.append(chars if in_class else f"[{chars}]")
            elif nxt in "DSW" and not in_class:
                out.append("[^" + {"D": _DIGIT, "S": _SPACE, "W": _WORD}[nxt] + "]")
            elif nxt == "b" and not in_class:
                out.append(r"\b" if plain else _BOUNDARY)
            elif nxt in "\"'/":
                out.append(nxt)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and in_class:
            out.append("\\")  # Java would open a nested class
        elif ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "&" and in_class:
            out.append("\\")
        elif ch == "(" and not in_class and pattern[i + 1 : i + 2] != "?":
            ch = "(?:"
        out.append(ch)
        i += 1
    if "(?<" in "".join(out):
        # Java looks behind by half characters unless the pattern holds a wide one: this one, zero times.
        out.append("\U0001d7ce{0}")
    # (?d): only a line feed ends a line, as in Python.
    return f"(?d{'iu' if ignore_case else ''}{'U' if plain else ''})" + "".join(out)


def strip(text: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")
