"""Cheap necessary conditions, so that most patterns never run on most texts.

Running every registry pattern over every text is what detection costs.  Four
views of a text answer "can this pattern match at all?" much faster:

* the text itself, searched for a telling literal;
* the *folded* text (a blank, then the text in lower case), searched for the
  keywords of the patterns that ignore case;
* the *marks*: all that is left of the text when only ``@ $ _ = + : / -`` stay;
* the *shape*: every stretch that is neither a capital nor a digit becomes one
  blank, which leaves a few percent of ordinary prose.

Keywords that begin a word are also searched for all types at once, which tells
most texts apart in one go.

A ``Need`` may let a text through in vain, but must never hold one back that
the pattern matches; ``tests/test_prefilter.py`` checks that with generated
matches.  Types without an entry always run their pattern.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Need(NamedTuple):
    """Java patterns that must all be found, in the named view.  ``words`` are
    beginnings of words of which the folded text must hold one, ``holds`` plain
    strings of which it must hold one: they are found without a pattern."""

    shape: str = ""
    marks: str = ""
    holds: str = ""
    text: str = ""
    words: str = ""
    folded: str = ""


_D = r"\p{Nd}"


def _word_start(words: str) -> str:
    """One of ``words`` at the start of a word, grouped by first letter.

    Where no letters of ``words`` follow, which is what most words of a text show, the
    groups are not tried one after the other."""
    by_letter: dict[str, list[str]] = {}
    for word in words.split():
        by_letter.setdefault(word[0], []).append(word[1:])
    letters = ("".join(sorted(set(column))) for column in zip(*words.split()))
    ahead = "".join(f"[{column}]" for column, _ in zip(letters, range(3)))
    return f"[^a-z](?={ahead})(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by_letter.items()) + ")"


NEEDS: dict[str, Need] = {
    "FULL_NAME": Need(shape="[MDPRCSH] [A-Z]", text=r"[MDPRCSH](?:rs?|s|iss|rof|ev|apt|gt|on)\.?[^A-Za-z.]+[A-Z]"),
    "EMAIL": Need(marks="@"),
    "PHONE": Need(shape=rf"[2-9]{_D}{{2}} ?[2-9]{_D}{{2}} ?{_D}{{4}}"),
    "SSN": Need(shape=rf"{_D}{{3}} {_D}{{2}} {_D}{{4}}"),
    "PASSPORT_NO": Need(shape=rf"[A-Z]{_D}{{6}}"),
    "DRIVERS_LICENSE": Need(shape=rf"[A-Z]{_D}{{4}} ?{_D}{{4}} ?{_D}{{4}}"),
    "IP_ADDRESS": Need(shape=rf"{_D} {_D}{{1,3}} {_D}{{1,3}} {_D}"),
    "DATE_OF_BIRTH": Need(shape=rf"[0-3]{_D} [0-3]{_D} (?:19|20){_D}|(?:19|20){_D}{{2}} [0-3]{_D} [0-3]{_D}"),
    "MAC_ADDRESS": Need(marks=r"[:\-]{5}", text=r"[:\-][0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}[:\-]"),
    "VIN": Need(shape="[A-Z0-9]{17}"),
    "NATIONAL_ID": Need(shape=rf"{_D}{{3}} ?{_D}{{3}} ?{_D}{{3}} ?{_D}{{2}}"),
    "TAX_ID": Need(shape=rf"{_D}{{2}} {_D}{{7}}"),
    "BIOMETRIC_ID": Need(shape="BIOM? ?[A-Z0-9]{8}"),
    "COOKIE_ID": Need(marks="_=", text="_(?:ga|fbp|gcl_aw|id)="),
    "DEVICE_ID": Need(marks="----", text="-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-"),
    "USERNAME": Need(marks="@", text="@[A-Za-z_]"),
    "PATIENT_ID": Need(shape=rf"P(?:AT|T) ?{_D}{{6}}"),
    "MRN": Need(shape=rf"MRN? ?{_D}{{5}}"),
    "DIAGNOSIS_CODE": Need(shape=rf"[A-TV-Z]{_D}{{2}}"),
    "MEDICATION_NAME": Need(
        words=(
            "metf metop mont morph lisin losar levoth loraz atorva atenol amox amlod acetam aspir albut alpraz "
            "omepr oxyco simva sertr gabap hydroc panto predn furos fluox fent warf insul ibupr clopi cital clonaz "
            "tamsul trazo trama dulox diaze escit bupro"
        )
    ),
    "PROVIDER_NPI": Need(shape=rf"{_D}{{10}}"),
    "INSURANCE_ID": Need(shape="(?:INS|INSUR|POLICY) ?[A-Z0-9]{6}"),
    "DATE_OF_SERVICE": Need(shape=rf"[0-3]{_D} (?:19|20){_D}", words="dos date"),
    "BLOOD_TYPE": Need(shape="[ABO]", marks=r"[+\-]", text=r"[ABO][+\-]"),
    "GENETIC_MARKER": Need(shape=rf"{_D}{{4}}|BRCA|HLA|CYP"),
    "LAB_RESULT": Need(
        shape=_D,
        words="wbc rbc hgb hct hdl plt psa bun bnp crp a1c alt ast tsh gfr ldl",
    ),
    "CREDIT_CARD_PAN": Need(
        shape=rf"[1-6]{_D}{{3}} ?{_D}{{4}} ?{_D}{{4}} ?{_D}{{4}}|3{_D}{{3}} ?{_D}{{6}} ?{_D}{{5}}"
    ),
    "CVV": Need(shape=rf"{_D}{{3}}", folded="c(?:v[vc]|id|ode)"),
    "CARD_EXPIRY": Need(shape=rf"[01]{_D} [23]{_D}"),
    "CARDHOLDER_NAME": Need(holds="card"),
    "BANK_ACCOUNT": Need(shape=rf"{_D}{{8}}"),
    "ROUTING_NUMBER": Need(shape=rf"{_D}{{9}}"),
    "SWIFT_BIC": Need(shape="[A-Z]{6}[A-Z0-9]{2}"),
    "IBAN": Need(shape=rf"[A-Z]{{2}}{_D}{{2}}[A-Z0-9]{{4}}{_D}{{7}}"),
    "ACCOUNT_NO": Need(shape=rf"{_D}{{10}}"),
    "CUSIP": Need(shape="[0-9]{3}[A-Z0-9]{3}[0-9]{3}"),
    "ISIN": Need(shape="[A-Z]{2}[A-Z0-9]{9}[0-9]"),
    "SEDOL": Need(shape="[B-DF-HJ-NP-TV-Z0-9]{6}[0-9]"),
    "TICKER_SYMBOL": Need(holds="ticker symbol stock", text="[ts](?:icker|ymbol|tock)[^a-z]"),
    "TRADE_SECRET_MARKER": Need(words="confidential secret proprietary restricted internal distribution"),
    "SWIFT_BIC_FIN": Need(shape="[A-Z]{6}[A-Z0-9]{2}"),
    "LEI": Need(shape=rf"[0-9A-Z]{{4}}00[A-Z0-9]{{12}}{_D}{{2}}"),
    "API_KEY": Need(marks="-|__", text="sk-[A-Za-z0-9]|[rp]k_live_"),
    "SECRET_TOKEN": Need(folded="[tspab](?:oken|ecret|assword|pi_?key|uth|earer)"),
    "PRIVATE_KEY": Need(marks="-----", text="-----BEGIN "),
    "AWS_ACCESS_KEY": Need(shape="AKIA"),
    "GCP_SERVICE_KEY": Need(marks="-@", text=r"\.iam\.gserviceaccount\.com"),
    "GITHUB_TOKEN": Need(marks="_", text="gh[pousr]_"),
    "JWT_TOKEN": Need(shape="J", text="eyJ"),
    "CONNECTION_STRING": Need(marks="://|=", folded="[:re](?://|=)"),
    "PASSWORD_HASH": Need(marks=r"\$[^$]*\$[^$]*\$"),
    "EMPLOYEE_ID": Need(shape=rf"(?:EMP|EID|E) ?{_D}{{5}}"),
    "CONTRACT_REF": Need(shape="(?:CON|CTR) ?[A-Z0-9]{4}"),
    "PROJECT_CODENAME": Need(holds="project codename initiative", folded="[pci](?:roject|odename|nitiative)[^a-z]"),
    "INTERNAL_URL": Need(marks="://"),
    "DOCUMENT_CLASSIFICATION": Need(words="secret confidential restricted unclassified official"),
    "DATA_SUBJECT_ID": Need(shape=rf"(?:DSR|DSAR|SUBJ) ?{_D}{{5}}"),
}


def fold(text: Column) -> Column:
    """A blank and the text in lower case, with the three letters that match an
    ASCII letter only when case is ignored written as that letter."""
    for letter, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.concat(F.lit(" "), F.lower(text))


def shape(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Z\p{Nd}]+", " ")


def marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[^@$_=+:/\-]+", "")


def literal(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_COLUMNS = {"shape": "_shape", "marks": "_marks", "text": "_text", "words": "_folded", "folded": "_folded"}


def views(types: Iterable[str]) -> list[dict[str, Column]]:
    """The view columns over ``_text``, in the order in which they build on each other."""
    words = " ".join(dict.fromkeys(" ".join(NEEDS[t].words for t in types if t in NEEDS).split()))
    keyword = F.rlike("_folded", F.lit(_word_start(words))) if words else F.lit(False)
    text = F.col("_text")
    return [{"_folded": fold(text), "_shape": shape(text), "_marks": marks(text)}, {"_keyword": keyword}]


def may_match(need: Need) -> list[str]:
    """The conditions of ``need`` as SQL over the view columns, cheapest first."""
    conditions = []
    for field in Need._fields:
        wanted = getattr(need, field)
        if not wanted:
            continue
        if field == "holds":
            conditions.append("(" + " OR ".join(f"contains(_folded, {literal(h)})" for h in wanted.split()) + ")")
            continue
        if field == "words":
            conditions.append("_keyword")
            wanted = _word_start(wanted)
        conditions.append(f"rlike({_COLUMNS[field]}, {literal(wanted)})")
    return conditions
