import random

import numpy as np

from veilframe.llm import license_scan as ls
from veilframe.llm.license_texts import ALL_TEMPLATES, TEMPLATES, TERMS
from veilframe.llm.queries import op5_license_scan


def full_alignment(template, words):
    """Local alignment without a band: the most matched words of the best score."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for wanted in template:
        row = [(0, 0)]
        for w, word in enumerate(words):
            s, m = above[w]
            cell = (s + ls.MATCH, m + 1) if word == wanted else (s + ls.MISMATCH, m)
            for other in (above[w + 1], row[w]):
                if other[0] + ls.GAP > cell[0]:
                    cell = (other[0] + ls.GAP, other[1])
            row.append(cell if cell[0] > 0 else (0, 0))
        best, above = max(best, *row), row
    return best[1]


def test_every_template_is_found_in_noise_and_edited(spark, rows):
    rng = random.Random(1)
    noise = [f"wort{i}" for i in range(300)]
    docs, wanted = [], {}
    for t, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 30:
            for i in rng.sample(range(len(words)), len(words) // 15):
                words[i] = "changed"
            del words[10:12]
        passage = "  ".join(words)
        before = "é " + " ".join(rng.choices(noise, k=rng.randrange(1, 60)))
        docs.append((t, f"{before} ({passage}) {' '.join(rng.choices(noise, k=20))}"))
        wanted[t] = (name, len(before) + 2)
    got = ls.scan_licenses(rows(docs), TEMPLATES).collect()
    texts = dict(docs)
    for t, (name, start) in wanted.items():
        own = [r for r in got if r.doc_id == t and r.template == name]
        assert len(own) == 1 and own[0].coverage >= 0.8 and abs(own[0].start - start) <= 60, name
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == r.passage


def test_words_put_in_and_left_out_in_the_middle(spark, rows):
    docs, wanted = [], {}
    for name, text in TEMPLATES[6:]:
        words = [w.decode() for w in ls._WORD.findall(text.encode())]
        half = len(words) // 2
        for n in (9, 12, 25, 40):
            if n <= len(words):
                wanted[len(docs)] = (name, len(words), len(words) + n)
                docs.append((len(docs), " ".join([*words[:half], *(f"neu{i}" for i in range(n)), *words[half:]])))
            if n <= 0.25 * len(words):
                wanted[len(docs)] = (name, len(words) - n, len(words) - n)
                docs.append((len(docs), " ".join(words[: half - n // 2] + words[half - n // 2 + n :])))
    got = ls.scan_licenses(rows(docs), TEMPLATES).collect()
    for d, (name, matched, span) in wanted.items():
        (own,) = [r for r in got if r.doc_id == d and r.template == name]
        assert matched - 2 <= own.matched_words <= matched and len(own.passage.split()) == span, (name, docs[d])


def test_partial_copies_in_a_row_stay_apart(spark, rows):
    name, text = TEMPLATES[6]
    words = text.split()
    cut = len(words) // 5
    got = ls.scan_licenses(rows([(1, " ".join(words[:-cut] + ["and"] * 20 + words[cut:]))]), TEMPLATES).collect()
    assert sorted(round(r.coverage, 1) for r in got if r.template == name) == [0.8, 0.8]


def test_matches_equal_those_of_the_full_alignment():
    templates = ls.Templates(TEMPLATES)
    rng = random.Random(4)
    for name, text in TEMPLATES[6:]:
        words = text.split()
        for i in rng.sample(range(len(words)), 3):
            words[i] = "x"
        words.insert(rng.randrange(len(words)), "inserted")
        data = " ".join(words).encode()
        values = ls.hashed_grams(np.array([0, len(data)]), np.frombuffer(data, np.uint8))[1]
        at, entry = templates.hits(values)
        t = templates.names.index(name)
        hits = {t: [(int(a), int(templates.places[e])) for a, e in zip(at, entry) if templates.owners[e] == t]}
        (match,) = ls.scan_text(templates, data, hits)
        own = [w.lower() for w in ls._WORD.findall(data)]
        assert match[2] == full_alignment(templates.words[t], own)


def test_whole_table_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_license_scan(spark, sf).collect()
    for name, text in TEMPLATES[:4]:
        assert sorted(i for i, t in texts.items() for _ in range(t.count(text))) == sorted(r.doc_id for r in got if r.template == name and r.coverage == 1.0)


def test_repeats_in_a_text_and_edges(spark, rows):
    line = TEMPLATES[0][1]
    docs = rows([(1, f"{line} {line}\n{line}"), (None, line.upper()), (2, None), (3, ""), (4, "mit license"), (5, line), (5, line)])
    got = ls.scan_licenses(docs, TEMPLATES).collect()
    assert sorted([(r.doc_id or 0, r.start) for r in got]) == [(0, 0), (1, 0), (1, 32), (1, 64), (5, 0), (5, 0)]
    assert ls.scan_licenses(docs, []).count() == 0
    assert ls.scan_licenses(docs.limit(0), TEMPLATES).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS template")
    assert ls.scan_licenses(clash, TEMPLATES).count() == 6
    long = rows([(1, "licensed under the " * 100_000 + TEMPLATES[1][1])])
    assert [r.coverage for r in ls.scan_licenses(long, TEMPLATES[1:2]).collect()] == [1.0]


def names(rows, text):
    return sorted(r.template for r in ls.scan_licenses(rows([(1, text)]), ALL_TEMPLATES, terms=TERMS).collect())


def test_near_licenses_are_told_apart(rows):
    for name, text in ALL_TEMPLATES:
        assert names(rows, f"alpha beta {text} gamma delta") == [name]


def test_what_was_taken_for_another_license(rows):
    assert names(rows, "This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-statement"]
    assert names(rows, "Licensed under CC BY 4.0.") == ["CC-BY-4.0-short-statement"]
    assert names(rows, "Licensed under CC BY-ND 4.0.") == []
    assert names(rows, "This work is licensed under the GNU Lesser General Public License, version 3.") == []
    assert names(rows, "Licensed under the Apache License, Version 1.1.") == []
    assert names(rows, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == []
    assert names(rows, "Released under the BSD License.") == []


def test_clean_texts_have_no_license(spark):
    """Every match on the whole table lies on a statement that stands there."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = [[w.decode().lower() for w in ls._WORD.findall(text.encode())] for _, text in TEMPLATES[:6]]
    for r in op5_license_scan(spark, sf).collect():
        assert texts[r.doc_id][r.start : r.end] == r.passage
        words = [w.decode().lower() for w in ls._WORD.findall(r.passage.encode())]
        assert any(sum(w in line for w in words) >= len(line) - 1 for line in lines), r
