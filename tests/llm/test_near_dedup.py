import random
import re
from collections import defaultdict

import numpy as np
import pytest

from veilframe.llm import near_dedup as nd
from veilframe.llm.queries import op8_near_dedup
from veilframe.llm.words import distinct, mix, numbers


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(texts, k, percent=80):
    """``(n_shingles, component)`` by id, from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                common[j, i] += 1
            holders[s].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op8_near_dedup(spark, sf)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(texts, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_chains_and_families(spark, rows):
    """Documents that drift word by word: links along the chain, few across it, many in
    each bucket."""
    rng = random.Random(2)
    texts, words = {}, [f"w{i}" for i in range(150)]
    for i in range(120):
        words = list(words)
        if i % 3:
            words[rng.randrange(len(words))] = f"n{i}"
        else:
            for _ in range(4):
                words[rng.randrange(len(words))] = f"n{i}{rng.random()}"
        texts[1000 - i] = " ".join(words)
        texts[2000 + i] = " ".join(words[:70] + [f"t{i}_{j}" for j in range(25)])
    assert got(nd.near_duplicates(rows(list(texts.items())), k=3)) == brute(texts, 3)


def test_edges(spark, rows):
    long = " ".join(f"w{i}" for i in range(60_000))
    values = [(5, "A b c d e"), (3, "a B  c\td\ne"), (9, "a b"), (8, "A B"), (7, ""), (6, None), (4, " \n"), (2, long), (1, long + " tail")]
    out = nd.near_duplicates(rows([(i, t, 0, "x") for i, t in values], "doc_id long, text string, component_id int, key string"), k=4)
    assert got(out) == {5: (2, 3), 3: (2, 3), 9: (1, 8), 8: (1, 8), 7: (0, 7), 6: (0, 6), 4: (0, 4), 2: (59_997, 1), 1: (59_998, 1)}
    assert nd.near_duplicates(rows([])).count() == 0
    assert got(nd.near_duplicates(rows([(1, None)]))) == {1: (0, 1)}


def test_null_and_repeated_ids(spark, rows):
    values = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "only here"), (None, None), (2, "x y z"), (2, "x y z"), (3, "x y z")]
    out = [tuple(r) for r in nd.near_duplicates(rows(values), k=4).collect()]
    assert sorted(out, key=repr) == sorted(
        [(None, 3, 4, False), (4, 3, 4, True), (None, 1, None, True), (None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False)], key=repr
    )
    left = nd.drop_near_duplicates(rows(values), k=4).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == [(2, "x y z"), (2, "x y z"), (4, "a b c d e f")]


def test_rows_are_dropped_by_id_and_text(spark, rows):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words[:-2], "other", "end"])
    values = [(1, "a b c d e"), (2, "A b c d e"), (2, "of its own"), (5, "one text"), (5, "quite another"), (None, "without id"), (None, "without id")]
    values += [(None, near[0]), (None, near[1]), (30, near[2]), (4, ""), (None, None), (None, None), (10, "x y"), (9, "x y")]
    got = [tuple(r) for r in nd.drop_near_duplicates(rows(values), k=4).collect()]
    wanted = [values[0], *values[2:6], values[9], *values[10:13], values[14]]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    twice = [tuple(r) for r in nd.drop_near_duplicates(rows([(None, near[0]), (None, near[1])]), k=4).collect()]
    assert len(twice) == 1


def test_members_that_hubs_leave_open_without_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 16)
    rng = random.Random(5)
    texts = {i: " ".join([f"w{j}" for j in range(70)] + [f"t{i}_{j}" for j in range(rng.randrange(8, 24))]) for i in range(80)}
    components = {c for _, c in brute(texts, 3).values()}
    got = nd.drop_near_duplicates(rows(list(texts.items())), k=3).collect()
    assert {r.doc_id for r in got} == components
    nameless = nd.drop_near_duplicates(rows([(None, t) for t in texts.values()]), k=3).collect()
    assert len(nameless) == len(components) and {r.text for r in nameless} <= set(texts.values())


@pytest.mark.parametrize("size", [1, 3, 40, 700])
def test_sketches_fill_and_estimate(size):
    base = mix(numbers(size * 10, 99))
    a, b = base[: size * 9], base[size:]  # similarity 0.8
    doc = np.repeat([0, 1], [len(a), len(b)])
    doc, values, _ = distinct(doc, np.concatenate([a, b]))
    s = nd.sketches(doc, values, 3)
    assert (s[:2] != nd._EMPTY).all() and (s[2] == nd._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.2
    same = nd.sketches(np.zeros(len(a), int), np.sort(a)[::1], 1)
    assert (same[0] == s[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    out = dict(nd.components(spark.createDataFrame(links, "a long, b long")).distinct().collect())
    assert out == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("percent", [50, 79, 101])
def test_limits_that_the_bands_are_not_made_for(rows, percent):
    with pytest.raises(ValueError, match="percent"):
        nd.near_duplicates(rows([(1, "a b c")]), percent=percent)
