import hashlib
import random

import pytest

from veilframe.llm import pieces
from veilframe.llm.queries import op7_sentencepiece, piece_model


@pytest.fixture(scope="module")
def own():
    with open(piece_model(), "rb") as file:
        return pieces.Encoder(file.read())


PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "▁", "\x00", "é", "日", "本", "😀", "​", "ﬁ", "Å", "<0x0A>", "<s>", "<unk>", "1", "!!", "\xa0", "﻿"]


def test_same_as_the_library(own):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 12, 120])))
        ids, shown = own.encode(text)
        assert ids == own.library.encode(text), text
        assert shown == ",".join(map(str, ids))


def test_list_and_heap_agree(own):
    rng = random.Random(6)
    for n in (2, 7, 40, 400):
        chunk = "".join(rng.choice("abcdethnr") for _ in range(n))
        assert own.merged_short(chunk) == own.merged_long(chunk)


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    own.known, own.older = {}, {}
    text = " ".join(f"w{i}" for i in range(500)) + " w1"
    assert own.encode(text)[0] == own.library.encode(text)
    assert len(own.known) <= 50 and len(own.older) <= 50


def test_a_wrong_chunk_is_noticed(own):
    own.check("")
    own.encode("harbor zzqx")
    own.unchecked[0][1].append(5)
    with pytest.raises(ValueError, match="otherwise"):
        own.check("")
    own.known, own.older = {}, {}


def test_long_word(own):
    text = "abcdefghij" * 20_000
    assert own.encode(text)[0] == own.library.encode(text)


def test_whole_table(spark, own):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_sentencepiece(spark, sf).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        ids = own.library.encode(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(own.library.decode(ids).encode()).hexdigest()


def test_edges(spark, rows):
    docs = rows([(1, None, 3), (1, "", 3), (None, "a b", 4), (None, "a b", 4)], "doc_id long, text string, n_tokens int")
    out = pieces.encode_texts(docs, piece_model(), with_ids=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = out.collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[:2]] == [(0, empty, empty)] * 2
    assert got[2] == got[3] and len(got[2].ids) == got[2].n_tokens
    assert pieces.encode_texts(docs.limit(0), piece_model()).count() == 0
