import gzip
import hashlib
import random

from veilframe.llm.warc import EMPTY_MEMBER, gzip_member, parse_records, read_warc, record, records_of_range, write_warc

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://a.net/x y", long), (2, None, long), (3, "http://b\n", None), (4, "c", ""), (5, "d", "short"), (6, "e", "short"), (None, "f", long)]
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame([(*p, "extra") for p in pages], SCHEMA + ", digest string"), path)
    got = {r.record_id: r for r in read_warc(spark, path, split_bytes=100).collect()}
    assert len(got) == 7
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {
        "<urn:x-page:1>": ("revisit", "<urn:x-page:2>"),
        "<urn:x-page:>": ("revisit", "<urn:x-page:2>"),
    }
    for page, _, html in pages:
        r = got[f"<urn:x-page:{'' if page is None else page}>"]
        data = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert got["<urn:x-page:1>"].target_uri == "http://a.net/x%20y"


def test_equal_largest_ids_are_all_responses(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame([(7, "u", "x" * 1000)] * 3 + [(None, "u", "y" * 1000)] * 2, SCHEMA), path)
    assert [r.record_type for r in read_warc(spark, path).collect()] == ["response"] * 5


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame([], SCHEMA), path)
    assert read_warc(spark, path).count() == 0


def test_every_range_split_gives_each_record_once(tmp_path):
    rng = random.Random(1)
    data, starts = b"", []
    for i in range(40):
        payload = rng.randbytes(rng.choice([0, 10, 3000])) + (b"\x1f\x8b\x08\x00" + rng.randbytes(8)) * 3
        starts.append(len(data))
        data += gzip_member(record(str(i), f"u{i}", payload, hashlib.sha1(payload).hexdigest(), "response", None))
        data += rng.choice([b"", EMPTY_MEMBER, b"\x1f\x8b\x08junk", gzip_member(b"not a record")])
    file = tmp_path / "x.warc.gz"
    file.write_bytes(data)
    for step in (1, 7, 500, 4096, len(data)):
        found = [r for s in range(0, len(data), step) for r in records_of_range(f"file://{file}", s, s + step)] if step > 6 else None
        if found is not None:
            assert [r["offset"] for r in found] == starts
            assert [r["record_id"] for r in found] == [f"<urn:x-page:{i}>" for i in range(40)]


def test_cut_off_and_several_records_in_a_member(tmp_path):
    one = record("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), "response", None)
    assert len(list(parse_records(one + one))) == 2
    file = tmp_path / "x.warc.gz"
    file.write_bytes(gzip.compress(one + one) + gzip_member(one)[:-9])
    assert len(list(records_of_range(f"file://{file}", 0, 10**6))) == 2
