import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.functions.folding import max_before, sum_before
from veilframe.functions.ordered import previous, running_total
from veilframe.operators import audit, sessions

T0 = datetime(2025, 1, 1, 0, 0, 0, 5)


def events(spark, n, step=1):
    rows = [(i * step, f"evt_{i}", "VAULT_READ", T0 + timedelta(seconds=i)) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "seq bigint, event_id string, event_type string, timestamp timestamp")


def test_chain_is_the_sequential_one(spark):
    got = audit.build_chain(events(spark, 300)).orderBy("seq").collect()
    last = "0" * 64
    for r in got:
        stamp = r.timestamp.strftime("%Y-%m-%dT%H:%M:%S.%f")
        assert r.prev_hash == last
        last = hashlib.sha256(f"{r.event_id}{r.event_type}{stamp}{last}".encode()).hexdigest()
        assert r.hash == last


def check(chain, **more):
    return audit.verify(audit.check_links(chain, **more)).first()


def test_intact_and_tampered(spark):
    chain = audit.build_chain(events(spark, 500), segment_rows=64)
    whole = check(chain)
    assert (whole.verified, whole.total_events, whole.first_event, whole.last_event) == (True, 500, "evt_0", "evt_499")
    flipped = chain.withColumn("hash", F.when(F.col("seq") == 70, F.lit("0")).otherwise(F.col("hash")))
    bad = check(flipped)
    assert (bad.verified, bad.broken_links, bad.wrong_hashes) == (False, 1, 1)
    at = audit.broken_links(audit.check_links(flipped)).first()
    assert (at.seq, at.expected_prev_hash) == (71, "0")


@pytest.mark.parametrize("step", [1, 5000])
def test_segments_and_groups_are_linked(spark, monkeypatch, step):
    """Segments of 4 in groups of 3, 9 and more: several levels in a small table."""
    monkeypatch.setattr(audit, "FAN", 3)
    chain = audit.build_chain(events(spark, 200, step), segment_rows=4)
    rows = chain.orderBy("seq").collect()
    assert [r.segment for r in rows] == [i // 4 for i in range(200)]

    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    contents = [
        digest(*[digest(r.event_id, r.event_type, r.timestamp.strftime("%Y-%m-%dT%H:%M:%S.%f")) for r in rows[s : s + 4]]) for s in range(0, 200, 4)
    ]

    def starts(blocks, level):
        if level:
            above = starts([digest(*blocks[i : i + 3]) for i in range(0, len(blocks), 3)], level - 1)
        out = []
        for i, block in enumerate(blocks):
            first = i % 3 == 0 if level else i == 0
            out.append((above[i // 3] if level else "0" * 64) if first else digest(out[-1], blocks[i - 1]))
        return out

    assert [r.prev_hash for r in rows[::4]] == starts(contents, audit.LEVELS)
    assert check(chain).verified
    for gone in ([7], [9], [0], [9, 10, 11], list(range(18))):
        assert not check(chain.where(~F.col("segment").isin(gone))).verified, gone
    moved = chain.withColumn("event_type", F.when(F.col("seq") == 13 * step, F.lit("X")).otherwise(F.col("event_type")))
    assert not check(moved).verified


def test_a_cut_off_end_is_seen_by_the_seals(spark):
    chain = audit.build_chain(events(spark, 100), segment_rows=8)
    seals = audit.seal_segments(chain)
    assert audit.changed_segments(chain, seals).count() == 0
    cut = chain.where("seq < 84")
    assert check(cut).verified
    assert [tuple(r) for r in audit.changed_segments(cut, seals).orderBy("segment").collect()] == [(10, 8, 4, "changed"), (11, 8, 0, "missing"), (12, 4, 0, "missing")]


def test_append(spark):
    first = audit.build_chain(events(spark, 50), segment_rows=8)
    new = events(spark, 90).where("seq >= 50").drop("seq")
    seals = audit.seal_segments(first)
    second = audit.build_chain(audit.number_events(new, 49), seals, segment_rows=8)
    both = first.unionByName(second)
    assert check(both).verified and check(both).total_events == 90
    assert second.agg(F.min("segment"), F.min("seq"), F.max("seq")).first()[:] == (7, 50, 89)
    assert not check(second).verified
    empty = audit.build_chain(events(spark, 5), audit.seal_segments(first.limit(0)))
    assert check(empty).verified


def test_plain_chain_has_no_segments(spark):
    chain = audit.build_chain(events(spark, 400))
    assert check(chain.drop("segment"), width=7).verified
    assert check(chain.drop("segment").where("seq <> 5"), width=7).broken_links == 1


def test_neighbours_across_segments(spark):
    chain = audit.build_chain(events(spark, 20), segment_rows=6)
    hashes = [r.hash for r in chain.orderBy("seq").collect()]
    for r in audit.with_neighbours(chain).collect():
        assert r.prev_event_hash == (hashes[r.seq - 1] if r.seq else None)
        assert r.next_event_hash == (hashes[r.seq + 1] if r.seq < 19 else None)


def test_empty_trail(spark):
    none = check(audit.build_chain(events(spark, 0)))
    assert (none.verified, none.total_events) == (True, 0)


def test_previous_with_gaps(spark):
    rng = random.Random(2)
    rows = [(p, f"v{p}") for p in sorted(rng.sample(range(10**12), 400))]
    df = spark.createDataFrame(rows, "p bigint, v string").repartition(5)
    got = {r.p: r.before for r in previous(df, "p", "v", "before", width=8).collect()}
    for a, b in zip([None, *rows], rows):
        assert got[b[0]] == (a[1] if a else None)


def test_running_total(spark):
    rows = [("a", p % 700, 1 + p % 3, p) for p in range(2000)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint, tie int")
    got = {r.tie: r.total for r in running_total(df, ["k"], "p", "v", "total", [F.col("tie")], width=8).collect()}
    total = 0
    for _, p, v, tie in sorted(rows, key=lambda r: (r[1], r[3])):
        total += v
        assert got[tie] == total


def test_running_values_over_arrays(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 99) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", sum_before(F.col("v")).alias("s"), max_before(F.col("v")).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
        assert r.m == [max(r.v[:i], default=0) for i in range(len(r.v))]


def test_entity_types_in_all_shapes(spark):
    shapes = [
        '[{"type": "SSN"}, {"action": "x"}, {"type": null}]', '["EMAIL", 5]', '"SSN, , EMAIL"', '{"type": "SSN"}', "[oops", None,
    ]
    df = spark.createDataFrame([(s,) for s in shapes], "j string")
    got = [r[0] for r in df.coalesce(1).select(audit.entity_types(F.col("j"))).collect()]
    assert got[0][:2] == ["SSN", "UNKNOWN"]
    assert got[1:] == [["EMAIL", "5"], ["SSN", "EMAIL"], None, None, None]


def test_extend_without_expiry_counts_from_now(spark):
    df = spark.createDataFrame(
        [(1, "a", T0, None, "EXPIRED", "ag", "p", 0, 0)],
        "id bigint, name string, created_at timestamp, expires_at timestamp, status string, agent_id string, policy_id string, "
        "entities_protected bigint, tokens_generated bigint",
    )
    asked = spark.createDataFrame([(1, 5), (1, 5), (1, 200), (1, None), (2, 3), (None, 3)], "session_id bigint, hours int")
    updated, log, rejected = sessions.extend_sessions(df, asked, F.lit(T0))
    row = updated.first()
    assert (row.status, row.expires_at) == ("ACTIVE", T0 + timedelta(hours=10))
    assert [r.entities_json for r in log.collect()] == ['{"hours_added":5}'] * 2
    assert len({r.event_id for r in log.collect()}) == 2
    assert sorted([(r.session_id or 0, r.hours or 0, r.reason[:5]) for r in rejected.collect()]) == [
        (0, 3, "sessi"), (1, 0, "hours"), (1, 200, "hours"), (2, 3, "sessi"),
    ]
