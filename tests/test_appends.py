from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit, protect, reports
from veilframe.sources import appends, rewrite, tables
from veilframe.streaming import expiry, traffic

T0 = datetime(2025, 1, 1, 5)


def trail(spark, low, high):
    rows = [(f"evt_{i:04}", "VAULT_READ", f"a{i % 3}", T0 + timedelta(hours=i)) for i in range(low, high)]
    return spark.createDataFrame(rows, "event_id string, event_type string, agent_id string, timestamp timestamp")


def logs(spark, low, high):
    rows = [(i, "MCP", "INBOUND", "a", "x", i, "PASSED", 1.5, T0 + timedelta(hours=9 * i)) for i in range(low, high)]
    return spark.createDataFrame(rows, tables.SCHEMAS["interceptor_logs"])


def ids(spark, path):
    return sorted(r.id for r in tables.read_table(spark, "interceptor_logs", path).collect())


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert appends.append_batch(logs(spark, 0, 9), "interceptor_logs", path, 0)
    assert not appends.append_batch(logs(spark, 0, 9), "interceptor_logs", path, 0)
    assert appends.append_batch(logs(spark, 9, 12), "interceptor_logs", path, 1)
    assert appends.append_batch(logs(spark, 20, 22), "interceptor_logs", path, 0, "other")
    assert ids(spark, path) == [*range(12), 20, 21] and appends.last_batch(spark, path) == 1
    one = tables.read_table(spark, "interceptor_logs", path).where("day = date'2025-01-02'")
    assert one.count() == 2


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_batch_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch, moved):
    path, work, calls = str(tmp_path / "log"), rewrite.Files.move, []

    def fail(self, *args):
        if len(calls) == moved:
            raise OSError("lost")
        calls.append(args)
        return work(self, *args)

    with monkeypatch.context() as m:
        m.setattr(rewrite.Files, "move", fail)
        with pytest.raises(OSError):
            appends.append_batch(logs(spark, 0, 9), "interceptor_logs", path, 3)
    assert appends.append_batch(logs(spark, 0, 9), "interceptor_logs", path, 3)
    assert ids(spark, path) == list(range(9))


def test_chain_of_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chain")
    assert appends.append_chain(trail(spark, 0, 30), path, 0, segment_rows=8)
    first = appends.verify_new(spark, path).first()
    assert (first.verified, first.new_events, first.total_events) == (True, 30, 30)
    # a batch that was cut off before its seals is not part of the chain, and is written anew
    with monkeypatch.context() as m:
        m.setattr(audit, "seal_segments", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            appends.append_chain(trail(spark, 30, 50), path, 1, segment_rows=8)
    assert appends.read_chain(spark, path).count() == 30
    assert appends.append_chain(trail(spark, 30, 50), path, 1, segment_rows=8)
    assert not appends.append_chain(trail(spark, 30, 50), path, 1, segment_rows=8)
    new, _ = appends.new_events(spark, path)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "(batch" in plan[plan.index("PartitionFilters") :].split("]")[0] and len(new.inputFiles()) > 0
    assert new.select("batch").distinct().collect()[0].batch == 1
    second = appends.verify_new(spark, path).first()
    assert (second.verified, second.new_events, second.total_events, second.first_event, second.last_event) == (True, 20, 50, "evt_0000", "evt_0049")
    nothing = appends.verify_new(spark, path).first()
    assert (nothing.verified, nothing.new_events, nothing.total_events) == (True, 0, 50)
    whole = audit.verify_chain(appends.read_chain(spark, path)).first()
    assert (whole.verified, whole.total_events) == (True, 50)
    assert [r.seq for r in appends.read_chain(spark, path).orderBy("seq").collect()] == list(range(1, 51))


def test_changes_are_found(spark, tmp_path):
    path = str(tmp_path / "chain")
    for batch in range(3):
        appends.append_chain(trail(spark, 20 * batch, 20 * batch + 20), path, batch, segment_rows=8)
        if not batch:
            assert appends.verify_new(spark, path).first().verified

    def change(event):
        read = lambda: spark.read.parquet(f"{path}/events")
        keys = spark.createDataFrame([(event,)], "event_id string")
        moved = lambda rows: rows.withColumn("event_type", F.when(F.col("event_id") == event, "X").otherwise(F.col("event_type")))
        table = read()
        rows = moved(table).select(table.columns)
        spark.createDataFrame(rows.collect(), table.schema).write.mode("overwrite").partitionBy("day", "batch").parquet(f"{path}/events")
        return keys

    change("evt_0003")  # before the state: seen by the full check only
    assert appends.verify_new(spark, path).first().verified
    chain = appends.read_chain(spark, path)
    assert not audit.verify_chain(chain).first().verified
    assert audit.changed_segments(chain, appends.read_seals(spark, path)).count() == 1
    appends.append_chain(trail(spark, 60, 70), path, 3, segment_rows=8)
    change("evt_0064")
    report = appends.verify_new(spark, path).first()
    assert not report.verified and report.changed_segments == 1
    assert not appends.verify_new(spark, path).first().verified  # a state is stored for whole chains only


@pytest.mark.parametrize("segments", [(2, 9), (3, 60), (30, 5)])
def test_appends_over_group_borders(spark, monkeypatch, segments):
    """Groups of 3: appends inside a group, over its end and over the end of larger ones."""
    monkeypatch.setattr(audit, "FAN", 3)
    first, second = segments
    events = trail(spark, 0, 2 * (first + second)).withColumn("seq", F.substring("event_id", 5, 4).cast("bigint"))
    whole = audit.build_chain(events, segment_rows=2).select("seq", "hash", "prev_hash").orderBy("seq").collect()
    old = audit.build_chain(events.where(F.col("seq") < 2 * first), segment_rows=2)
    seals = audit.seal_segments(old)
    new = audit.build_chain(events.where(F.col("seq") >= 2 * first), seals, segment_rows=2)
    assert old.unionByName(new).select("seq", "hash", "prev_hash").orderBy("seq").collect() == whole
    checked = audit.check_segments(new)
    assert audit.verify_segments(checked, seals).first().verified
    assert audit.verify_chain(old.unionByName(new)).first().verified
    assert not audit.verify_segments(checked, seals.where(F.col("segment") < first - 1)).first().verified
    broken = checked.where(F.col("segment") != first + 1)
    assert not audit.verify_segments(broken, seals).first().verified


def test_neighbours_by_hash(spark):
    rows = [(1, "a", "h1", "0" * 64), (2, "b", "h2", "h1"), (3, "c", "h3", "h1"), (4, "d", "h4", "gone"), (5, "e", "h5", "s1"), (6, "f", "h2", "h5"), (7, "g", None, None), (8, "h", "h8", "h2")]
    events = spark.createDataFrame(rows, "seq long, event_id string, hash string, prev_hash string")
    starts = spark.createDataFrame([("s1",), ("s1",), (None,)], "start string")
    found = audit.neighbours_by_hash(events, starts)
    got = {r.event_id: (r.prev_event, r.next_event, r.followers, r.orphan) for r in found.collect()}
    assert got == {
        "a": (None, "b", 2, False), "b": ("a", "h", 1, False), "c": ("a", None, 0, False), "d": (None, None, 0, True),
        "e": (None, "f", 1, False), "f": ("e", "h", 1, False), "g": (None, None, 0, False), "h": ("b", None, 0, False),
    }
    assert sorted(map(tuple, audit.forks(events, starts).collect())) == [("a", "b"), ("a", "c")]
    assert {r.event_id for r in audit.neighbours_by_hash(events).where("orphan").collect()} == {"d", "e"}


def test_pages_after_a_row(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, "MCP", "INBOUND", "a", "x", i, "PASSED", 1.5, None if i > 40 else T0 + timedelta(hours=6 * (i // 5))) for i in range(45)]
    tables.append_table(spark.createDataFrame(rows, tables.SCHEMAS["interceptor_logs"]), "interceptor_logs", path)
    log = tables.read_table(spark, "interceptor_logs", path)
    after, seen = None, []
    while page := reports.newest(log, {}, "timestamp", "id", limit=7, after=after).collect():
        assert page == reports.newest(log, {}, "timestamp", "id", limit=7, offset=len(seen)).collect()
        seen += page
        after = page[-1].timestamp, page[-1].id
    assert len(seen) == 45
    plan = reports.newest(log, {}, "timestamp", "id", after=(T0, 3))._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan[plan.index("PartitionFilters") :].split("\n")[0]
    with pytest.raises(ValueError):
        reports.newest(log, {}, "timestamp", "id", offset=5, after=(T0, 3))


def test_entries_are_met_in_their_buckets(spark, tmp_path):
    rows = [(f"vlt_{i}", f"s{i % 3}", f"text {i}", {"a": "b"}) for i in range(200)]
    made = spark.createDataFrame(rows, "vault_ref string, session_id string, original_text string, mappings map<string,string>")
    protect.write_entries(made, "entries_for_test", str(tmp_path / "entries"), buckets=8)
    entries = spark.table("entries_for_test")
    sessions = spark.createDataFrame([(f"s{i}", T0, 3600) for i in range(2)], "session_id string, created_at timestamp, ttl_seconds int")
    asked = spark.createDataFrame([("vlt_7",), ("vlt_8",), ("none",)], "vault_ref string")
    restored = protect.restore(asked.hint("merge"), entries, sessions, F.lit(T0))
    assert {r.vault_ref: (r.original_text, r.entities_restored) for r in restored.collect()} == {"vlt_7": ("text 7", 1), "vlt_8": (None, None), "none": (None, None)}
    joined = asked.hint("merge").join(entries, "vault_ref")._jdf.queryExecution().executedPlan().toString()
    at = joined.index("Bucketed: true")
    assert "Exchange" not in joined[joined[:at].rindex("Sort ") : at]
    few = protect.find_entries(entries, ["vlt_7", "none"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert [r.original_text for r in few.collect()] == ["text 7"] and "Exchange" not in plan
    assert "In(vault_ref" in plan
    assert len(list(Path(tmp_path / "entries").glob("*.parquet"))) <= 8
    spark.sql("DROP TABLE entries_for_test")


def test_expiry_events_come_once(spark, tmp_path):
    folder, schema = tmp_path / "in", "vault_ref string, session_id string, created_at timestamp, ttl_seconds int"

    def arrive(rows):
        spark.createDataFrame([(r, "s", T0 + timedelta(minutes=m), ttl) for r, m, ttl in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        with expiry.timers(spark):
            traffic.write_stream(expiry.expiry_events(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.vault_ref, (r.expired_at - T0).total_seconds() / 60) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive([("a", 0, 600), ("b", 0, 3600), ("c", 1, None), ("d", 1, 1200), ("d", 2, 6000)])
    assert run() == []
    arrive([("e", 30, 60)])
    assert run() == [("a", 10.0)]
    assert run() == [("a", 10.0)]
    arrive([("a", 100, 60)])
    assert run() == [("a", 10.0), ("b", 60.0), ("e", 31.0)]
    arrive([("f", 200, 60)])
    assert run() == [("a", 10.0), ("a", 101.0), ("b", 60.0), ("d", 102.0), ("e", 31.0)]


def test_expiry_timers_are_for_groups(spark, tmp_path):
    """Many entries of few groups: every event comes once, with a timer or two a group."""
    schema = "vault_ref string, session_id string, created_at timestamp, ttl_seconds int"
    for batch, rows in enumerate(([(f"e{i}", f"s{i % 3}", 0, 60 * (1 + i % 50)) for i in range(400)], [("z", "s", 40, 6000), ("e399", "earlier", 40, 60)], [("y", "s", 100, 6000)])):
        made = spark.createDataFrame([(r, s, T0 + timedelta(minutes=m), ttl) for r, s, m, ttl in rows], schema)
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with expiry.timers(spark):
        query = traffic.write_stream(expiry.expiry_events(stream, "10 minutes", groups=4), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    timers = sum(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"])
    got = sorted((r.vault_ref, r.session_id, (r.expired_at - T0).total_seconds() / 60) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((f"e{i}", f"s{i % 3}", 1.0 + i % 50) for i in range(400))
    assert 0 < timers <= 4 * len(query.recentProgress)


def test_bursts_of_a_busy_agent(spark):
    """One agent has half of all events; rows as Spark's session windows give them."""
    kinds = ("SSN", "EMAIL", "PHONE")
    at = F.timestamp_seconds(1_735_700_000 + F.col("id") * 37 + F.when(F.col("id") % 97 == 0, 5000).otherwise(0))
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "busy").otherwise(F.concat(F.lit("a"), (F.col("id") % 500).cast("string"))).alias("agent_id"),
        at.alias("timestamp"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 3 + 1).cast("int")).alias("entity_type"),
    )
    for gap in ("74 seconds", "75 seconds", "2 hours"):
        got = traffic.salami_sessions(df, gap=gap, min_types=1, min_entities=1)
        want = df.groupBy(F.session_window("timestamp", gap), "agent_id").agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("entity_type")).alias("types"))
        want = want.select(F.col("session_window.start"), F.col("session_window.end"), "agent_id", "entities", "types")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = traffic.salami_sessions(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_a_batch_is_sorted_once(spark, tmp_path, monkeypatch):
    """The numbers that new events get are their places: they are not sorted again by them."""
    sorted_by, positions = [], audit.positions
    monkeypatch.setattr(audit, "positions", lambda df, order, *more: sorted_by.append(order) or positions(df, order, *more))
    events = spark.range(50).selectExpr("concat('e', lpad(id, 3, '0')) AS event_id", "'T' AS event_type", "timestamp'2024-01-01 00:00:00' AS timestamp")
    path = f"{tmp_path}/chain"
    appends.append_chain(events.where("event_id < 'e023'"), path, 0, 4)
    appends.append_chain(events.where("event_id >= 'e023'"), path, 1, 4)
    assert sorted_by == ["event_id", "event_id"]
    chain = appends.read_chain(spark, path)
    assert [r.event_id for r in chain.orderBy("seq").collect()] == [f"e{i:03d}" for i in range(50)]
    assert {r.segment: r["count"] for r in chain.groupBy("segment").count().collect()} == {**{i: 4 for i in range(12)}, 5: 3, 12: 3}
    assert audit.verify_chain(chain).first().verified
