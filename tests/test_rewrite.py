import hashlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.operators import sessions
from veilframe.sources import rewrite, tables


def entities(spark, n=60):
    rows = [(i, i // 4, "SSN", "x", "t", 0.9, "MASK", datetime(2025, 1, 1 + i // 6, 5)) for i in range(n)]
    return spark.createDataFrame(rows, tables.SCHEMAS["entities_detected"])


def stored(spark, path):
    tables.append_table(entities(spark), "entities_detected", path)
    return lambda: tables.read_table(spark, "entities_detected", path)


def digests(path):
    return {str(f.relative_to(path)): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet")}


def ids(read):
    return sorted(r.id for r in read().collect())


def test_only_files_with_the_rows_change(spark, tmp_path):
    path = str(tmp_path / "t")
    read = stored(spark, path)
    before, keys = digests(path), spark.createDataFrame([(3,), (3,), (None,), (77,)], "session_id long")
    assert rewrite.erase_rows(spark, path, read, keys, "session_id") == 1  # session 3 is on one day
    after = digests(path)
    assert {n.split("/")[0] for n in before.keys() ^ after.keys()} == {"day=2025-01-03"}
    assert all(after[n] == d for n, d in before.items() if n in after) and len(before.keys() & after.keys()) == len(before) - 1
    assert ids(read) == [i for i in range(60) if i // 4 != 3]
    assert not [f for f in Path(path).iterdir() if f.name.startswith(rewrite.JOURNAL)]
    assert rewrite.erase_rows(spark, path, read, keys, "session_id") == 0 and digests(path) == after


def test_only_the_key_is_read_to_find_files(spark, tmp_path):
    path = str(tmp_path / "t")
    found = rewrite.files_with(stored(spark, path)(), spark.createDataFrame([(3,)], "session_id long"), "session_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<session_id:bigint>" in plan and found.first().n == 4


@pytest.mark.parametrize("stop_at", ["delete_uri", "move"])
def test_a_swap_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch, stop_at):
    path = str(tmp_path / "t")
    read = stored(spark, path)
    keys = spark.createDataFrame([(3,), (9,)], "session_id long")
    work, calls = getattr(rewrite.Files, stop_at), []

    def fail_at_the_second(self, *args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        return work(self, *args)

    with monkeypatch.context() as m:
        m.setattr(rewrite.Files, stop_at, fail_at_the_second)
        with pytest.raises(OSError):
            rewrite.erase_rows(spark, path, read, keys, "session_id")
    rewrite.finish_rewrites(spark, path)
    assert ids(read) == [i for i in range(60) if i // 4 not in (3, 9)]


def test_a_change_without_a_complete_journal_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    read = stored(spark, path)
    before = digests(path)

    def broken(rows):
        return rows.withColumn("id", F.raise_error(F.lit("no")).cast("long"))

    with pytest.raises(Exception):
        rewrite.rewrite_rows(spark, path, read, spark.createDataFrame([(3,)], "session_id long"), "session_id", broken)
    assert ids(read) == list(range(60))
    rewrite.finish_rewrites(spark, path)
    assert digests(path) == before


def test_names_with_blanks_and_tables_without_folders(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    entities(spark).repartition(4).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    keys = spark.createDataFrame([(i,) for i in range(15)], "session_id long")
    assert rewrite.erase_rows(spark, path, read, keys, "session_id", None) == 4 and read().count() == 0


def test_purge_stored(spark, tmp_path):
    paths = str(tmp_path / "s"), str(tmp_path / "e")
    stored(spark, paths[1])
    rows = [(i, f"s{i}", datetime(2025, 1, 1 + i), None, "ACTIVE", "a", "p", 6, 6) for i in range(10)]
    tables.append_table(spark.createDataFrame(rows, tables.SCHEMAS["scan_sessions"]), "scan_sessions", paths[0])
    asked = spark.createDataFrame([(3,), (3,), (99,)], "session_id long")
    events, rejected = sessions.purge_stored(spark, *paths, asked, F.to_timestamp(F.lit("2025-02-01")))
    assert [(r.session_id, r.entities_json) for r in events.collect()] == [(3, '{"entities_purged":4}')]
    assert [(r.session_id, r.reason) for r in rejected.collect()] == [(99, "session not found")]
    state = {r.id: (r.status, r.entities_protected) for r in tables.read_table(spark, "scan_sessions", paths[0]).collect()}
    assert state == {i: ("PURGED", 0) if i == 3 else ("ACTIVE", 6) for i in range(10)}
    assert tables.read_table(spark, "entities_detected", paths[1]).where("session_id = 3").count() == 0
