import bz2
import gzip
from datetime import datetime
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from veilframe.operators import intercept
from veilframe.operators.detect import detect_entities
from veilframe.operators.protect import protect_texts
from veilframe.operators.reports import latest_hours
from veilframe.sources import staging, tables
from veilframe.streaming import traffic

AT = datetime(2025, 1, 1, 12)


def _log(spark):
    rows = [(i, "MCP", "INBOUND", "a", 'say "hi",\nyou', i, "PASSED", 1.5, datetime(2025, 1, 1 + i % 3, 5)) for i in range(9)]
    return spark.createDataFrame(rows, tables.SCHEMAS["interceptor_logs"])


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_round_trip(spark, tmp_path, format):
    path = str(tmp_path / format)
    log = _log(spark)
    tables.append_table(log, "interceptor_logs", path, format)
    tables.append_table(log, "interceptor_logs", path, format)
    back = tables.read_table(spark, "interceptor_logs", path, format)
    assert back.count() == 18
    assert sorted(back.select(*log.columns).distinct().collect()) == sorted(log.collect())


def test_day_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_table(_log(spark), "interceptor_logs", path)
    one = tables.read_table(spark, "interceptor_logs", path).where("day = date'2025-01-02'")
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_and_dimension(spark, tmp_path):
    path = str(tmp_path / "roles")
    spark.createDataFrame([("admin", "all")], "role_name string, description string").write.option("header", True).csv(path)
    texts = tables.read_texts(spark, path, "csv", text="description")
    assert texts.first().text == "all"


def test_whole_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nmail a@b.co")
    docs = tables.read_texts(spark, str(tmp_path), "text")
    assert [e.entity_type for e in detect_entities(docs).first().entities] == ["EMAIL"]


def test_texts_are_written_as_files_by_the_tasks(spark, tmp_path):
    """A file for each text, copies of an id too; its folders do not grow with the texts."""
    rows = [(i, f"text {i}\r\nof ä\n") for i in range(60)] + [(7, "again"), (8, ""), (9, None), (-1, "below"), (None, "no id")]
    path = tmp_path / "files"
    tables.write_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), str(path), folders=4)
    back = tables.read_texts(spark, str(path), "text").collect()
    number = [r.doc_id.rsplit("/doc=", 1)[1].split("_")[0] for r in back]
    assert sorted(zip(number, (r.text for r in back))) == sorted(("" if i is None else str(i), t + "\n") for i, t in rows if t is not None)
    assert len(list(path.iterdir())) <= 4 and not list(path.rglob(".*"))


def test_folders_of_texts_are_listed_by_several_jobs(spark, tmp_path):
    """No folder has more than 64 others: all names would reach the driver at once."""
    path, tracker = tmp_path / "files", spark.sparkContext.statusTracker()
    tables.write_texts(spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), str(path))
    inside = [len([x for x in folder.iterdir() if x.is_dir()]) for folder in (path, *path.iterdir())]
    assert inside == [4, 64, 64, 64, 64]
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        back = tables.read_texts(spark, str(path), "text")
        assert len(tracker.getJobIdsForGroup("listing")) >= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert back.select("text").distinct().count() == back.count() == 3000


def test_small_files_share_tasks(spark, tmp_path):
    """Not a task for a few small files each; the rows and names are those of Spark's
    reader of whole texts, which unpacks files and skips hidden and empty ones."""
    for i in range(300):
        folder = tmp_path / f"part={i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"a b%{i}.txt").write_bytes(b"x\xff\r\n" * (i % 5))
    for name, pack in (("z.txt.gz", gzip.compress), ("y.BZ2", bz2.compress), ("gz", bytes), ("_hidden", bytes), (".dot", bytes)):
        (folder / name).write_bytes(pack(b"packed " + name.encode()))
    (tmp_path / "odd" / "content=5").mkdir(parents=True)
    (tmp_path / "odd" / "content=5" / "a.txt").write_text("abc")

    def rows(df, name, text):
        return sorted(map(tuple, df.select(name, F.hex(F.col(text).cast("binary"))).collect()))

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for path, n in (("part=*", 243), ("part=1", 80), ("part=2/*.gz", 1), ("odd", 1)):
            whole = spark.read.format("text").option("wholetext", True).load(str(tmp_path / path))
            back = tables.read_texts(spark, str(tmp_path / path), "text")
            assert rows(back, "doc_id", "text") == rows(whole, F.col("_metadata.file_path"), "value")
            assert back.count() == n and back.schema.simpleString() == "struct<doc_id:string,text:string>"
        assert tables.read_texts(spark, str(tmp_path / "part=[01]"), "text").rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 160
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_and_trends_read_only_their_days(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_table(_log(spark), "interceptor_logs", path)
    log = tables.read_table(spark, "interceptor_logs", path)

    def filters(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "PartitionFilters: [isnotnull(day" in line]

    page = intercept.list_logs(log, date_from=datetime(2025, 1, 2), date_to=datetime(2025, 1, 2, 12))
    assert filters(page) and page.count() == 3
    assert filters(latest_hours(log, "timestamp", 1)) and latest_hours(log, "timestamp", 1).first().hour == datetime(2025, 1, 3, 5)


def test_store_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, 7, 1, "a@b.co and 10.0.0.1"), (2, 7, 2, "a@b.co"), (3, 8, 3, "none")], "doc_id bigint, session_id bigint, doc_seq bigint, text string")
    vault = spark.createDataFrame([(i, "ag", "p", AT, 60) for i in (7, 8)], "session_id bigint, agent_id string, policy_id string, created_at timestamp, ttl_seconds int")
    out = protect_texts(docs, vault, F.lit(AT))
    s, e = str(tmp_path / "s"), str(tmp_path / "e")
    tables.store_scan(out.entities, out.counts, s, e, F.lit(AT))
    sessions = {r.id: r for r in tables.read_table(spark, "scan_sessions", s).collect()}
    assert (sessions[7].entities_protected, sessions[8].entities_protected) == (3, 0)
    found = tables.read_table(spark, "entities_detected", e).collect()
    assert sorted(r.token for r in found) == ["<<EMAIL_1>>", "<<EMAIL_2>>", "<<IP_ADDRESS_1>>"] and len({r.id for r in found}) == 3


def test_export(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_json(_log(spark).orderBy(F.desc("timestamp")), path)
    assert spark.read.json(path).count() == 9


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id bigint, timestamp timestamp, event_type string"
    source = str(tmp_path / "in")

    def write(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = traffic.read_stream(spark, source, schema)
        counts = traffic.hourly_counts(stream, "event_type")
        traffic.write_stream(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {(r.hour.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    write((1, datetime(2025, 1, 1, 1, 5), "x"), (2, datetime(2025, 1, 1, 1, 50), "x"), (3, datetime(2025, 1, 1, 4), "x"))
    assert run() == {(1, 2)}
    write((4, datetime(2025, 1, 1, 1, 10), "x"), (5, datetime(2025, 1, 1, 9), "x"))
    assert run() == {(1, 2), (4, 1)}


def test_csv_tells_null_from_empty(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [(1, None), (2, ""), (3, 'say "hi",\nyou'), (4, "\\N?"), (5, " ")]
    spark.createDataFrame(rows, "doc_id long, body string").write.options(**tables.CSV).csv(path)
    back = tables.read_texts(spark, path, "csv", text="body")
    assert sorted((int(r.doc_id), r.text) for r in back.collect()) == rows


def test_staged_results_are_removed(spark):
    kept = staging.stage_files(spark.range(5), "five")
    assert kept.count() == 5
    folder = Path(urlparse(staging.checkpoint_dir(spark)).path)
    other = folder / "by-hand"
    other.mkdir()
    own = spark.newSession()
    assert own.sparkContext.getCheckpointDir() and any(folder.iterdir())
    staging.clear_staged(spark)
    assert not any(folder.iterdir())
    assert staging.stage_files(spark.range(5), "again").count() == 5
