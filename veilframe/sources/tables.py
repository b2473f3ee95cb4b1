"""The ten tables: schemas, readers and writers.

Schemas are given, never inferred, so a read starts no job and only the columns
that are used are decoded.  Fact tables are partitioned by day.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.staging import spread

SCHEMAS = {
    "scan_sessions": (
        "id bigint, name string, created_at timestamp, expires_at timestamp, status string, agent_id string, "
        "policy_id string, entities_protected bigint, tokens_generated bigint"
    ),
    "entities_detected": (
        "id bigint, session_id bigint, entity_type string, original_text string, token string, confidence double, "
        "action string, detected_at timestamp"
    ),
    "policies": (
        "policy_id string, name string, description string, document string, status string, compliance_packs string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "audit_events": (
        "seq bigint, event_id string, event_type string, session_id bigint, agent_id string, agent_role string, "
        "policy_id string, entities_json string, latency_ms double, source_ip string, target_service string, "
        "timestamp timestamp, hash string, prev_hash string"
    ),
    "interceptor_logs": (
        "id bigint, surface string, direction string, agent_id string, payload_preview string, entities_found int, "
        "action_taken string, latency_ms double, timestamp timestamp"
    ),
    "compliance_frameworks": (
        "code string, name string, description string, category string, controls_total int, controls_passing int, "
        "status string, last_assessed timestamp"
    ),
    "compliance_controls": (
        "framework_code string, control_id string, name string, description string, status string, "
        "evidence_type string, last_checked timestamp, remediation_hint string, severity string"
    ),
    "threat_events": (
        "id bigint, threat_type string, severity string, agent_id string, description string, "
        "detection_signal string, response_action string, status string, timestamp timestamp"
    ),
    "settings": (
        "vault_ttl int, session_timeout int, confidence_threshold double, enabled_entity_types array<string>, "
        "notification_email_enabled boolean, notification_slack_enabled boolean, notification_siem_enabled boolean, "
        "notification_webhook_enabled boolean, webhook_url string"
    ),
    "agent_roles": "role_name string, description string, permissions array<string>, is_default boolean",
}

#: How CSV files are written and read: null and the empty text are told apart.
CSV = {"header": True, "escape": '"', "nullValue": "\\N", "emptyValue": '""', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_READ_CSV = CSV | {"multiLine": True, "emptyValue": ""}

# The day column of the fact tables.
TIME_COLUMNS = {
    "scan_sessions": "created_at",
    "entities_detected": "detected_at",
    "audit_events": "timestamp",
    "interceptor_logs": "timestamp",
    "threat_events": "timestamp",
}


def read_table(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """One of the ten tables, from parquet, ORC, JSON lines or CSV."""
    schema = SCHEMAS[name] + (", day date" if name in TIME_COLUMNS and format in ("parquet", "orc") else "")
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.options(**_READ_CSV)
    return reader.format(format).load(path)


def append_table(df: DataFrame, name: str, path: str, format: str = "parquet") -> None:
    """Append rows to a table; fact tables go to one folder per day.

    Rows are gathered by day first, or every task would leave a file in every
    day; AQE splits the days that hold most of the rows.
    """
    time = TIME_COLUMNS.get(name)
    options = CSV if format == "csv" else {}
    if time is None:
        df.write.mode("append").options(**options).format(format).save(path)
        return
    by_day = df.withColumn("day", F.to_date(time)).hint("rebalance", "day")
    by_day.write.mode("append").partitionBy("day").options(**options).format(format).save(path)


#: Bytes of small files that a task reads.
TASK_BYTES = 16 << 20


def read_texts(spark: SparkSession, path: str, format: str = "parquet", text: str = "text") -> DataFrame:
    """Payloads from parquet, ORC, JSON lines, CSV, or whole text files (``path`` and
    content become ``doc_id`` and ``text``)."""
    if format == "text":
        return _whole_files(spark, path)
    reader = spark.read
    if format == "csv":
        reader = reader.options(**_READ_CSV)
    df = reader.format(format).load(path)
    return df if text == "text" else df.withColumnRenamed(text, "text")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as Spark's reader of whole texts gives them.  That sets up a job's
    configuration for every file, so it is kept for those that it unpacks.  Spark deals out
    small files as if they had 4 MB each: a few to a task, which is most of their time.  They
    are put together again by their bytes."""
    files, name = spark.read.format("binaryFile").load(path), F.lower(F.col("_metadata.file_name"))
    packed = F.lit(False)
    for ending in _packed_endings(spark):
        packed |= name.endswith(ending.lower())
    plain = files.where(~packed).select(F.col("_metadata.file_path").alias("doc_id"), F.col("content").cast("string").alias("text"))
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    plain = plain.coalesce(max(size // TASK_BYTES, 8 * spark.sparkContext.defaultParallelism))
    of_folder = files.schema["content"].dataType.simpleString() != "binary"  # folders named content=<value>
    if not of_folder and files.where(packed).select("length").isEmpty():
        return plain
    texts = spark.read.format("text").option("wholetext", True).load(path)
    texts = texts if of_folder else texts.where(packed)
    texts = texts.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return texts if of_folder else plain.union(texts)


def _packed_endings(spark: SparkSession) -> list[str]:
    """Ends of the names of files that Hadoop's readers unpack."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    kinds = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted({hadoop.util.ReflectionUtils.newInstance(kind, conf).getDefaultExtension() for kind in kinds})


def write_texts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", folders: int = 256) -> None:
    """A file for each text that is not null, ended with a line feed:
    ``group=<m>/part=<n>/doc=<id>_<row>.txt``, the row being its place in ``df``.  A group
    has up to 64 folders: Spark lists more than 32 by a job, and what a job sends to the
    driver at once has a limit.

    The tasks write the files where they stay, under names that a repeated task gives
    again: nothing is left for the driver to move, as it would one by one for a folder
    that Spark's writer makes for each document.
    """
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        system, base = pyarrow.fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for key, row, body in zip(*(column.to_pylist() for column in batch.columns)):
                part = zlib.crc32(key.encode()) % folders
                folder = f"{base}/group={part // 64}/part={part}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/doc={key}_{row}.txt") as file:
                    file.write(body.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    key = F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit(""))
    rows = df.where(F.col(text).isNotNull()).select(key.alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("body"))
    spread(rows).mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def write_json(df: DataFrame, path: str) -> None:
    """Export rows as JSON lines in the order they have."""
    df.write.mode("errorifexists").json(path)


def store_scan(entities: DataFrame, counts: DataFrame, sessions_path: str, entities_path: str, now: Column) -> None:
    """Persist a scan: ``entities`` and one session row for each row of ``counts``, both
    as ``protect_texts`` gives them, with the sessions' numbers as ``session_id``."""
    columns = [c.split()[0] for c in SCHEMAS["entities_detected"].split(", ")]
    append_table(entities.select(columns), "entities_detected", entities_path)
    sessions = counts.select(
        F.col("session_id").alias("id"),
        F.concat(F.lit("scan-"), F.date_format(now, "yyyyMMddHHmmss")).alias("name"),
        now.alias("created_at"),
        (now + F.make_interval(hours=F.lit(24))).alias("expires_at"),
        F.lit("ACTIVE").alias("status"),
        "agent_id",
        "policy_id",
        "entities_protected",
        F.col("entities_protected").alias("tokens_generated"),
    )
    append_table(sessions, "scan_sessions", sessions_path)
