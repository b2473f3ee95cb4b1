"""Appending micro-batches of a stream to stored tables, each batch once.

A stream that is restarted runs its last batch again.  A batch's rows are written beside
the table first and then moved in, under names with the batch's number; a mark tells the
last batch that came in whole.  A batch that was cut off while its rows were written is
written again, one cut off while they were moved is finished, and one that is marked is
left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators import audit
from veilframe.sources.rewrite import Files
from veilframe.sources.staging import stage
from veilframe.sources.tables import SCHEMAS, TIME_COLUMNS

_WAITING, _MARKS = "_batch-", "_batches-"


def append_batch(df: DataFrame, name: str, path: str, batch: int, stream: str = "stream") -> bool:
    """Append a stream's batch to one of the ten tables, in folders by day; False if it was
    there already.  Batches of a ``stream`` come in the order of their numbers."""
    spark = df.sparkSession
    files, root = Files(spark, path), path.rstrip("/")
    if last_batch(spark, path, stream) >= batch:
        return False
    waiting = f"{root}/{_WAITING}{stream}-{batch}"
    if not files.exists(f"{waiting}/_SUCCESS"):
        time = TIME_COLUMNS.get(name)
        writer = df.withColumn("day", F.to_date(time)).hint("rebalance", "day").write.partitionBy("day") if time else df.write
        writer.mode("overwrite").parquet(waiting)
    for file in files.files(waiting):
        folder, _, base = file.rpartition("/")
        files.move(f"{waiting}/{file}", "/".join(filter(None, (root, folder, f"{stream}-{batch}-{base}"))))
    files.mark(f"{root}/{_MARKS}{stream}", batch)
    files.delete(waiting)
    return True


def last_batch(spark: SparkSession, path: str, stream: str = "stream") -> int:
    """The number of the stream's last batch in a table, -1 if there is none."""
    return Files(spark, path).last_mark(f"{path.rstrip('/')}/{_MARKS}{stream}")


def append_stream(df: DataFrame, name: str, path: str, checkpoint: str, stream: str = "stream") -> StreamingQuery:
    """Run a stream over all that is there and append its rows to one of the ten tables."""
    return (
        df.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, name, path, batch, stream) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- chained audit events

#: Events are kept by day and batch, their seals by batch.
_KEYS = ", segment bigint, day date, batch bigint"
_SEALS = "segment bigint, n bigint, digest string, start string, last_seq bigint, batch bigint"
_STATES = "batch bigint, segment bigint, total_events bigint, first_event string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not Files(spark, path).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_seals(spark: SparkSession, path: str) -> DataFrame:
    """The seals of a stored chain (see ``audit.seal_segments``), with their batch."""
    return _read(spark, f"{path.rstrip('/')}/seals", _SEALS)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The events of a stored chain, those of sealed batches; a batch that was cut off is
    not there yet."""
    sealed = read_seals(spark, path).agg(F.max("batch")).first()[0]
    events = _read(spark, f"{path.rstrip('/')}/events", SCHEMAS["audit_events"] + _KEYS)
    return events.where(F.col("batch") <= F.lit(-1 if sealed is None else sealed))


def append_chain(events: DataFrame, path: str, batch: int, segment_rows: int = audit.SEGMENT_ROWS) -> bool:
    """Number and chain a batch of audit events (columns of ``audit_events`` but ``seq``,
    ``hash`` and ``prev_hash``; missing ones are null) after the stored chain; False if the
    batch was there already.

    The batch's events go to folders of their own, which a second run of the batch fills
    anew.  Its seals are written last: they make the batch part of the chain.  Of the old
    chain only seals are read, from the block on that the new segments are in."""
    spark, root = events.sparkSession, path.rstrip("/")
    seals = read_seals(spark, path)
    done, after = seals.agg(F.max("batch"), F.max("last_seq")).first()
    if done is not None and done >= batch:
        return False
    after = after or 0
    numbered = audit.number_events(events, after)
    # The numbers have no gaps: they tell the places, and the events are sorted once.
    chained = audit.build_chain(numbered, None if done is None else seals, segment_rows, F.col("seq") - F.lit(after + 1))
    null = F.lit(None)
    kinds = [c.split() for c in SCHEMAS["audit_events"].split(", ")]
    columns = [(F.col(c) if c in chained.columns else null).cast(kind).alias(c) for c, kind in kinds]
    rows = chained.select(*columns, "segment", F.to_date("timestamp").alias("day"), F.lit(batch).cast("bigint").alias("batch"))
    writer = rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day", "batch")
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/events")
    own = _read(spark, f"{root}/events", SCHEMAS["audit_events"] + _KEYS).where(F.col("batch") == batch)
    audit.seal_segments(own, F.max("seq").alias("last_seq")).write.mode("overwrite").parquet(f"{root}/seals/batch={batch}")
    return True


def append_chain_stream(events: DataFrame, path: str, checkpoint: str, segment_rows: int = audit.SEGMENT_ROWS) -> StreamingQuery:
    """Run a stream of audit events over all that is there, each batch chained after those
    before it."""
    return (
        events.writeStream.foreachBatch(lambda rows, batch: append_chain(rows, path, batch, segment_rows) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def new_events(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The events of a stored chain since the last check that found it whole, and the state
    that check left.  Folders of older batches are not read."""
    states = _read(spark, f"{path.rstrip('/')}/verified", _STATES)
    row = states.orderBy(F.desc("batch")).first()
    state = row.asDict() if row else {"batch": -1, "segment": -1, "total_events": 0, "first_event": None}
    return read_chain(spark, path).where(F.col("batch") > F.lit(state["batch"])), state


def verify_new(spark: SparkSession, path: str) -> DataFrame:
    """Check what was appended since the last check: one row with ``verified`` (nothing
    broken, and new segments are as they were sealed), ``new_events``, ``total_events``,
    ``broken_links``, ``wrong_hashes``, ``changed_segments``, ``first_event, last_event``
    and the last ``batch`` read.  If the chain is whole, the state is stored for next time.

    What was checked before is not looked at again: a change there is found by
    ``audit.verify_chain`` of all events and ``audit.changed_segments``."""
    events, state = new_events(spark, path)
    seals = read_seals(spark, path)
    checked = stage(audit.check_segments(events))
    before = seals.where(F.col("segment") <= F.lit(state["segment"])) if state["segment"] >= 0 else None
    now = seals.where(F.col("batch") > F.lit(state["batch"]))
    same = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.start").eqNullSafe(F.col("b.start"))
    changed = now.alias("a").join(checked.alias("b"), "segment", "left").where(~same).count()
    batch, segment = now.agg(F.max("batch"), F.max("segment")).first()
    row = audit.verify_segments(checked, before).first()
    report = {
        "verified": row.verified and row.wrong_hashes == 0 and not changed,
        "new_events": row.total_events,
        "total_events": state["total_events"] + row.total_events,
        "broken_links": row.broken_links,
        "wrong_hashes": row.wrong_hashes,
        "changed_segments": changed,
        "first_event": state["first_event"] or row.first_event,
        "last_event": row.last_event,
        "batch": state["batch"] if batch is None else batch,
    }
    if report["verified"] and batch is not None:
        new = [(batch, segment, report["total_events"], report["first_event"])]
        spark.createDataFrame(new, _STATES).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/verified")
    schema = (
        "verified boolean, new_events bigint, total_events bigint, broken_links bigint, wrong_hashes bigint, "
        "changed_segments bigint, first_event string, last_event string, batch bigint"
    )
    return spark.createDataFrame([tuple(report.values())], schema)
