"""Operators over streams.  Interception (``operators.intercept``) is stateless and
takes a streaming DataFrame as it is; the ones below keep state, bounded by the
watermark.  All take batch DataFrames too, where the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.operators.intercept import intercept, log_rows

MIN_TYPES, MIN_ENTITIES = 2, 3


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    format: str = "parquet",
    names: str | None = None,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """New files of a folder, or of what a path pattern meets, as a stream; ``names`` is a
    pattern for file names."""
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", names) if names else reader).load(folder)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet"):
    """Run a stream over everything that is there, then stop."""
    return (
        df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )


def intercept_log(payloads: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Interceptor log rows of a stream of payloads."""
    return log_rows(intercept(payloads, rules))


def _by(time: str, window: str, slide: str | None) -> Column:
    return F.window(time, window, slide) if slide else F.window(time, window)


def drop_repeats(events: DataFrame, time: str = "timestamp", key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeat is not later than ``delay``."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def hourly_counts(events: DataFrame, *keys: str, time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Rows per hour and ``keys``; rows later than ``delay`` are dropped."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), *keys, "n")


def _slicing(grouped) -> DataFrame:
    figures = grouped.agg(F.count("*").alias("entities"), F.collect_set("entity_type").alias("types"))
    return figures.withColumn("types", F.array_sort("types"))


def salami_windows(
    detections: DataFrame,
    agent: str = "agent_id",
    time: str = "timestamp",
    window: str = "1 hour",
    slide: str | None = "15 minutes",
    delay: str = "1 hour",
    min_types: int = MIN_TYPES,
    min_entities: int = MIN_ENTITIES,
) -> DataFrame:
    """Agents that collect many kinds of entities within a window of time.

    One row per agent and window that reaches both thresholds.  The set of types
    is bounded by the registry; counts are combined before the shuffle.
    """
    grouped = detections.withWatermark(time, delay).groupBy(_by(time, window, slide), agent)
    return (
        _slicing(grouped)
        .where((F.size("types") >= min_types) & (F.col("entities") >= min_entities))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), agent, "entities", "types")
    )


def salami_sessions(
    detections: DataFrame,
    agent: str = "agent_id",
    time: str = "timestamp",
    gap: str = "30 minutes",
    delay: str = "1 hour",
    min_types: int = MIN_TYPES,
    min_entities: int = MIN_ENTITIES,
) -> DataFrame:
    """The same over bursts: windows that end after ``gap`` without an entity.

    In batch, events are first put together by agent and stretches of ``gap`` from fixed
    points: what lies in one stretch is of one burst, so this is a plain count, combined
    before the shuffle, however busy an agent is.  Bursts are then stretches whose ends are
    ``gap`` apart or less, on one row for each agent and stretch.  In a stream, Spark's
    session windows give the same rows; with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set it merges
    the bursts of a busy agent before the shuffle.
    """
    found = _sessions(detections, agent, time, gap, delay) if detections.isStreaming else _bursts(detections, agent, time, gap)
    return found.where((F.size("types") >= min_types) & (F.col("entities") >= min_entities))


def _sessions(detections: DataFrame, agent: str, time: str, gap: str, delay: str) -> DataFrame:
    grouped = detections.withWatermark(time, delay).groupBy(F.session_window(time, gap), agent)
    window = F.col("session_window")
    return _slicing(grouped).select(window["start"].alias("window_start"), window["end"].alias("window_end"), agent, "entities", "types")


def _bursts(detections: DataFrame, agent: str, time: str, gap: str) -> DataFrame:
    length = F.expr(f"INTERVAL '{gap}'")
    stretches = detections.groupBy(F.window(time, gap), agent).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_set("entity_type")).alias("kinds")
    )
    order = Window.partitionBy(agent).orderBy("first")
    opens = F.coalesce(F.col("first") > F.lag("last").over(order) + length, F.lit(True))
    numbered = stretches.withColumn("opens", opens.cast("int")).withColumn("burst", F.sum("opens").over(order))
    whole = numbered.groupBy(agent, "burst").agg(
        F.min("first").alias("window_start"),
        (F.max("last") + length).alias("window_end"),
        F.sum("n").alias("entities"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("types"),
    )
    return whole.select("window_start", "window_end", agent, "entities", "types")


def open_entries(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Vault entries that have not expired (``created_at, ttl_seconds``); without
    ``now`` the clock of each batch counts."""
    at = F.current_timestamp() if now is None else now
    return entries.where(at <= F.col("created_at") + F.make_interval(secs=F.col("ttl_seconds")))
