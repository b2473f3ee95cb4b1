"""Order-dependent values without one task per key.

A window over a key sorts that key in one task, which fails when a key holds a
third of all rows, and a window without a key puts everything into one.  Here
positions are integers and are cut into buckets of ``width`` positions: windows
run inside a bucket, and what crosses a bucket border is worked out on one row
per bucket, again in buckets, until little is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.sources.staging import stage

WIDTH = 4096


def positions(df: DataFrame, order: str, output: str = "position") -> DataFrame:
    """Add ``output``: the row's place from 0 in the order of ``order`` (unique), whatever
    its values and gaps.  Rows are sorted by ranges and kept, as the ranges are drawn
    anew in every run; then only the ranges' row counts are added up."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    kept = stage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition
    return kept.join(F.broadcast(starts), "_range").withColumn(output, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def _bucket(position: str, width: int) -> Column:
    return F.expr(f"`{position}` div {int(width)}")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    output: str,
    order: Sequence[Column] = (),
    width: int = WIDTH,
    levels: int = 2,
) -> DataFrame:
    """Add ``output``: the sum of ``value`` up to and including the row, per
    ``keys``, by ``position`` and then ``order``."""
    by = [F.col(position), *order]
    if levels == 0:
        full = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(output, F.sum(value).over(full))
    bucket = f"_bucket{levels}"
    df = df.withColumn(bucket, _bucket(position, width))
    inside = Window.partitionBy(*keys, bucket).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    totals = running_total(totals, keys, bucket, "_total", "_upto", width=width, levels=levels - 1)
    before = totals.select(*keys, bucket, (F.col("_upto") - F.col("_total")).alias("_before"))
    return (
        df.withColumn("_in", F.sum(value).over(inside))
        .join(before, [*keys, bucket])
        .withColumn(output, F.col("_before") + F.col("_in"))
        .drop(bucket, "_in", "_before")
    )


def previous(df: DataFrame, order: str, value: str, output: str, width: int = WIDTH) -> DataFrame:
    """Add ``output``: ``value`` of the row just before in the order of ``order`` (unique,
    any gaps); null for the first row."""
    df = positions(df, order, "_position").withColumn("_bucket", F.expr(f"_position div {int(width)}"))
    inside = Window.partitionBy("_bucket").orderBy("_position")
    ends = df.groupBy("_bucket").agg(F.max_by(value, "_position").alias("_carry")).withColumn("_bucket", F.col("_bucket") + 1)
    return (
        df.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(ends, "_bucket", "left")
        .withColumn(output, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_bucket", "_position", "_lag", "_first", "_carry")
    )
