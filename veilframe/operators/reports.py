"""Shapes that several reports share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(column: Column | str, digits: int) -> Column:
    """A rounded mean that is summed as a decimal: sums of doubles depend on the
    order in which tasks finish, and so would a value on the rounding edge."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(F.avg(value.cast("decimal(20,6)")), digits).cast("double")


def in_period(df: DataFrame, time: str, date_from, date_to) -> DataFrame:
    """Rows of a period; a table partitioned by ``day`` reads only the days in it."""
    for bound, keeps, day_keeps in (
        (date_from, F.col(time) >= F.lit(date_from), lambda day: day >= F.to_date(F.lit(date_from))),
        (date_to, F.col(time) <= F.lit(date_to), lambda day: day <= F.to_date(F.lit(date_to))),
    ):
        if bound is not None:
            df = df.where(keeps)
            df = df.where(day_keeps(F.col("day"))) if "day" in df.columns else df
    return df


def latest_days(df: DataFrame, days: int) -> DataFrame:
    """The latest days that have rows, of a table partitioned by ``day``; other tables
    as they are.  Only the days' names are looked up before (``days`` rows)."""
    if "day" not in df.columns:
        return df
    named = df.select("day").where("day IS NOT NULL").distinct().orderBy(F.desc("day")).limit(days).collect()
    return df.where(F.col("day") >= F.lit(min(r.day for r in named))) if named else df


def chosen(df: DataFrame, equal: Mapping[str, object], time: str, date_from, date_to) -> DataFrame:
    """Rows that meet the filters that are set."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return in_period(df, time, date_from, date_to)


def newest(
    df: DataFrame,
    equal: Mapping[str, object],
    time: str,
    tiebreak: str,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """A page of the rows that meet the filters, newest first.

    ``after``: the time and tie-breaker of the last row of the page before.  Such a page is
    as cheap as the first one: later days are not read, and only ``limit`` rows are kept,
    where ``offset`` sorts and holds all rows it skips.  Rows without a time come last."""
    if after is not None:
        if offset:
            raise ValueError("a page follows a row or skips rows, not both")
        df = _older(df, time, tiebreak, *after)
    page = chosen(df, equal, time, date_from, date_to).orderBy(F.desc(time), F.desc(tiebreak))
    return page.offset(offset).limit(limit) if offset else page.limit(limit)


def _older(df: DataFrame, time: str, tiebreak: str, last_time, last_id) -> DataFrame:
    """Rows that follow a row in the order of ``newest``."""
    smaller = F.col(tiebreak) < F.lit(last_id)
    if last_time is None:
        return df.where(F.col(time).isNull() & smaller)
    at = F.lit(last_time)
    df = df.where((F.col(time) < at) | ((F.col(time) == at) & smaller) | F.col(time).isNull())
    return df.where((F.col("day") <= F.to_date(at)) | F.col("day").isNull()) if "day" in df.columns else df


def counts_by(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``dimension, value, n`` for each dimension, from a single scan; null values
    are left out.  Counts are combined before the shuffle, so a value that holds
    most rows is as cheap as any other."""
    columns = [F.col(d).cast("string").alias(d) for d in dimensions]
    sets = [[F.col(d)] for d in dimensions]
    grouped = df.select(*columns).groupingSets(sets, *dimensions).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    width = len(dimensions)
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(dimensions):
        # grouping_id has a 0 bit for the one column that was grouped by.
        mine = F.col("gid") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        dimension = F.when(mine, name).otherwise(dimension)
        value = F.when(mine, F.col(name)).otherwise(value)
    out = grouped.select(dimension.alias("dimension"), value.alias("value"), "n")
    return out.where(F.col("value").isNotNull())


def one_row(*parts: DataFrame) -> DataFrame:
    """Frames of one row each, side by side, without a join: their rows are stacked and
    the only value of every column is taken."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def hour_of(time: Column | str) -> Column:
    return F.date_trunc("hour", time)


def latest_hours(df: DataFrame, time: str, hours: int = 24) -> DataFrame:
    """Row counts of the latest hours that have rows, newest first."""
    counts = latest_days(df, hours).groupBy(hour_of(time).alias("hour")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("hour")).limit(hours)
