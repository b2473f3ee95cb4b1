"""Queries over the test tables, each with the SQL that must give the same rows.

Results are flat: arrays and maps are joined to text and times are formatted, so
that both engines show the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def shown(time: str) -> Column:
    """A time as text; ``shown_sql`` is its counterpart."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def shown_sql(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S')"


def joined(items: Column | str) -> Column:
    return F.array_join(items, "; ")


def shown_map(mapping: str) -> Column:
    entries = F.array_sort(F.map_entries(mapping))
    return joined(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


def mean_sql(expr: str, digits: int, scale: int = 6) -> str:
    """Mean of a non-negative value with ``scale`` decimals, rounded half up, by
    whole numbers only."""
    total, n = f"sum(round({expr} * {10**scale})::HUGEINT)", f"count({expr})"
    return f"((2 * {total} * {10**digits} + {n} * {10**scale}) // (2 * {n} * {10**scale}))::DOUBLE / {10**digits}"
