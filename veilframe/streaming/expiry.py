"""Events of vault entries that expire, as they expire.

When the watermark passes an entry's end, one event is given and the entry is forgotten,
so the state holds open entries only, and a stream that is restarted gives no event twice.
An entry that comes again with a later end (an extension) is moved; an earlier one changes
nothing.

Entries are kept in groups by a hash of their reference, and a group has one timer in event
time, at its earliest end: a call to the state, which costs far more than a row, is for a
group and not for an entry.  Arrivals are appended unread; a group whose timer passes is
read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession):
    """Streams started inside keep their state in a store that knows timers."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Expiry(StatefulProcessor):
    """Per group: its open entries with their ends in milliseconds, and when to look next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "vault_ref string, ends long, session_id string")
        self._next = handle.getValueState("next", "ends long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = _latest((row["vault_ref"], row["ends"], row["session_id"]) for row in rows)
        self._open.appendList(last)
        known = self._next.get() if self._next.exists() else None
        first = min(ends for _, ends, _ in last)
        if known is None or first < known[0]:
            if known is not None:
                self._handle.deleteTimer(known[0])
            self._look(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        entries = _latest(self._open.get())
        left = [entry for entry in entries if entry[1] > passed]
        if left:
            self._open.put(left)
            self._look(min(ends for _, ends, _ in left))
        else:
            self._open.clear()
            self._next.clear()
        for ref, ends, session in entries:
            if ends <= passed:
                yield Row(vault_ref=ref, session_id=session, ends=ends)

    def _look(self, ends: int) -> None:
        self._handle.registerTimer(ends)
        self._next.update((ends,))

    def close(self) -> None:
        pass


def _latest(entries: Iterable[tuple]) -> list[tuple]:
    """Of every reference the entry with the latest end; of equal ends the first."""
    last: dict = {}
    for entry in entries:
        known = last.get(entry[0])
        if known is None or entry[1] > known[1]:
            last[entry[0]] = entry
    return list(last.values())


def expiry_events(entries: DataFrame, delay: str = "1 hour", groups: int = 4096) -> DataFrame:
    """``vault_ref, session_id, expired_at`` of a stream of entries (``vault_ref, session_id,
    created_at, ttl_seconds``), one row for each when the watermark passes its end; rows
    later than ``delay`` behind the newest entry are dropped.  A null ``ttl_seconds`` or
    ``created_at`` never expires.  To be started within ``timers``.  ``groups`` stays as it is
    while a stream's state lives; the open entries of one are held in memory."""
    ends = F.unix_millis("created_at") + F.col("ttl_seconds").cast("bigint") * 1000
    group = F.pmod(F.xxhash64("vault_ref"), F.lit(groups)).alias("group")
    timed = entries.withWatermark("created_at", delay).select("vault_ref", "session_id", "created_at", ends.alias("ends"), group).where("ends IS NOT NULL")
    schema = StructType().add("vault_ref", "string").add("session_id", "string").add("ends", "long")
    found = timed.groupBy("group").transformWithState(
        statefulProcessor=_Expiry(), outputStructType=schema, outputMode="Append", timeMode="eventTime"
    )
    return found.select("vault_ref", "session_id", F.timestamp_millis("ends").alias("expired_at"))
