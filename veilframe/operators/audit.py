"""The audit trail: hash chains, their verification, and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.constants import GENESIS_HASH
from veilframe.functions.dialect import strip
from veilframe.functions.ordered import WIDTH, positions, previous
from veilframe.operators.reports import chosen, counts_by, hour_of, mean, newest, one_row
from veilframe.sources.staging import stage_files

#: Events in a segment; segments, and groups of them, in a group of the next level.
SEGMENT_ROWS = 1024
FAN = 1024
LEVELS = 2


def event_hash(prev_hash: Column, event_id: Column, event_type: Column, timestamp: Column) -> Column:
    return F.sha2(F.concat(event_id, event_type, timestamp, prev_hash), 256)


def timestamp_text(time: Column) -> Column:
    """ISO form as it enters the hash, always with microseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def build_chain(
    events: DataFrame, seals: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS, position: Column | None = None
) -> DataFrame:
    """Add ``segment, prev_hash, hash`` to events with a unique, sortable ``seq``.

    Events are cut into segments of ``segment_rows`` rows in the order of ``seq``, of any
    spacing.  Inside a segment every event points to the hash of the one before.  The
    first event of a segment points to its *start*, the first start being the genesis
    hash.  A start is the hash of the start before and of a digest of all that the
    segment before holds; the first segment of a group of ``FAN`` takes the start of its
    group, made in the same way from the group before, and so on for ``LEVELS`` levels.
    So each event depends on all events before it, and segments are hashed in parallel.
    A table within one segment is the plain chain.

    ``seals``: those of the events already written (see ``seal_segments``); the new
    events then begin a segment after the last one.

    ``position``: the place from 0 of each event in the order of ``seq``, where that is
    known (after ``number_events``); else the events are sorted for it.
    """
    first = 0
    if seals is not None:
        first = seals.agg(F.coalesce(F.max("segment") + 1, F.lit(0))).first()[0]
    placed = positions(events, "seq") if position is None else events.withColumn("position", position)
    placed = placed.withColumn("segment", F.expr(f"{int(first)} + position div {int(segment_rows)}")).drop("position")
    # What is hashed rides along with the rows: one shuffle gives rows and digests.
    head = F.concat("event_id", "event_type", timestamp_text(F.col("timestamp")))
    rows = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("_seq"), head.alias("head"), F.struct(*placed.columns).alias("row"))))
    segments = placed.groupBy("segment").agg(rows.alias("_rows")).withColumn("digest", _digest(F.col("_rows")["head"]))
    segments = stage_files(segments, "segments")
    last = segments.agg(F.coalesce(F.max("segment"), F.lit(first))).first()[0]
    level, base = _reach(max(first - 1, 0), last)
    blocks, start = segments.select(F.col("segment").alias("no"), "digest"), GENESIS_HASH
    if first:
        sealed = seals.where(F.col("segment") >= base)
        start = sealed.where(F.col("segment") == base).first()["start"]
        blocks = blocks.union(sealed.select("segment", "digest"))
    starts = _starts(blocks, level, start).where(F.col("no") >= first).select(F.col("no").alias("segment"), F.col("start").alias("_start"))
    width = len(GENESIS_HASH)

    def nth(i):
        return F.decode(F.substring("_hashes", i * width + 1, F.lit(width)), "UTF-8")

    def link(hashes, e):
        before = F.decode(F.substring(hashes, F.lit(-width), F.lit(width)), "UTF-8")
        return F.concat(hashes, F.encode(F.sha2(F.concat(e["head"], before), 256), "UTF-8"))

    # All hashes of a segment in one byte string, the start first: a fold copies its state at every
    # step, and bytes are the cheapest thing to copy.  The rows ride along: no join back to the events.
    hashes = F.aggregate("_rows", F.encode("_start", "UTF-8"), link)
    return (
        segments.join(starts, "segment")
        .select("_rows", F.explode(F.array(hashes)).alias("_hashes"))
        .select("_hashes", F.posexplode("_rows").alias("_i", "_e"))
        .select("_e.row.*", nth(F.col("_i")).alias("prev_hash"), nth(F.col("_i") + 1).alias("hash"))
    )


def number_events(events: DataFrame, after: int) -> DataFrame:
    """Add ``seq`` from ``after`` + 1 to events that are to be chained, by their ids."""
    return positions(events, "event_id").withColumn("seq", F.col("position") + F.lit(after + 1)).drop("position")


def segment_digests(events: DataFrame, *more: Column) -> DataFrame:
    """``segment, n`` and ``digest`` of what its events hold, in order; with ``more``
    aggregates."""
    content = F.sha2(F.concat("event_id", "event_type", timestamp_text(F.col("timestamp"))), 256)
    each = F.array_sort(F.collect_list(F.struct("seq", content.alias("content"))))
    return events.groupBy("segment").agg(F.count("*").alias("n"), F.sha2(F.array_join(each["content"], ""), 256).alias("digest"), *more)


def _digest(heads: Column) -> Column:
    """The digest of a segment by what its events hold."""
    return F.sha2(F.array_join(F.transform(heads, lambda h: F.sha2(h, 256)), ""), 256)


def _reach(first: int, last: int) -> tuple[int, int]:
    """Levels needed to go from segment ``first`` to ``last``, and the first segment of the
    block that holds both.  Its start is that of all blocks that begin with it."""
    for level in range(LEVELS):
        size = FAN ** (level + 1)
        if first // size == last // size:
            return level, first // size * size
    return LEVELS, 0


def _sealed(start: Column, digest: Column) -> Column:
    return F.sha2(F.concat(start, digest), 256)


def _group(blocks: DataFrame, level: int) -> DataFrame:
    return blocks.withColumn("group", F.expr(f"no div {FAN}") if level else F.lit(0).cast("bigint"))


def _starts(blocks: DataFrame, level: int, start: str = GENESIS_HASH) -> DataFrame:
    """``no, start`` for blocks ``no, digest`` numbered without gaps, the first of which
    has the given start."""
    grouped = _group(blocks, level).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("no", "digest"))).alias("items"))
    if level:
        above = grouped.select(F.col("group").alias("no"), F.sha2(F.array_join("items.digest", ""), 256).alias("digest"))
        grouped = grouped.join(_starts(above, level - 1, start).withColumnRenamed("no", "group"), "group")
    else:
        grouped = grouped.withColumn("start", F.lit(start))
    states = F.aggregate(
        "items", F.array("start"), lambda done, x: F.concat(done, F.array(_sealed(F.element_at(done, F.lit(-1)), x["digest"])))
    )
    items = grouped.select(F.explode(F.array(states)).alias("states"), "items").select("states", F.posexplode("items").alias("i", "x"))
    return items.select("x.no", F.get("states", F.col("i")).alias("start"))


def seal_segments(chained: DataFrame, *more: Column) -> DataFrame:
    """One row per segment, to be kept apart from the events: ``segment, n, digest`` and
    its ``start``.  They tell what was written, so that even a cut-off end is seen, and
    new events are chained after them; with ``more`` aggregates."""
    return segment_digests(chained, F.min_by("prev_hash", "seq").alias("start"), *more)


def _expected(blocks: DataFrame, level: int, base: int = 0, start: str = GENESIS_HASH) -> DataFrame:
    """``no, expected``: the start that each block should have by the starts and digests
    of the blocks there are, block ``base`` having the given one; null for a block whose
    forerunner is missing."""
    blocks = _group(blocks, level)
    if level:
        above = blocks.groupBy("group").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("no", "digest")))["digest"], ""), 256).alias("digest"),
            F.min_by("start", "no").alias("start"),
        )
        above = _expected(above.withColumnRenamed("group", "no"), level - 1, base // FAN, start)
        blocks = blocks.join(above.select(F.col("no").alias("group"), F.col("expected").alias("given")), "group")
        opens = F.col("no") % FAN == 0
    else:
        blocks, opens = blocks.withColumn("given", F.lit(start)), F.col("no") == base
    inside = Window.partitionBy("group").orderBy("no")
    follows = F.lag("no").over(inside) == F.col("no") - 1
    sealed = _sealed(F.lag("start").over(inside), F.lag("digest").over(inside))
    return blocks.select("no", F.when(follows, sealed).when(opens, F.col("given")).alias("expected"))


def check_links(chained: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every event with the hash it should point to and whether it does.

    ``link_ok`` compares ``prev_hash`` with the hash of the event before in its segment;
    for the first of a segment with the start that follows from what the segments before
    hold (null, and not ok, if the one before is missing).  A table without the column
    ``segment`` is one plain chain, whose first event has nothing to compare with.
    ``hash_ok`` recomputes the hash.
    """
    if "segment" in chained.columns:
        head = F.concat("event_id", "event_type", timestamp_text(F.col("timestamp")))
        row = F.struct(F.col("seq").alias("_seq"), head.alias("head"), F.struct(*chained.columns).alias("row"))
        # one shuffle gives links, digests and starts
        segments = chained.groupBy("segment").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        segments = segments.withColumns({"digest": _digest(F.col("_rows")["head"]), "start": F.get("_rows", F.lit(0))["row"]["prev_hash"]})
        segments = stage_files(segments, "segments")
        last = segments.agg(F.coalesce(F.max("segment"), F.lit(0))).first()[0]
        starts = _expected(segments.select(F.col("segment").alias("no"), "digest", "start"), _reach(0, last)[0])

        def paired(r: Column, i: Column) -> Column:
            before = F.when(i == 0, F.col("expected")).otherwise(F.get("_rows", i - 1)["row"]["hash"])
            return F.struct(r["row"].alias("row"), before.alias("before"))

        df = segments.join(starts.withColumnRenamed("no", "segment"), "segment").select(F.explode(F.transform("_rows", paired)).alias("_e"))
        df = df.select("_e.row.*", F.col("_e.before").alias("expected_prev_hash"))
        link_ok = F.coalesce(F.col("prev_hash") == F.col("expected_prev_hash"), F.lit(False))
    else:
        df = previous(chained, "seq", "hash", "expected_prev_hash", width)
        link_ok = F.coalesce(F.col("prev_hash") == F.col("expected_prev_hash"), F.lit(True))
    rehashed = event_hash(F.col("prev_hash"), F.col("event_id"), F.col("event_type"), timestamp_text(F.col("timestamp")))
    return df.withColumns({"link_ok": link_ok, "hash_ok": F.coalesce(rehashed == F.col("hash"), F.lit(False))})


def check_segments(chained: DataFrame) -> DataFrame:
    """One row per segment of a chain: ``segment, n``, its ``digest`` and ``start`` as they
    are, ``broken`` links inside it, ``wrong_hashes``, and its first and last event (structs
    of ``seq, event_id``).  Only what is hashed is shuffled, once."""
    head = F.concat("event_id", "event_type", timestamp_text(F.col("timestamp")))
    right = F.coalesce(event_hash(F.col("prev_hash"), F.col("event_id"), F.col("event_type"), timestamp_text(F.col("timestamp"))) == F.col("hash"), F.lit(False))
    row = F.struct("seq", head.alias("head"), "prev_hash", "hash", right.alias("right"), "event_id")
    segments = chained.groupBy("segment").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def link_ok(r: Column, i: Column) -> Column:
        return (i == 0) | F.coalesce(r["prev_hash"] == F.get("_rows", i - 1)["hash"], F.lit(False))

    def end(i: Column) -> Column:
        e = F.get("_rows", i)
        return F.struct(e["seq"].alias("seq"), e["event_id"].alias("event_id"))

    return segments.select(
        "segment",
        F.size("_rows").cast("bigint").alias("n"),
        _digest(F.col("_rows")["head"]).alias("digest"),
        F.get("_rows", F.lit(0))["prev_hash"].alias("start"),
        F.size(F.filter(F.transform("_rows", link_ok), lambda ok: ~ok)).alias("broken"),
        F.size(F.filter("_rows", lambda r: ~r["right"])).alias("wrong_hashes"),
        end(F.lit(0)).alias("first"),
        end(F.size("_rows") - 1).alias("last"),
    )


def verify_segments(checked: DataFrame, seals: DataFrame | None = None) -> DataFrame:
    """``verify`` from the rows of ``check_segments``, of a whole chain or, with the
    ``seals`` of the segments before (verified earlier), of those after them."""
    checked = stage_files(checked, "checked")
    first, last = checked.agg(F.min("segment"), F.max("segment")).first()
    base, level, start = 0, LEVELS, GENESIS_HASH
    blocks = checked.select(F.col("segment").alias("no"), "digest", "start")
    if last is not None:
        level, base = _reach(first - 1 if seals is not None and first else 0, last)
        if seals is not None and first:
            before = seals.where(F.col("segment").between(base, first - 1)).select("segment", "digest", "start")
            opening = before.where(F.col("segment") == base).first()
            start = opening["start"] if opening else GENESIS_HASH
            blocks = blocks.union(before)
        else:
            base = 0
    expected = _expected(blocks, level, base, start).withColumnRenamed("no", "segment")
    bad_start = F.coalesce(F.col("start") != F.col("expected"), F.lit(True)).cast("int")
    total = checked.join(expected, "segment", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.col("broken") + bad_start), F.lit(0)).alias("broken_links"),
        F.coalesce(F.sum("wrong_hashes"), F.lit(0)).alias("wrong_hashes"),
        F.min("first")["event_id"].alias("first_event"),
        F.max("last")["event_id"].alias("last_event"),
    )
    return total.select((F.col("broken_links") == 0).alias("verified"), *total.columns)


def verify_chain(chained: DataFrame) -> DataFrame:
    """The same figures as ``verify`` of ``check_links``, where its rows are not wanted: a
    row per segment is all that is kept."""
    return verify_segments(check_segments(chained))


def changed_segments(chained: DataFrame, seals: DataFrame) -> DataFrame:
    """Sealed segments that the table lacks or holds otherwise, the last one too:
    ``segment, n`` (rows sealed), ``found`` (rows there) and ``state`` (missing or changed)."""
    there = seal_segments(chained).select("segment", F.col("n").alias("found"), F.col("digest").alias("_digest"), F.col("start").alias("_start"))
    both = seals.join(there, "segment", "left")
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("start").eqNullSafe(F.col("_start"))
    state = F.when(F.col("_digest").isNull(), "missing").otherwise("changed")
    return both.where(~same).select("segment", "n", F.coalesce("found", F.lit(0)).alias("found"), state.alias("state"))


def broken_links(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("link_ok")).select(
        "seq", "event_id", "expected_prev_hash", F.col("prev_hash").alias("actual_prev_hash")
    )


def verify(checked: DataFrame) -> DataFrame:
    """One row: is the chain whole, how long is it, where does it begin and end."""
    return checked.agg(
        (F.count_if(~F.col("link_ok")) == 0).alias("verified"),
        F.count("*").alias("total_events"),
        F.count_if(~F.col("link_ok")).alias("broken_links"),
        F.count_if(~F.col("hash_ok")).alias("wrong_hashes"),
        F.min_by("event_id", "seq").alias("first_event"),
        F.max_by("event_id", "seq").alias("last_event"),
    )


def with_neighbours(events: DataFrame) -> DataFrame:
    """Every chained event with the hashes of the events before and after it; null at
    the ends of the chain.  Inside a segment they are the rows beside it; across a
    border, the end of the last segment before and the first row of the next."""
    inside = Window.partitionBy("segment").orderBy("seq")
    ends = events.groupBy("segment").agg(F.min_by("hash", "seq").alias("head"), F.max_by("hash", "seq").alias("tail"))
    around = ends.select(F.col("segment") + 1, F.col("tail").alias("_tail")), ends.select(F.col("segment") - 1, F.col("head").alias("_head"))
    return (
        events.withColumns({"_lag": F.lag("hash").over(inside), "_lead": F.lead("hash").over(inside)})
        .join(around[0].toDF("segment", "_tail"), "segment", "left")
        .join(around[1].toDF("segment", "_head"), "segment", "left")
        .withColumns({"prev_event_hash": F.coalesce("_lag", "_tail"), "next_event_hash": F.coalesce("_lead", "_head")})
        .drop("_lag", "_lead", "_tail", "_head")
    )


def neighbours_by_hash(events: DataFrame, start_hashes: DataFrame | None = None) -> DataFrame:
    """Every event with what a look-up of hashes finds, whatever the order and place of the
    rows: ``prev_event`` (id of the event whose hash it points to; the first by ``seq``, if
    several have it), ``next_event`` (id of the first event that points to it) and
    ``followers`` (how many do; more than one is a fork).  ``orphan`` tells that it points
    to a hash that nobody has.

    The genesis hash, and the starts of segments (``start_hashes``: a column ``start``, as
    ``seal_segments`` gives them), are hashes of no event: they take part in no join and
    make no orphans.  Both sides of a join have one row per hash, so a hash that many rows
    share multiplies nothing."""
    at = F.struct("seq", "event_id")
    points = F.col("prev_hash").isNotNull() & (F.col("prev_hash") != GENESIS_HASH)
    if start_hashes is not None:
        starts = start_hashes.select(F.col("start").alias("prev_hash")).where(F.col("prev_hash").isNotNull()).distinct().withColumn("_starts", F.lit(True))
        events = events.join(starts, "prev_hash", "left")
        points &= F.col("_starts").isNull()
    keyed = events.select("*", F.when(points, F.col("prev_hash")).alias("_to"))
    owners = events.where(F.col("hash").isNotNull()).groupBy(F.col("hash").alias("_to")).agg(F.min(at)["event_id"].alias("prev_event"))
    followers = keyed.where(F.col("_to").isNotNull()).groupBy(F.col("_to").alias("hash")).agg(
        F.min(at)["event_id"].alias("next_event"), F.count("*").alias("followers")
    )
    found = keyed.join(owners, "_to", "left").join(followers, "hash", "left")
    return found.withColumns(
        {"followers": F.coalesce("followers", F.lit(0)), "orphan": F.col("_to").isNotNull() & F.col("prev_event").isNull()}
    ).drop("_to", "_starts")


def forks(events: DataFrame, start_hashes: DataFrame | None = None) -> DataFrame:
    """The events of a fork: ``event_id`` and the ``follower``s of events that have more
    than one, a row each."""
    found = neighbours_by_hash(events, start_hashes).where("followers > 1")
    owners = found.groupBy("hash").agg(F.min(F.struct("seq", "event_id"))["event_id"].alias("event_id"))
    return events.select(F.col("prev_hash").alias("hash"), F.col("event_id").alias("follower")).join(owners, "hash").select("event_id", "follower")


def entity_types(entities_json: Column) -> Column:
    """Entity types named in ``entities_json``: a list of objects with ``type``, a
    list of scalars, or one comma-separated string; null for anything else."""
    doc = F.try_parse_json(entities_json)
    items = F.try_variant_get(doc, "$", "array<variant>")

    def name(x):
        is_object = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
        of_object = F.when(is_object, F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("UNKNOWN")))
        return F.coalesce(of_object, F.try_variant_get(x, "$", "string"))

    words = F.filter(F.transform(F.split(F.try_variant_get(doc, "$", "string"), ","), lambda w: strip(w)), lambda w: w != "")
    is_text = F.schema_of_variant(doc) == "STRING"
    return F.when(items.isNotNull(), F.transform(items, name)).when(is_text, words)


def list_events(
    events: DataFrame,
    event_type: str | None = None,
    agent_id: str | None = None,
    session_id: int | None = None,
    policy_id: str | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    entity_type: str | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """A page of events, newest first; ``after``: see ``reports.newest``."""
    equal = {"event_type": event_type, "agent_id": agent_id, "session_id": session_id, "policy_id": policy_id}
    if entity_type is not None:
        events = events.where(F.array_contains(entity_types(F.col("entities_json")), entity_type))
    return newest(events, equal, "timestamp", "seq", date_from, date_to, limit, offset, after)


def export_events(
    events: DataFrame,
    event_type: str | None = None,
    agent_id: str | None = None,
    session_id: int | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
) -> DataFrame:
    """All events that meet the filters, newest first (see ``sinks.write_json``)."""
    equal = {"event_type": event_type, "agent_id": agent_id, "session_id": session_id}
    return chosen(events, equal, "timestamp", date_from, date_to).orderBy(F.desc("timestamp"), F.desc("seq"))


def stats(events: DataFrame) -> DataFrame:
    """Counts by event type and agent: ``dimension, value, n``."""
    return counts_by(events, ["event_type", "agent_id"])


def entity_type_counts(events: DataFrame) -> DataFrame:
    """How often each entity type is named in the events."""
    named = events.where("entities_json IS NOT NULL").select(F.explode(entity_types(F.col("entities_json"))).alias("entity_type"))
    return named.groupBy("entity_type").agg(F.count("*").alias("n"))


def totals(events: DataFrame) -> DataFrame:
    """One row: totals, mean latency, latest hour (``peak_hour``) and busiest hour."""
    hourly = events.groupBy(hour_of("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    peaks = hourly.agg(
        F.max("hour").alias("peak_hour"),
        F.max(F.struct(F.col("n"), F.col("hour")))["hour"].alias("busiest_hour"),
    )
    whole = events.agg(
        F.count("*").alias("total"),
        F.coalesce(mean("latency_ms", 1), F.lit(0.0)).alias("avg_latency"),
        F.countDistinct("agent_id").alias("unique_agents"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )
    return one_row(whole, peaks)


def agents(events: DataFrame) -> DataFrame:
    """Events per agent, busiest first."""
    counts = events.where("agent_id IS NOT NULL").groupBy("agent_id").agg(F.count("*").alias("event_count"))
    return counts.orderBy(F.desc("event_count"), "agent_id")


def session_trail(events: DataFrame, session_id) -> DataFrame:
    """The events of one session, oldest first."""
    return events.where(F.col("session_id") == F.lit(session_id)).orderBy("timestamp", "seq")
