"""Near duplicates by fast similarity sketches, banding and exact verification.

1. A map over Arrow batches gives each text its set of word shingles, the set's
   128-bit key and a sketch.  Round ``i`` of the sketch throws every shingle into a
   hashed bin with the value ``i + fraction``; bins keep their least value and rounds
   end when none is empty; after as many rounds as bins, round ``t + j`` fills bin ``j``
   alone.  So every coordinate is filled, however small the set, and the share of equal
   coordinates concentrates about the similarity.
2. Equal sets are one class.  Copies cost one row each and go no further.
3. Classes that agree on a band meet in its bucket.  A bucket's members are compared
   with one hub, the member that meets most others in all its buckets, and not with each
   other; links that hold on the full sets are joined to components.
4. Buckets that still span several components may hide links between members other than
   the hub.  Members of such buckets are compared with all that share a hub with them and
   belong to another component: each pair once, in blocks of bounded size, by a longer
   sketch of a bit a coordinate inside the join, so that only pairs near the limit become
   rows.  Pairs inside a component need no check: they cannot change it.

With 32 bands of 4 coordinates a pair at similarity 0.8 shares no band with a chance
of 4e-8.  Of the pairs that share one, those whose sketches agree in fewer than
``MIN_EQUAL`` of 128 coordinates (in step 4, in ``MIN_EQUAL_BITS`` of 4096 bits) are left
out, which a pair at 0.8 does with a chance of 1e-7; all others are decided exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import slices, utf8, written
from veilframe.llm.words import LOWER, distinct, mix, ngrams, numbers, word_bounds, word_hashes

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Equal coordinates of a pair that is worth reading its full sets; 102 are expected
#: at similarity 0.8, with a standard deviation of 4.5.
MIN_EQUAL = 78
#: Bits of the longer sketch; 3686 equal ones are expected at 0.8, give or take 19.2.
BITS, MIN_EQUAL_BITS = 4096, 3586
#: Members of a hub that one task compares with as many others.
BLOCK_MEMBERS = 1024
SLICE_BYTES = 4 << 20

_ROUNDS = numbers(2 * BITS, 11)
_PLACE = numbers(ROWS, 12)
_BAND = numbers(BANDS, 13)
_EMPTY = np.uint64(2**64 - 1)
#: Bands and screens are made for this similarity and above.
MIN_PERCENT = 80


def _known(percent: int) -> int:
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {MIN_PERCENT} to 100: bands and screens would miss pairs below")
    return percent


def sketches(doc: np.ndarray, shingles: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """``(n_docs, bins)`` fast similarity sketches (``bins`` a power of two); rows of empty
    sets are all-ones."""
    least = np.full(n_docs * bins, _EMPTY)
    shift = np.uint64(64 - (bins - 1).bit_length())
    work = 0
    for i in range(2 * bins):
        x = mix(shingles ^ _ROUNDS[i])
        at = (x >> shift).astype(np.int64) if i < bins else i - bins
        np.minimum.at(least, doc * bins + at, (x & np.uint64(2**48 - 1)) | np.uint64(i << 48))
        work += len(doc)
        if work >= least.size:  # full sketches can't change: they are looked for now and then
            work = 0
            open_docs = (least.reshape(n_docs, bins) == _EMPTY).any(1)[doc]
            doc, shingles = doc[open_docs], shingles[open_docs]
        if not len(doc):
            break
    return least.reshape(n_docs, bins)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, shingle)``, distinct and sorted, of texts with A-Z in lower case."""
    data = LOWER[data]
    starts, ends, docs = word_bounds(offsets, data)
    return distinct(*ngrams(word_hashes(data, starts, ends), docs, k, whole_if_shorter=True))[:2]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """``id``, ``n`` (set size), ``key`` of the set (null if empty), ``bands``, and the
    ``sketch`` cut to 16 bits a coordinate."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                offsets, data = utf8(part.column("text"))
                doc, shingles = shingle_sets(offsets, data, k)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keys = [set_key(shingles[a:b]) if a < b else None for a, b in zip(bounds, bounds[1:])]
                values = sketches(doc, shingles, part.num_rows)
                short = mix(values).astype(np.uint16)
                values = values.reshape(-1, BANDS, ROWS)
                bands = mix((values * _PLACE).sum(2, dtype=np.uint64) ^ _BAND).astype(np.int64).ravel()
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.array(np.diff(bounds)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands)),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["id", "n", "key", "bands", "sketch"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"id {kind}, n long, key binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``key`` and ``shingles`` of the wanted classes (``id``, ``key``), read again
    from the texts of their representatives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                doc, shingles = shingle_sets(*utf8(part.column("text")), k)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                # a repeated id brings other texts, too: the set's own key tells them apart
                own = [set_key(shingles[a:b]) == key for a, b, key in zip(bounds, bounds[1:], part.column("key").to_pylist())]
                sets = pa.ListArray.from_arrays(bounds, pa.array(shingles.astype(np.int64)))
                yield pa.record_batch([part.column("key"), sets], ["key", "shingles"]).filter(pa.array(own, pa.bool_()))

    found = docs.join(wanted, "id").select("key", "text").mapInArrow(read, "key binary, shingles array<long>")
    return found.dropDuplicates(["key"])


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in ``MIN_EQUAL`` coordinates."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"{x}_sketch").to_pylist()), np.uint16).reshape(-1, BINS) for x in "ab")
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= MIN_EQUAL))

    for x in "ab":
        known = classes.select(F.col("key").alias(f"{x}_key"), F.col("sketch").alias(f"{x}_sketch"))
        pairs = pairs.join(known, F.col(f"{x}.key") == F.col(f"{x}_key")).drop(f"{x}_key")
    return pairs.select("a", "b", "a_sketch", "b_sketch").mapInArrow(compare, pairs.select("a", "b").schema)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``, the ids of the pairs whose full sets are similar enough."""
    for x in "ab":
        own = sets.select(F.col("key").alias(f"{x}_key"), F.col("shingles").alias(f"{x}_set"))
        pairs = pairs.join(own, F.col(f"{x}.key") == F.col(f"{x}_key"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    near = pairs.where(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common))
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of all ids in links ``(a, b)``,
    by alternating large and small stars; each round is written to shared storage."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    before = _digest(edges)
    while True:
        # large star: every greater neighbour is tied to the least of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, are tied to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v").distinct()
        edges = written(small, "edges")
        after = _digest(edges)
        if before == after:
            ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.union(edges.select(F.col("v"), F.col("v")).distinct())
        before = after


def _digest(edges: DataFrame):
    """Tells two sets of distinct edges apart."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()


def _linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``id`` and ``component`` of the classes that are linked with others."""
    member = F.struct("id", "n", "key")
    rows = classes.select(member.alias("x"), F.explode("bands").alias("hash"))
    sizes = rows.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1")
    buckets = written(rows.join(sizes, "hash"), "buckets")
    degrees = buckets.groupBy("x").agg(F.sum("m").alias("degree"))
    sets = written(full_sets(docs, degrees.select("x.id", "x.key"), k), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("y", "z").alias("a"), F.greatest("y", "z").alias("b")).where("a != b")
        pairs = pairs.where(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)").distinct()
        pairs = written(_promising(pairs, classes), "near-pairs")
        return written(_verified(sets, pairs, percent), "links")

    ranked = buckets.join(degrees.withColumnRenamed("x", "y"), F.col("x") == F.col("y")).select("hash", "x", "degree")
    hubs = ranked.groupBy("hash").agg(F.min_by("x", F.struct(-F.col("degree"), "x")).alias("z"))
    met = written(buckets.join(hubs, "hash").select("hash", "m", "x", "z"), "met")
    links = links_of(met.select(F.col("x").alias("y"), "z"))
    labels = written(components(links), "components")

    left = written(_open_members(met, labels), "open-members")
    if left.isEmpty():
        return labels
    blocks = _blocks(left.join(_long_sketches(left, sets), F.col("x.key") == F.col("key")).drop("key"), left.count())
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    blocks = written(blocks, "blocks")
    mine = blocks.withColumn("theirs", every)
    other = blocks.select([F.col(c).alias(c if c != "own" else "theirs") for c in blocks.columns]).withColumn("own", every)
    keys = ["part", "own", "theirs"]
    schema = blocks.select(F.col("x").alias("a"), F.col("x").alias("b")).schema
    pairs = mine.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(lambda a, b: _near_blocks(a, b, percent), schema)
    more = written(_verified(sets, written(pairs, "near-pairs"), percent), "links")
    if more.isEmpty():
        return labels
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return written(components(known.union(more)), "components")


def _open_members(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``x``, ``component`` and all ``hubs`` of the members of buckets with several
    components.  A bucket of two members has been decided by its one pair."""
    own = labels.select(F.col("id").alias("x_id"), "component")
    told = met.where("m > 2").join(own, F.col("x.id") == F.col("x_id"), "left")
    told = told.select("hash", "x", F.col("z.key").alias("hub"), F.coalesce("component", F.col("x.id")).alias("component"))
    span = told.groupBy("hash").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d")
    return told.join(span.select("hash"), "hash").groupBy("x", "component").agg(F.collect_set("hub").alias("hubs"))


def _blocks(members: DataFrame, n_members: int) -> DataFrame:
    """A row for each hub of a member, with its block ``own`` among the hub's ``n_blocks``.
    Hubs of one block share ``part`` with others, the rest have a part of their own."""
    rows = members.select("*", F.explode("hubs").alias("hub"))
    sizes = rows.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("n_blocks"))
    shared = F.pmod(F.xxhash64("hub"), F.lit(n_members // BLOCK_MEMBERS + 1)).cast("string")
    own = F.pmod(F.xxhash64("x.key"), F.col("n_blocks")).cast("int")
    return rows.join(sizes, "hub").withColumns({"own": own, "part": F.when(F.col("n_blocks") == 1, shared).otherwise(F.hex("hub"))})


def _near_blocks(mine: pa.Table, other: pa.Table, percent: int) -> pa.Table:
    """Pairs ``(a, b)`` of members of one hub and two components whose long sketches agree
    enough; a pair with several hubs is given at the least of them."""

    def parts(table: pa.Table):
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        sizes = np.array([x["n"] for x in table.column("x").to_pylist()], np.int64)
        by_hub: dict[bytes, list[int]] = {}
        for i, hub in enumerate(table.column("hub").to_pylist()):
            by_hub.setdefault(hub, []).append(i)
        components = [tuple(c.values()) if isinstance(c, dict) else c for c in table.column("component").to_pylist()]
        return bits, sizes, by_hub, table.column("hubs").to_pylist(), components

    if not mine.num_rows or not other.num_rows:
        return pa.table({"a": mine.column("x").slice(0, 0), "b": mine.column("x").slice(0, 0)})
    (bits, n, hubs, all_hubs, own), (bits2, n2, hubs2, all_hubs2, theirs) = parts(mine), parts(other)
    codes = {c: i for i, c in enumerate(sorted({*own, *theirs}))}
    code, code2 = np.array([codes[c] for c in own]), np.array([codes[c] for c in theirs])
    left, right = [], []
    for hub in hubs.keys() & hubs2.keys():
        a, b = np.array(hubs[hub]), np.array(hubs2[hub])
        for rows in np.array_split(a, len(a) * len(b) // 100_000 + 1):
            i, j = np.nonzero(code[rows][:, None] < code2[b][None, :])
            i, j = rows[i], b[j]
            fits = 100 * np.minimum(n[i], n2[j]) >= percent * np.maximum(n[i], n2[j])
            i, j = i[fits], j[fits]
            equal = BITS - np.bitwise_count(bits[i] ^ bits2[j]).sum(1, dtype=np.int64)
            for p, q in zip(i[equal >= MIN_EQUAL_BITS].tolist(), j[equal >= MIN_EQUAL_BITS].tolist()):
                if min(set(all_hubs[p]) & set(all_hubs2[q])) == hub:
                    left.append(p)
                    right.append(q)
    return pa.table({"a": mine.column("x").take(pa.array(left, pa.int64())), "b": other.column("x").take(pa.array(right, pa.int64()))})


def _long_sketches(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``key`` and ``bits`` of the members' sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column("shingles")
                shingles = column.flatten().to_numpy().view(np.uint64)
                doc = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
                bits = mix(sketches(doc, shingles, batch.num_rows, BITS)) & np.uint64(1)
                words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * words.shape[1]
                yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(words.ravel()))], ["key", "bits"])

    wanted = members.select(F.col("x.key").alias("key"))
    return sets.join(wanted, "key", "left_semi").mapInArrow(sign, "key binary, bits array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are compared by their sets of distinct ``k``-word shingles (A-Z in lower
    case; fewer words make one shingle; texts without words, and null, have the empty
    set and no links).  Documents are linked if 100 * intersection >= percent * union
    (``percent`` from ``MIN_PERCENT`` to 100);
    ``component_id`` is the smallest id reachable and ``kept`` tells the document that
    has it.  Rows with equal sets are one class; classes whose smallest id is the same
    count as one.  A row with a null id belongs to the component of its text, if rows
    with ids have a similar one, else it is kept with a null ``component_id``."""
    percent = _known(percent)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = written(sketched(source, k), "sketches")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("m"))
    classes = written(classes, "classes")
    labels = _linked(source, classes.where("id IS NOT NULL"), k, percent)
    # classes of one row without links need no lookup: they are their own component
    known = classes.select("key", "id", "m").join(labels, "id", "left").where("m > 1 OR component IS NOT NULL")
    known = known.select("key", F.coalesce("component", "id").alias("component"))
    # an empty set has no key; keys of their own keep such rows apart
    alone = F.concat(F.lit("empty "), F.xxhash64("id").cast("string")).cast("binary")
    out = rows.select("id", "n", F.coalesce("key", alone).alias("key")).join(known, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component, null ids
    last.

    A document is an id with a text: an id may have several texts, and rows with the same
    id and text all stay; of those without an id one stays.  Texts without words all
    stay.  What goes is joined, the smaller table."""
    words = F.col(text).cast("string")
    document = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(words).alias("text"))
    judged = near_duplicates(docs.select(document.alias("document"), words.alias("text")), k, percent, "document", "text")
    documents = judged.where("n_shingles > 0").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("m"))
    dropped = documents.where("NOT kept OR m > 1 AND doc_id.none").select(F.col("doc_id").alias("dropped"), "kept")
    stay = docs.join(dropped.select("dropped"), document == F.col("dropped"), "left_anti")
    # copies without an id that are to leave one row
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    copies = docs.where(F.col(doc_id).isNull()).select(document.alias("document"), row.alias("row"))
    copies = copies.join(dropped.where("kept").select("dropped"), F.col("document") == F.col("dropped"), "left_semi")
    return stay.union(copies.groupBy("document").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
