"""Mixing sources to target weights by Poisson replication.

A source with ``n`` rows that is to have the share ``w`` of ``total`` rows gets the
mean repetition rate ``w * total / n``.  Each document's count is drawn from the
Poisson distribution of that mean, by inverting it at a number hashed from the seed
and the document, so a task that runs twice draws the same count.  Documents are
exploded by their counts and dealt out by a hash of document and copy: a global
shuffle whose partitions are even, whatever the share of one source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Means above this are drawn as sums of independent Poisson numbers.
PART_MEAN = 16
#: Longest tabulated count of a part; P(X > 80) is under 1e-27 for a mean of 16.
PART_COUNT = 80


def _draw(seed: int, key: Column, part: Column) -> Column:
    """A number in (0, 1) with 53 bits, from the MD5 of seed, document and part."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), part.cast("string"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: Mapping[str, float], other: float, source: str, total: int | None) -> DataFrame:
    """One row per weighted source (and one, null, for all others): its rows and its
    mean repetition rate.  Shares are of the groups that have rows.  At most
    ``len(weights) + 1`` rows."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("group")], F.lit(float(other)))
    counts = docs.groupBy(_group(source, weights).alias("group")).agg(F.count("*").alias("n")).withColumn("weight", weight)
    everything = Window.partitionBy(F.lit(0))
    goal = F.sum("n").over(everything) if total is None else F.lit(total)
    rate = F.col("weight") / F.sum("weight").over(everything) * goal / F.col("n")
    return counts.select("group", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _group(source: str, weights: Mapping[str, float]) -> Column:
    return F.when(F.col(source).isin(*weights), F.col(source))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    other: float = 0.0,
    total: int | None = None,
    seed: int = 0,
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Documents repeated so that sources have the target shares, in random order.

    ``weights``: share of each source, in any unit; ``other``: share of all other
    sources together, null among them (0: they are not wanted); ``total``: expected
    number of rows (None: as many as there are).  Returns the columns of ``docs``
    with ``copy`` (from 1) and ``mix_key`` (hex text; rows are sorted by it within
    partitions that a hash of it fills), replacing columns of these names.

    A null ``doc_id`` is replaced by a hash of the row's values in the draw.  Rows
    with the same id have the same count.  An empty table gives an empty one.
    """
    if not weights or min(*weights.values(), other) < 0 or not any([*weights.values(), other]):
        raise ValueError("weights are non-negative and not all zero")
    mean = F.col("rate") / F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART_MEAN))
    first = F.exp(-mean)
    # cdf[k] = P(X <= k), by the recurrence p(k) = p(k - 1) * mean / k
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(PART_COUNT)),
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            (s["sum"] + s["p"] * mean / k).alias("sum"),
            F.concat(s["cdf"], F.array(s["sum"] + s["p"] * mean / k)).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    rates = source_rates(docs, weights, other, source, total).select(
        F.col("group").alias("rate_group"), F.ceil(F.col("rate") / PART_MEAN).cast("int").alias("parts"), table.alias("cdf")
    )
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("row "), F.md5(F.to_json(F.struct("*")))))
    keyed = docs.select(F.struct("*").alias("row"), _group(source, weights).alias("group"), key.alias("key"))
    # the broadcast table has len(weights) + 1 rows at most, by construction
    drawn = keyed.join(F.broadcast(rates), F.col("group").eqNullSafe(F.col("rate_group"))).withColumn(
        "copies",
        F.aggregate(
            F.when(F.col("parts") > 0, F.sequence(F.lit(1), F.col("parts"))).otherwise(F.array().cast("array<int>")),
            F.lit(0),
            lambda n, part: n + F.size(F.filter("cdf", lambda c: c < _draw(seed, F.col("key"), part))),
        ),
    )
    copies = drawn.where("copies > 0").select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    mixed = copies.select("row", "copy", F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} order"), "copy", "key")), 1, 16).alias("mix_key"))
    shuffled = mixed.repartition("mix_key").sortWithinPartitions("mix_key")
    kept = [F.col("row")[name].alias(name) for name in docs.columns if name not in ("copy", "mix_key")]
    return shuffled.select(*kept, "copy", "mix_key")
