"""URL rules by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule fitting it could have:
the host's suffixes with as many labels as some rule's host, each with the path's
prefixes as long as some rule's path.  The expressions meet the rules in an
equi-join on the first four bytes of their SHA-256; the full digest then confirms,
and of the confirmed rules the longest wins.  The expansion is bounded by the
rules (label counts times path lengths), never by the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares: four bytes.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; empty for a null URL or one without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def make_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from ``(host, path, verdict)``, where the verdict is allow or block."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``
    (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's
    path.  The longest rule (host and path together) wins, then the longer host,
    then block before allow.  Without a rule the verdict is ``default`` and the
    rule null.  Null URLs, and URLs without ``://``, have an empty host and path
    and fit no rule.  Every input row gives one row, repeated rows too.  Rules with
    a null host, path or verdict are left out; with no rules all get ``default``.
    """
    keyed = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))
    rules = rules.dropna(subset=["host", "path", "verdict"])
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path")).alias("lengths"),
    ).first()  # distinct label counts and path lengths: a few numbers
    expression = F.concat(F.col("host"), F.col("path"))
    rules = rules.select(
        expression.alias("rule"), "verdict", F.char_length("host").alias("host_length"), F.sha2(expression, 256).alias("rule_digest")
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))

    # a URL is judged once, however many rows have it; those without a host fit nothing
    urls = keyed.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''").distinct()
    n_labels = F.size(F.split("host", r"\."))
    hosts = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in sorted(shapes["labels"])]))
    paths = F.array_compact(
        F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes["lengths"])])
    )
    if not shapes["labels"]:
        hosts = paths = F.array().cast("array<string>")
    found = (
        urls.select("url", F.explode(hosts).alias("suffix"), paths.alias("paths"))
        .select("url", "suffix", F.explode("paths").alias("part"))
        .withColumn("digest", F.sha2(F.concat("suffix", "part"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .join(rules, "prefix")
        .where("digest = rule_digest AND concat(suffix, part) = rule AND char_length(suffix) = host_length")
        .groupBy("url")
        .agg(F.max(F.struct(F.char_length("rule"), "host_length", "verdict", "rule")).alias("best"))
    )
    new = ("host", "path", "rule", "verdict")
    return keyed.join(found, "url", "left").select(
        *[F.col("row")[c].alias(c) for c in pages.columns if c not in new],
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
