"""Compliance frameworks: automated assessment and the reports on its result.  The texts of
findings are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.constants import CONTROLS, FRAMEWORKS, REQUIRED_TYPES
from veilframe.operators.policy import named_frameworks
from veilframe.operators.reports import one_row

_RANKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
COVERAGE_NEEDED, EVENTS_NEEDED = 80, 10


def status_of(passing: Column, total: Column) -> Column:
    share = passing / total
    return (
        F.when(total == 0, "NOT_ASSESSED")
        .when(share > 0.85, "COMPLIANT")
        .when(share > 0.65, "PARTIAL")
        .otherwise("NON_COMPLIANT")
    )


def frameworks(spark: SparkSession) -> DataFrame:
    """The frameworks as shipped (dimension of eight rows)."""
    df = spark.createDataFrame(list(FRAMEWORKS), "code string, category string, controls_total int, controls_passing int")
    return df.withColumn("status", status_of(F.col("controls_passing"), F.col("controls_total")))


def controls(spark: SparkSession) -> DataFrame:
    """The controls as shipped (dimension of seventy rows)."""
    return spark.createDataFrame(
        list(CONTROLS),
        "framework_code string, control_id string, name string, status string, evidence_type string, severity string",
    )


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(_RANKS):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def list_frameworks(frameworks: DataFrame, category: str | None = None) -> DataFrame:
    chosen = frameworks if category is None else frameworks.where(F.col("category") == category)
    return chosen.orderBy("code")


def gaps(controls: DataFrame, limit: int | None = None) -> DataFrame:
    """Failing controls, the most severe first; unknown severities lead."""
    failing = controls.where("status = 'FAIL'").withColumn("rank", severity_rank(F.col("severity")))
    ordered = failing.orderBy(F.asc_nulls_first("rank"), "control_id")
    columns = ["framework_code", "control_id", "name", "severity"] + [c for c in controls.columns if c == "remediation_hint"]
    return (ordered if limit is None else ordered.limit(limit)).select(*columns)


def summary(frameworks: DataFrame) -> DataFrame:
    """One row from the totals stored with the frameworks (gaps: see ``gaps``)."""
    total, passing = F.sum("controls_total"), F.sum("controls_passing")
    return frameworks.agg(
        F.coalesce(F.round(F.when(total > 0, passing / total * 100), 1), F.lit(0.0)).alias("overall_score"),
        F.count("*").alias("frameworks_total"),
        F.count_if(F.col("status") == "COMPLIANT").alias("compliant"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if(F.col("status") == "NON_COMPLIANT").alias("non_compliant"),
        F.coalesce(total, F.lit(0)).alias("controls_total"),
        F.coalesce(passing, F.lit(0)).alias("controls_passing"),
    )


def report(frameworks: DataFrame, controls: DataFrame) -> DataFrame:
    """Per framework (``level`` framework) and in total (``level`` total, the code null),
    how many of its control rows pass, and the controls themselves, by id."""
    status = F.col("c.status")
    columns = ["control_id"] + [c for c in controls.columns if c not in ("control_id", "framework_code")]
    item = F.when(F.col("c.control_id").isNotNull(), F.struct(*[F.col(f"c.{c}").alias(c) for c in columns]))
    joined = frameworks.alias("f").join(controls.alias("c"), F.col("f.code") == F.col("c.framework_code"), "left")
    counted = joined.rollup(F.col("f.code").alias("code")).agg(
        F.grouping_id().alias("gid"),
        F.count("c.control_id").alias("controls"),
        F.count_if(status == "PASS").alias("passing"),
        F.count_if(status == "FAIL").alias("failing"),
        F.array_sort(F.collect_list(item)).alias("rows"),
    )
    score = F.when(F.col("controls") > 0, F.round(F.col("passing") / F.col("controls") * 100, 1)).otherwise(0.0)
    own = F.col("gid") == 0
    return counted.select(
        "code",
        F.when(own, "framework").otherwise("total").alias("level"),
        "controls",
        "passing",
        "failing",
        score.alias("score"),
        F.when(own, F.col("rows")).alias("control_rows"),
    )


def framework_detail(frameworks: DataFrame, controls: DataFrame, code: str) -> DataFrame:
    """The controls of one framework with the framework's own figures."""
    own = frameworks.where(F.col("code") == code).select("code", "category", F.col("status").alias("framework_status"))
    return own.join(controls, F.col("code") == F.col("framework_code")).drop("framework_code").orderBy("control_id")


def facts(entities: DataFrame, events: DataFrame, sessions: DataFrame, policies: DataFrame) -> DataFrame:
    """One row with what the assessment needs to know about the data.  Each table is
    reduced to a handful of values before anything is combined."""
    seen = entities.agg(
        F.collect_set(F.when(F.col("entity_type").isin(*_all_required()), F.col("entity_type"))).alias("types"),
        F.count_if(F.col("action") == "TOKENIZE").alias("tokenized"),
        F.count("*").alias("entities"),
    )
    trail = events.agg(F.count("*").alias("events"))
    erased = sessions.agg(F.count_if(F.col("status") == "PURGED").alias("purged"))
    named = named_frameworks(policies, [f[0] for f in FRAMEWORKS]).agg(F.collect_set("code").alias("named"))
    return one_row(seen, trail, erased, named)


def _all_required() -> list[str]:
    return sorted({t for types in REQUIRED_TYPES.values() for t in types})


def assess_controls(controls: DataFrame, facts: DataFrame) -> DataFrame:
    """Every control with its new status, the coverage of its framework, and the
    finding if it fails."""
    code, evidence = F.col("framework_code"), F.col("evidence_type")
    required = F.array().cast("array<string>")
    for name, types in REQUIRED_TYPES.items():
        required = F.when(code == name, F.lit(list(types))).otherwise(required)
    coverage = F.when(
        F.size("required") > 0, F.round(F.size("covered") / F.size("required") * 100, 1)
    ).otherwise(100.0)
    df = (
        controls.withColumn("_facts", facts.select(F.struct(*facts.columns)).scalar())
        .select(*controls.columns, "_facts.*")
        .withColumn("required", required)
        .withColumn("covered", F.array_sort(F.array_intersect("required", "types")))
        .withColumn("missing", F.array_sort(F.array_except("required", "types")))
        .withColumn("coverage", coverage)
    )
    passed = (
        F.when(evidence == "ENTITY_DETECTION", F.col("coverage") >= COVERAGE_NEEDED)
        .when(evidence == "VAULT_OPERATION", F.col("tokenized") > 0)
        .when(evidence == "AUDIT_TRAIL", F.col("events") >= EVENTS_NEEDED)
        .when(evidence == "ERASURE_CAPABILITY", F.col("purged") > 0)
        .when(evidence == "POLICY_CONFIG", F.array_contains("named", code))
        .otherwise((F.col("events") > 0) & (F.col("entities") > 0))
    )
    reason = (
        F.when(evidence == "ENTITY_DETECTION", F.concat(
            F.lit("Entity coverage "), F.col("coverage").cast("string"), F.lit(f"% < {COVERAGE_NEEDED}% threshold")))
        .when(evidence == "VAULT_OPERATION", "No tokenization operations recorded in vault")
        .when(evidence == "AUDIT_TRAIL", F.concat(
            F.lit("Only "), F.col("events").cast("string"), F.lit(f" audit events (minimum {EVENTS_NEEDED} required)")))
        .when(evidence == "ERASURE_CAPABILITY", "No erasure/purge operations demonstrated")
        .when(evidence == "POLICY_CONFIG", F.concat(F.lit("No active policy references "), code))
        .otherwise("Assessment failed")
    )
    finding = F.concat(F.lit("["), "control_id", F.lit("] "), "name", F.lit(": "), reason)
    return df.withColumn("passed", passed).select(
        *[c for c in controls.columns if c != "status"],
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"),
        F.when(~F.col("passed"), finding).alias("finding"),
        F.col("coverage").alias("entity_coverage_pct"),
        F.col("covered").alias("entity_types_covered"),
        F.col("missing").alias("entity_types_missing"),
        (F.col("tokenized") > 0).alias("vault_active"),
        F.col("events").alias("audit_trail_count"),
    )


def assess_frameworks(assessed: DataFrame) -> DataFrame:
    """The result of the assessment per framework."""
    total = F.count("*")
    passing = F.count_if(F.col("status") == "PASS")
    return assessed.groupBy(F.col("framework_code").alias("code")).agg(
        status_of(passing, total).alias("status"),
        total.alias("controls_total"),
        passing.alias("controls_passing"),
        (total - passing).alias("controls_failing"),
        F.first("entity_coverage_pct").alias("entity_coverage_pct"),
        F.first("entity_types_covered").alias("entity_types_covered"),
        F.first("entity_types_missing").alias("entity_types_missing"),
        F.first("vault_active").alias("vault_active"),
        F.first("audit_trail_count").alias("audit_trail_count"),
        F.array_sort(F.collect_list("finding")).alias("findings"),
    )


def apply_assessment(frameworks: DataFrame, result: DataFrame) -> DataFrame:
    """Frameworks with the passing count and status of the assessment."""
    fresh = result.select("code", F.col("controls_passing").alias("_p"), F.col("status").alias("_s"))
    return frameworks.join(fresh, "code", "left").select(
        "code",
        "category",
        "controls_total",
        F.coalesce("_p", "controls_passing").alias("controls_passing"),
        F.coalesce("_s", "status").alias("status"),
    )
