"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Every query runs twice and the second run counts, so that neither the start of
the JVM nor the compilation of patterns is measured.  Results are computed in
full and thrown away (``noop``).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilframe.plans import all_queries

HEADLINE = (
    "det_entities",
    "det_pages",
    "det_conversations",
    "det_top_types",
    "det_residual",
    "vlt_redact",
    "vlt_pseudonymize",
    "vlt_tokenize",
    "vlt_restore",
    "int_assess",
    "int_log_stats",
    "thr_prompt_injection",
    "thr_event_rows",
    "thr_trend",
    "pol_evaluate",
    "pol_conflicts",
    "pol_validate",
    "aud_build_chain",
    "aud_verify",
    "aud_verify_single_chain",
    "aud_entity_types",
    "ses_purge",
    "cmp_assess_frameworks",
    "dsh_stats",
    "dsh_heatmap",
    "str_salami_sliding",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()

    def timed(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(timed(name), 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, tokens = documents.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "detect_docs_per_s": round(docs / seconds["det_entities"]),
                "detect_words_per_s": round(tokens / seconds["det_entities"]),
                "detect_words_per_s_per_core": round(tokens / seconds["det_entities"] / int(cpus)),
                "verify_events_per_s": round(events / seconds["aud_verify_single_chain"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
