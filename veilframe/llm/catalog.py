"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from veilframe.llm import queries as q

QUERIES = {
    "op1_warc": q.op1_warc,
    "op2_lm_score": q.op2_lm_score,
    "op3_mixing": q.op3_mixing,
    "op4_quality_rules": q.op4_quality_rules,
    "op5_license_scan": q.op5_license_scan,
    "op6_language_id": q.op6_language_id,
    "op7_sentencepiece": q.op7_sentencepiece,
    "op8_near_dedup": q.op8_near_dedup,
    "op9_nearest": q.op9_nearest,
    "op10_url_filter": q.op10_url_filter,
    "op11_resample": q.op11_resample,
    "op12_periodic_runs": q.op12_periodic_runs,
    "op13_personal_data": q.op13_personal_data,
}

SQL = {
    "op1_warc": q.OP1_SQL,
    "op3_mixing": q.OP3_SQL,
    "op10_url_filter": q.OP10_SQL,
    "op11_resample": q.OP11_SQL,
    "op12_periodic_runs": q.OP12_SQL,
}
