"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, langid, line_dedup, mixing, near_dedup, ngram, quality, toxicity, url_rules

QUERIES = {
    "op4_html_text": html_text.op4_html_text,
    "op1_lm_scoring": ngram.op1_lm_scoring,
    "op9_language_id": langid.op9_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op7_url_rules": url_rules.op7_url_rules,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op1_lm_scoring": ngram.OP1_SQL,
    "op7_url_rules": url_rules.OP7_SQL,
    "op3_source_mixing": mixing.OP3_SQL,
    "op5_minhash_near_dedup": near_dedup.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
