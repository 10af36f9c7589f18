"""The subpackage's queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import decontamination, exact_dedup, language_id, near_dedup, substring_dedup, subword_sampling, token_files, tool_calls, toxicity, url_rules

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_files": token_files.op2_token_files,
    "op3_url_filter": url_rules.op3_url_filter,
    "op4_language_id": language_id.op4_language_id,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_tool_calls": tool_calls.op8_tool_calls,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_subword_sampling": subword_sampling.op10_subword_sampling,
}

ORACLE_SQL = {
    "op3_url_filter": url_rules.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_tool_calls": tool_calls.ORACLE,
}
