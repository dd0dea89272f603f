"""The queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from meshwork.llm import bytespans, chat, decontaminate, langid, mixing, quality, secrets, simhash, substrings, warc

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_language_id": langid.op2_language_id,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_suffix_array_dedup": bytespans.op9_suffix_array_dedup,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_suffix_array_dedup": bytespans.OP9_SQL,
}
