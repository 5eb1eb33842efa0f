"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, importance, jaccard_join, language, mixing, pii, quality_rules, substring_dedup, url_filters

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_quality_classifier": importance.op7_quality_classifier,
    "op8_pii": pii.op8_pii,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language.op10_language_id,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_chat_format": chat.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
}
