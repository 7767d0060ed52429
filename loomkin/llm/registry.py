"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from loomkin.llm import chat, decontaminate, lines, ngram_join, packing, pii, quality, sharding, suffix, urls


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_url_filters": urls.op2_url_filters,
        "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_chat_preference": chat.op5_chat_preference,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_minimax_sharding": sharding.op8_minimax_sharding,
        "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
        "op10_pii_deobfuscation": pii.op10_pii_deobfuscation,
    }


def oracle_sql() -> dict:
    return {
        "op2_url_filters": urls.OP2_SQL,
        "op3_benchmark_decontamination": decontaminate.OP3_SQL,
        "op4_suffix_dedup": suffix.OP4_SQL,
        "op5_chat_preference": chat.OP5_SQL,
        "op6_line_dedup": lines.OP6_SQL,
        "op7_quality_rules": quality.OP7_SQL,
        "op8_minimax_sharding": sharding.OP8_SQL,
        "op9_ngram_jaccard": ngram_join.OP9_SQL,
    }
