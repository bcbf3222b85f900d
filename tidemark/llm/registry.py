"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_token_counts, op2_license_scans, op3_token_ids, op4_chat_formatting, op5_suffix_array_dedup, op6_substring_dedup, op7_ngram_jaccard_join, op8_packing, op9_benchmark_decontamination, op10_quality_rules, op11_exact_topk, op12_collocations, op13_fill_in_middle


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts.query,
        "op2_license_scans": op2_license_scans.query,
        "op3_token_ids": op3_token_ids.query,
        "op4_chat_formatting": op4_chat_formatting.query,
        "op5_suffix_array_dedup": op5_suffix_array_dedup.query,
        "op6_substring_dedup": op6_substring_dedup.query,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join.query,
        "op8_packing": op8_packing.query,
        "op9_benchmark_decontamination": op9_benchmark_decontamination.query,
        "op10_quality_rules": op10_quality_rules.query,
        "op11_exact_topk": op11_exact_topk.query,
        "op12_collocations": op12_collocations.query,
        "op13_fill_in_middle": op13_fill_in_middle.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": op4_chat_formatting.ORACLE,
        "op6_substring_dedup": op6_substring_dedup.ORACLE,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join.ORACLE,
        "op11_exact_topk": op11_exact_topk.ORACLE,
        "op12_collocations": op12_collocations.ORACLE,
        "op13_fill_in_middle": op13_fill_in_middle.ORACLE,
    }
