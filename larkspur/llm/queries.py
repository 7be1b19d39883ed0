"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import extraction, mixing, near, packing, pii, repeats, rules, sites, tokens, topk

QUERIES = {
    "op1_html_extraction": extraction.op1_html_extraction,
    "op5_quality_classifier": sites.op5_quality_classifier,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op2_substring_dedup": repeats.op2_substring_dedup,
    "op3_token_counts": tokens.op3_token_counts,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op4_quality_rules": rules.op4_quality_rules,
    "op9_ngram_jaccard_join": near.op9_ngram_jaccard_join,
}

SQL = {
    "op6_exact_top_k": topk.SQL,
    "op2_substring_dedup": repeats.SQL,
    "op4_quality_rules": rules.SQL,
    "op9_ngram_jaccard_join": near.SQL,
}
