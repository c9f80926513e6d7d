"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from twinlens.llm import exact_dedup, fill_in_middle, hard_negatives, jaccard_join, language_id, line_dedup, mixing, packing, quality_rules, repeats, simhash, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language_id": language_id.op2_language_id,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_simhash": simhash.op12_simhash,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE = {
    "op3_url_filters": url_filter.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op9_suffix_dedup": repeats.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
