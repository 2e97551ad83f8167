"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chunked_bpe, conversation_repair, exact_dedup, gated_lm, lexical_search, line_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_packing": packing.query,
    "op2_gated_lm": gated_lm.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_quality_rules": quality_rules.query,
    "op5_simhash": simhash.query,
    "op6_token_counts": token_counts.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_bpe": bpe.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_chunked_bpe": chunked_bpe.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_lexical_search": lexical_search.query,
    "rule_ablation": quality_rules.ablation_query,
    "token_counts_warm": token_counts.warm_query,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.SQL, "op4_quality_rules": quality_rules.SQL, "rule_ablation": quality_rules.ABLATION_SQL, "op7_line_dedup": line_dedup.SQL, "op10_substring_dedup": substring_dedup.SQL, "op12_conversation_repair": conversation_repair.SQL, "op13_lexical_search": lexical_search.SQL}
