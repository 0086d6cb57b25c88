"""Queries of the corpus operators and their DuckDB oracles, by name."""

from __future__ import annotations

from fieldwork.llm import bpe, jaccard_join, language_model, licenses, mixing, neighbours, ordinal, prefix_trie, quality_rules, substring_dedup, surrogates, token_alignment, token_shards

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_pii_surrogates": surrogates.op2_pii_surrogates,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_lm_score": language_model.op5_lm_score,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_shards": token_shards.op8_token_shards,
    "op9_quality_classifier": ordinal.op9_quality_classifier,
    "op10_nearest": neighbours.op10_nearest,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_cross_tokenizer": token_alignment.op12_cross_tokenizer,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op10_nearest": neighbours.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
