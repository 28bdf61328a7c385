"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import conversations, decontaminate, hard_negatives, lm_scoring, packing, pii, sentencepiece_viterbi, simhash, substring_dedup, suffix_dedup, token_output, topk_search, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_viterbi.op1_sentencepiece,
    "op2_pii": pii.op2_pii,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_simhash_golay": simhash.op5_simhash_golay,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_toxicity_chain": toxicity.op7_toxicity_chain,
    "op8_context_tree_scoring": lm_scoring.op8_context_tree_scoring,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_wavelet_tokens": token_output.op10_wavelet_tokens,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}
SQL: dict[str, str] = {"op3_decontamination": decontaminate.SQL, "op4_topk_search": topk_search.SQL, "op9_substring_dedup": substring_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL}
