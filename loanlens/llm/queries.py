"""Queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from . import chat, exact, langid, lexical, lm, packing, phrases, pieces, pii, quality, simhash, substring, topk

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_log_bilinear_lm": lm.op2_log_bilinear_lm,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_pii_spans": pii.op4_pii_spans,
    "op5_norm_sorted_topk": topk.op5_norm_sorted_topk,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_simhash_trie": simhash.op7_simhash_trie,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_chat_collapse": chat.op9_chat_collapse,
    "op10_word_first_langid": langid.op10_word_first_langid,
    "op11_presence_mask_search": lexical.op11_presence_mask_search,
    "op12_multikey_phrases": phrases.op12_multikey_phrases,
    "op13_digest_index": exact.op13_digest_index,
}
ORACLES = {
    "op5_norm_sorted_topk": topk.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_chat_collapse": chat.ORACLE,
    "op11_presence_mask_search": lexical.ORACLE,
    "op12_multikey_phrases": phrases.ORACLE,
    "op13_digest_index": exact.ORACLE,
}
