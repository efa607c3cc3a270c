"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, chat, fingerprint, mixing, ngram_join, packing, pii, quality, secret_scan, topk, turns, vector_codes, wrappers

QUERIES = {
    "op1_pii_sanitisation": pii.op1_pii_sanitisation,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_html_extraction": wrappers.op8_html_extraction,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_packing": packing.op10_packing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_conversation_repair": turns.op12_conversation_repair,
    "op13_nearest_neighbours": ann.op13_nearest_neighbours,
}
ORACLES = {"op3_ngram_jaccard_join": ngram_join.SQL, "op7_chat_formatting": chat.SQL, "op9_exact_topk": topk.SQL, "op11_vector_codes": vector_codes.SQL, "op12_conversation_repair": turns.SQL}
