"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from corpusloom.llm import bpe, decontaminate, exact_dedup, hard_negatives, language_model, license_scan, line_dedup, near_dedup, quality, sentence_pieces, source_audit, substring_dedup, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_lm_scoring": language_model.op9_lm_scoring,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_sentence_pieces": sentence_pieces.op13_sentence_pieces,
}

#: None of the others can be said in SQL; their tests hold them against brute force.
ORACLE_SQL = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
