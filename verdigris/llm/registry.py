"""Queries of the training-data operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embeddings, exact_dedup, language, line_dedup, packing, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": language.op9_language_id,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
}
