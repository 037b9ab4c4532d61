"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from silvagrid.llm import bpe, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, minhash, mixing, pii, substring_dedup


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_suffix_array_dedup": substring_dedup.op2_suffix_array_dedup,
        "op3_html_extraction": html_text.op3_html_extraction,
        "op4_pii": pii.op4_pii,
        "op5_bpe": bpe.op5_bpe,
        "op6_language_id": language_id.op6_language_id,
        "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_source_mixing": mixing.op9_source_mixing,
        "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL}
