"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from slidejobs.llm import bpe, chat_tree, collocations, exact_dedup, filter_audit, lm_score, near_dedup, packing, pii, quality, token_counts, url_filter, winnowing


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_packing": packing.op4_packing,
        "op5_quality": quality.op5_quality,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_chat_tree": chat_tree.op7_chat_tree,
        "op8_winnowing": winnowing.op8_winnowing,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_collocations": collocations.op12_collocations,
        "op13_pii": pii.op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op9_url_filter": url_filter.SQL, "op11_filter_audit": filter_audit.SQL, "op12_collocations": collocations.SQL, "op13_pii": pii.SQL}
