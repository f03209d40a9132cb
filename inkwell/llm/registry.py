"""The queries of this folder and their SQL."""

from __future__ import annotations

from inkwell.llm import chat, exact_dedup, jaccard_join, language, line_dedup, line_frequency, mixing, packing, pipeline, sharding, token_count


def queries() -> dict:
    return {
        "op1_min_cost_resharding": sharding.op1_min_cost_resharding,
        "op2_line_frequency": line_frequency.op2_line_frequency,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_fuzzy_line_dedup": line_dedup.op4_fuzzy_line_dedup,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_token_count": token_count.op6_token_count,
        "op7_budgeted_chat": chat.op7_budgeted_chat,
        "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
        "op9_language_id": language.op9_language_id,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op10_exact_dedup": exact_dedup.ORACLE, "pipeline": pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
