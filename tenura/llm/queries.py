"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenura.llm import decontaminate, exact_dedup, html_text, jaccard_join, language, lexical_search, line_dedup, nearest, packing, pii, quality, tokens, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_html_text": html_text.op2_html_text,
        "op3_packing": packing.op3_packing,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_token_counts": tokens.op5_token_counts,
        "op6_language": language.op6_language,
        "op7_quality": quality.op7_quality,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_pii": pii.op9_pii,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_nearest": nearest.op13_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.SQL, "op12_lexical_search": lexical_search.SQL}
