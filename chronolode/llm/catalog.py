"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolode.llm import bpe, centroids, chat_format, exact_dedup, language, mixing_lm, mixture, near_dedup, ngram_join, prefix_trie, quality, substring_dedup, token_counts

_MODULES = {
    "op1_mixing_lm": mixing_lm,
    "op2_language": language,
    "op3_near_dedup": near_dedup,
    "op4_bpe": bpe,
    "op5_quality_rules": quality,
    "op6_mixture": mixture,
    "op7_token_counts": token_counts,
    "op8_exact_dedup": exact_dedup,
    "op9_substring_dedup": substring_dedup,
    "op10_chat_format": chat_format,
    "op11_ngram_join": ngram_join,
    "op12_centroids": centroids,
    "op13_prefix_trie": prefix_trie,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
