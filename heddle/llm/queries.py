"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, decontaminate, language_id, license_scan, line_dedup, quality_crf, simhash, substring_dedup, suffix_dedup, token_rollup, topk_search, vector_codes

_MODULES = (suffix_dedup, token_rollup, line_dedup, license_scan, substring_dedup, topk_search, simhash, quality_crf, decontaminate, bpe, conversation_repair, vector_codes, language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
