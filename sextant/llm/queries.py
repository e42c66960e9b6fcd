"""The ``opN_`` queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import base, decontaminate, filter_audit, language_id, near_dedup, pii, quality, rolling, sentencepiece_codec, substring_dedup, suffix_dedup, token_files, topk, warc

_MODULES = {
    "op1_language_id": language_id,
    "op2_quality": quality,
    "op3_warc_revisits": warc,
    "op4_decontaminate": decontaminate,
    "op5_near_dedup": near_dedup,
    "op6_sentencepiece": sentencepiece_codec,
    "op7_suffix_dedup": suffix_dedup,
    "op8_token_files": token_files,
    "op9_substring_dedup": substring_dedup,
    "op10_topk": topk,
    "op11_pii": pii,
    "op12_rolling_windows": rolling,
    "op13_filter_audit": filter_audit,
}


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base.prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(m.query) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
