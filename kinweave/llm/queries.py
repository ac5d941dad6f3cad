"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat_format, decontaminate, html_text, lang_id, line_dedup, near_vectors, ngram_join, packing, quality, url_filter
from .shared import importable

_MODULES = {
    "op1_lang_id": lang_id,
    "op2_packing": packing,
    "op3_ngram_join": ngram_join,
    "op4_chat_format": chat_format,
    "op5_html_text": html_text,
    "op6_quality": quality,
    "op7_near_vectors": near_vectors,
    "op8_decontaminate": decontaminate,
    "op9_line_dedup": line_dedup,
    "op10_url_filter": url_filter,
    "pipeline": corpus_pipeline,
}


def _run(module) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return module.query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(m) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
