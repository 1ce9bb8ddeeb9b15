"""Registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_pii": "op1_pii",
    "op2_decontamination": "op2_decontamination",
    "op3_byte_bpe": "op3_byte_bpe",
    "op4_quality_rules": "op4_quality_rules",
    "op5_chat_perspectives": "op5_chat_perspectives",
    "op6_quality_crf": "op6_quality_crf",
    "op7_toxicity_crf": "op7_toxicity_crf",
    "op8_url_filters": "op8_url_filters",
    "op9_ngram_jaccard": "op9_ngram_jaccard",
    "op10_language_svm": "op10_language_svm",
    "op11_conversation_repair": "op11_conversation_repair",
    "op12_best_fit_packing": "op12_best_fit_packing",
    "op13_collocations": "op13_collocations",
}


def _module(name: str):
    return import_module(f"fundtrace.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in MODULES if getattr(_module(name), "SQL", None)}
