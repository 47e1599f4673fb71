"""Registers the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plaza.llm import decontaminate, html_cut, language_id, license_scan, lsh_forest, mixing, quality_rules, repeats, spelling, token_align, token_files, toxicity, warc_zip

_MODULES = (quality_rules, decontaminate, lsh_forest, language_id, html_cut, toxicity, warc_zip, mixing, repeats, token_files, token_align, license_scan, spelling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
