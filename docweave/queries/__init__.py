"""The named queries of the engine, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.queries import evaluation, flows, layout, p6, records, review, summaries, text

_MODULES = [evaluation, layout, text, records, review, summaries, flows, p6]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the core by name."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
