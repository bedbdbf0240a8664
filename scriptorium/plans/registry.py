"""Queries of the library's own operators and the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans import checks, extraction, reports

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {**extraction.QUERIES, **checks.QUERIES, **reports.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
