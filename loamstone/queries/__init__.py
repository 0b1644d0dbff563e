"""Registered queries by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamstone.queries import indexes, relational, retrieval, sources, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in (sources, retrieval, indexes, relational, streams) for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in (sources, retrieval, indexes, relational, streams) for k, s in part.SQL.items()}
