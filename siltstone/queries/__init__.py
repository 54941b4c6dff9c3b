"""Registered queries over the parquet tables, and SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.queries import analytics, hybrid, jobs, more, ranking, records, scalars

MODULES = (analytics, scalars, ranking, hybrid, jobs, more, records)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.Q.items()}
SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.SQL.items()}
