"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfacts.plans import core, problem_sql, problems


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return core.SQL | problem_sql.SQL
