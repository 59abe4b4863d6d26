"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.plans import (
    contracts,
    files,
    published,
    roles,
    scoring,
    sessions,
    streams,
    traffic,
    vectors,
)

_MODULES = (traffic, vectors, roles, scoring, sessions, streams, published, contracts, files)


def queries() -> dict:
    """Name to query function."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL twin."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query the smoke check runs."""
    return queries()["category_statistics"](spark, folder)
