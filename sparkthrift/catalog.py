"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkthrift.plans import cache_queries, lifecycle_queries, memory_queries, request_queries, text_queries

_ALL = text_queries.QUERIES | request_queries.QUERIES | memory_queries.QUERIES | cache_queries.QUERIES | lifecycle_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.tier_savings_by_lang(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
