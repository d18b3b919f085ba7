"""All registered queries of the reference's operators with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekloom.plans import analytics_queries, data_queries, more_queries, search_queries

_MODULES = (search_queries, data_queries, analytics_queries, more_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.search_end_to_end(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
