"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.plans import contract_queries, core_queries, linkage_queries, matching_queries, more_queries, p_queries, report_queries

MODULES = [core_queries, more_queries, contract_queries, linkage_queries, matching_queries, report_queries, p_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
