"""Queries of the operators over the tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import history_queries, inventory_queries, lifetime_queries, mechanism_queries, report_queries, source_queries, text_queries, tree_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (text_queries, history_queries, source_queries, inventory_queries, lifetime_queries, mechanism_queries, report_queries, tree_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest risks of the inventory of source files."""
    return source_queries.inventory_risks(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
