"""How a module of queries lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Registry = dict[str, tuple[Query, str | None]]


def registered(into: Registry, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: list the query under its name, with its SQL."""

    def add(query: Query) -> Query:
        into[query.__name__] = (query, sql)
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
