"""Operators with SQL against DuckDB."""

import pytest
from compare import SF, duck_rows, spark_rows

from stocktake.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = spark_rows(queries.queries()[name](spark, SF))
    assert found[1]
    assert found == duck_rows(SQL[name])
