"""Every query with SQL against DuckDB."""

import pytest
from compare import SF, duck_rows, spark_rows

from stocktake.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, SF)) == duck_rows(SQL[name])
