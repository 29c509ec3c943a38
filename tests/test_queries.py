"""Every registered query of the engine against its SQL counterpart."""

import pytest

from tests.oracle import spark_rows, sql_rows
from tidemark.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, SF))
    wanted_columns, wanted = sql_rows(SF, registry.ORACLE_SQL[name])
    assert columns == wanted_columns
    assert len(rows) == len(wanted) > 0
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
