"""Operators that SQL can express, on the whole of the smallest tables."""

import pytest

from conftest import DATA, rows
from folioflow.llm.queries import QUERIES
from folioflow.llm.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, duck):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
