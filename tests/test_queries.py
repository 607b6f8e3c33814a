"""Every corpus query against its SQL, or at least run, at the smallest scale."""

import pytest

from conftest import DATA, rows
from folioflow.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        wanted = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
