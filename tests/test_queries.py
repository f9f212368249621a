"""Every core query against its SQL twin on the smallest tables; those without one must run."""

import pytest

from brightloom.plans import registry

from .compare import SF, connection, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ("best_k", "regression_trees", "als"):
        pytest.skip("slow; tested on small data in test_operators")
    found = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        wanted = con.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
