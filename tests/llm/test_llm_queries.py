import pytest

from brightloom.llm.queries import QUERIES, SQL

from ..compare import SF, connection, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(found) == rows(connection().sql(SQL[name]).df())
    if name.endswith("_found"):
        assert not found.duplicated().any()
