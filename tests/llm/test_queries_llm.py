import pytest
from oracle import agree, connect

from wellforge.llm import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    agree(spark, connect(sf), sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
