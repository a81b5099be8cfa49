import pytest
from oracle import agree, connect

from wellforge.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, sf, name):
    agree(spark, con, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_placed_cell_is_in_a_part(spark, sf):
    from wellforge.plans.tables import placed_cells

    assert QUERIES["split_by_every_tissue"](spark, sf).count() == placed_cells(spark, sf).count()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_medians_are_those_of_the_sql_to_the_last_digit(spark, folder):
    rows = {tuple(r) for r in QUERIES["aggregate_median"](spark, folder).collect()}
    assert rows == set(connect(folder).execute(ORACLES["aggregate_median"]).fetchall())
