"""Every query with SQL against DuckDB on the smallest tables."""

import oracle
import pytest

from graphloom.plans import catalog

SLOW = {"pagerank", "personalized_pagerank", "hits"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_matches_sql(spark, sf, con, name):
    assert oracle.differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], sf) is None


def test_flagship(spark, sf, con):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert oracle.differences(spark, con, catalog.queries()["pagerank"], catalog.oracle_sql()["pagerank"], sf) is None
