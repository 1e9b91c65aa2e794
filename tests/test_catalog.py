"""Every query of the library against its SQL."""

import compare
import pytest

from taskplane.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    compare.assert_same(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
