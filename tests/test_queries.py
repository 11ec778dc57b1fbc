"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest
from oracle import assert_same, connect

from codexloom.plans import catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf, con, name):
    df = Q[name](spark, sf)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(Q)
