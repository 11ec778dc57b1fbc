"""Every query of the training-data problems runs on the smallest tables, and equals its SQL where there is one."""

import pytest
from oracle import assert_same, connect

from codexloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert_same(df, con, ORACLE[name])
    else:
        assert df.columns and df.count() > 0
