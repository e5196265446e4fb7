"""Every registered query against its SQL in DuckDB."""

import pytest

from burnledger.plans.oracle import ORACLES
from burnledger.plans.registry import QUERIES
from check_oracles import actual, connect, differences, expected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = actual(QUERIES[name](spark, SF))
    assert sum(got[2].values()) > 0
    assert differences(got, expected(duck, ORACLES[name])) == []
