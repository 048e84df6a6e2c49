import pytest
from oracle import connect, same

from gramforge.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, sf, name):
    same(spark, con, QUERIES[name], ORACLE[name], sf)


@pytest.mark.parametrize("name", ["p5_found", "p5_shares", "p7_mix", "p7_shares"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
