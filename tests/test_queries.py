import pytest
from oracle import connect, same

from gramforge.queries import modules

QUERIES = {k: v for m in modules() for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in modules() for k, v in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, sf, name):
    same(spark, con, QUERIES[name], ORACLE[name], sf)
