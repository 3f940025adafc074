import pytest

from engram.oracle import ORACLES
from engram.queries import QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())
