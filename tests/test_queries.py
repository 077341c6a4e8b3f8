import pytest
from oracle import compare, connect

from medlattice.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    if name in SQL:
        same, said = compare(df, duck, SQL[name])
        assert same, said
    else:
        assert df.count() > 0
