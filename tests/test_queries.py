import pytest
from oracle import assert_same

from quire.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, SF)
    if name in q.ORACLE_SQL:
        assert_same(df, q.ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
