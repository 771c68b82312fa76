import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query_equals_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert difference(got, duck.sql(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
