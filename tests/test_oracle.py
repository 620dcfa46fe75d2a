"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import difference, views

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return views(SMALL)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        assert difference(got, db.execute(SQL[name]).df()) is None
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
