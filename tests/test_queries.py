import pytest
from oracle import check, connect

from fenceline.plans import coordination, logs

FOLDER = "/root/testdata/sf0.001"
QUERIES = logs.QUERIES | coordination.QUERIES
SQL = logs.SQL | coordination.SQL


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    check(con, spark, FOLDER, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_no_clock_in_queries():
    from pathlib import Path

    for f in Path(coordination.__file__).parent.parent.rglob("*.py"):
        assert "current_timestamp" not in f.read_text(), f


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
