"""Every named query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from moodspark.plans.oracles import ORACLES
from moodspark.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, duck, small, name):
    df = entry_point.queries()[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    actual = [tuple(row[c] for c in columns) for row in df.collect()]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)
