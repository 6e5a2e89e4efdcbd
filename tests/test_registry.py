"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from conftest import SMALL
from workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def _sorted(rows):
    return sorted(tuple(str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    table = entry_point.queries()[name](spark, SMALL)
    columns = sorted(table.columns)
    rows = [tuple(row) for row in table.select(*columns).collect()]
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert _sorted(rows) == _sorted([tuple(row[i] for i in order) for row in cursor.fetchall()])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    table = entry_point.entry(spark)
    errors = [row.error for row in table.filter("run_id = 0").collect()]
    assert errors and min(errors) > 0.03 and errors == sorted(errors, reverse=True)
