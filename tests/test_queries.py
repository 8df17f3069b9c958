"""Every registered query runs at the smallest scale and equals its SQL twin."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not present")


@pytest.fixture(scope="module")
def db():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    from tools.check_oracles import rows_of

    frame = entry.queries()[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
