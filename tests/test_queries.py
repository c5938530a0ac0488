"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("LEXORDER_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS "
                    f"SELECT * FROM '{FOLDER}/{name}'")
    return con


def test_every_query_has_sql():
    assert {query.__name__ for query in driver.QUERIES} == set(driver.SQL)


@pytest.mark.parametrize("name", list(driver.SQL))
def test_query_matches_sql(spark, database, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    ours = driver.queries()[name](spark, FOLDER).toArrow()
    theirs = database.sql(driver.oracle_sql()[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert ours.num_rows == theirs.num_rows
    ours, theirs = ours.select(columns), theirs.select(columns)
    assert [f.type for f in ours.schema] == [f.type for f in theirs.schema]
    database.register("ours", ours)
    database.register("theirs", theirs)
    different = database.sql("SELECT count(*) FROM (FROM ours EXCEPT ALL FROM theirs)")
    assert different.fetchall() == [(0,)]
