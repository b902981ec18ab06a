"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        assert got[1]
        return
    cursor = sql.execute(text)
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["mint", "rule", "reason"]
