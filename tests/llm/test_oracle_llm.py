"""Operators with SQL against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from siftwell.llm import queries


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    wanted = c.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=key) == sorted(wanted, key=key)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
