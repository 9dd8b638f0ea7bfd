"""Every query with SQL against DuckDB on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from siftwell.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=key)
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=key)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted, strict=True):
        assert f == w


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
