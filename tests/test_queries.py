"""Every query with SQL must give what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from tidebar import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalog.SQL:
        assert df.columns
        return
    result = duck.sql(catalog.SQL[name])
    assert sorted(result.columns) == sorted(df.columns)
    order = [result.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == want
