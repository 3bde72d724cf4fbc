"""Every registered query with SQL gives the same rows as DuckDB does."""

import math

import duckdb
import pytest

from lodestrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows):
    fix = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(fix(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({registry.ORACLE_SQL[name]})")
    assert sorted(duck.sql(registry.ORACLE_SQL[name]).columns) == names
    got = values(tuple(r) for r in df.select(*names).collect())
    assert got == values(want.fetchall())
