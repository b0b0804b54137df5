"""Every registered query of the core against its SQL on the smallest tables, and a stable schema for those without."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry
from tidemark.session import TABLES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(one(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLE:
        want = tables.sql(registry.ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)
    else:
        assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.ORACLE) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
