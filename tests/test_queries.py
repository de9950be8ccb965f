"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__
from dupspark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = df.collect()
    if name not in registry.oracle_sql():
        assert df.columns
        return
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    key = sorted(columns)
    assert sorted(df.columns) == key
    text = lambda v: repr(bytes(v) if isinstance(v, bytearray) else v)
    rows = lambda data, names: sorted(tuple(text(r[names.index(c)]) for c in key) for r in data)
    assert rows([tuple(r) for r in got], df.columns) == rows(found.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 21
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
