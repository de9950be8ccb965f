"""Registered queries on the smallest tables: SQL where there is some, columns and coverage for the others."""

import os

import pytest

from dupspark.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in queries.queries()[name](spark, DIR).select(columns).collect()) == want


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
