"""The queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.llm import queries as q

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = q.QUERIES[name](spark, FOLDER)
    rel = con.sql(q.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(repr, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())
