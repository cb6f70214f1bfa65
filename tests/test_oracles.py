"""Every ledger query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerloom.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        return x

    return sorted(tuple(repr(value(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert columns == sorted(rel.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    assert got == plain(rel.select(*(f'"{c}"' for c in columns)).fetchall())


def test_chunks_name_every_domain_once(spark):
    rows = QUERIES["source_query_chunks"](spark, FOLDER).collect()
    named = [t for r in rows for t in r.terms.split(" OR ")]
    assert len(named) == len(set(named)) == spark.read.parquet(f"{FOLDER}/supplier.parquet").count()
    assert all(len(r.terms) <= 1500 for r in rows)
