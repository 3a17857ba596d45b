"""Every query with SQL gives DuckDB's rows; every other one runs."""

import math

import duckdb
import pytest

from ledgerlark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
