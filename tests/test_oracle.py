"""Every registered query against its SQL counterpart in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from weftline.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = sorted(name.split(".")[0] for name in os.listdir(SF_DIR))


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


def _comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_comparable(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, oracle):
    result = QUERIES[name](spark, SF_DIR)
    expected = oracle.execute(ORACLE_SQL[name])
    expected_columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(expected_columns)
    got = _rows(result.columns, result.collect())
    want = _rows(expected_columns, expected.fetchall())
    assert sum(got.values()) == sum(want.values())
    assert got == want
