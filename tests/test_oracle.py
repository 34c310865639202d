"""Every registered query against its SQL statement, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
NO_SQL = {"source_inventory"}  # files have no SQL; test_catalog compares it with the file system
QUERIES, ORACLES = contract.report_queries(), contract.report_oracle_sql()

# Spark type -> DuckDB type of the same values
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(rows, order):
    picked = ([row[i] for i in order] for row in rows)
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    types = dict(zip(columns, (str(c[1]) for c in result.description)))
    assert sorted(df.columns) == sorted(columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = sorted(columns)
    expected = canonical(result.fetchall(), [columns.index(c) for c in order])
    got = canonical([tuple(r) for r in df.collect()], [df.columns.index(c) for c in order])
    assert len(got) == len(expected)
    assert got == expected
    assert not any(isinstance(v, float) and math.isnan(v) for row in got for v in row)
    assert got, "the comparison should not be about nothing"
