"""Every query with an SQL twin gives the same rows, columns and types in another engine."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_file
from prioscope.plans.catalog import QUERIES
from prioscope.plans.oracle import SQL

TABLES = ("events", "documents", "labels", "embeddings")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
ROWS_ONLY = {
    "dossier_nested", "lsa_vectors", "cluster_severity", "regression_severity", "embedding_clusters",
    "classifier_scores", "classifier_quality", "batch_audit", "robustness_eval",
}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def test_every_query_is_checked():
    assert set(SQL) == set(QUERIES) - ROWS_ONLY
    assert entry_file.queries().keys() >= QUERIES.keys() and entry_file.oracle_sql().items() >= SQL.items()
    assert entry_file.oracle_sql().keys() <= entry_file.queries().keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(SQL[name])
    types = {column[0]: str(column[1]) for column in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    places = [list(types).index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == expected


def test_entry(spark):
    assert entry_file.entry(spark).count() == 6
