"""Every registered query against its check SQL in DuckDB, on the smallest supplied data."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from stockweave import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

_spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
spark_entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(spark_entry)

QUERIES = {name: build for name, build in spark_entry.queries().items() if name in registry.all_queries()}
CHECKS = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    if name not in CHECKS:
        assert rows
        return
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([_plain(row[i]) for i in at]) for row in result.fetchall())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["product_name", "total_quantity", "total_amount"] and df.count() > 0
