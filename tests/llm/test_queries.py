"""The registered queries of the training-data operators against their DuckDB checks, and their registration."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from stockweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(queries.CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([row[i] for i in at]) for row in result.fetchall())


def test_registration():
    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert set(queries.CHECKS) <= set(__spark_entry__.oracle_sql())
