"""Registration of named queries over the driver tables, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from stockweave.sources.driver import check_sql, driver_tables
from stockweave.sources.tables import Tables

#: Dates inside the range of the supplied data; no query reads the clock.
AS_OF = date(1998, 1, 15)
NOW = datetime(1998, 1, 15, 12, 0)
START = date(1998, 1, 1)
END = date(1998, 3, 31)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines hand over the same kind of number."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema
        ]
    )


def query(name: str, sql: str | None = None, decimals: str = "") -> Callable:
    """Registers ``build(tables) -> DataFrame`` under ``name``.

    ``sql`` is the check; ``decimals`` names its columns that are decimal, which
    become doubles on both sides.
    """

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain_numbers(build(driver_tables(spark, folder)))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = check_sql(sql)
            if decimals:
                casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in decimals.split())
                text = f"SELECT * REPLACE ({casts}) FROM (\n{text}\n) AS checked"
            CHECKS[name] = text
        return build

    return register
