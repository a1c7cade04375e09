"""Small tables of fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Rows written in the code, as a broadcast table.

    The rows are part of the plan, so their number is fixed by the code and never
    grows with the data.
    """
    structs = [F.struct(*[F.lit(v).alias(c) for v, c in zip(row, columns)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))
