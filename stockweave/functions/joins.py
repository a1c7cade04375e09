"""Lookups that stay balanced when many rows have no key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task sorts for a lookup whose size is known.
PART_ROWS = 500_000

#: Tasks over which rows without a key are spread.
SPREAD = 4096


def left_lookup(rows: DataFrame, side: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on ``key`` in which rows with a NULL key do not meet in one task.

    They cannot match anyway, so a second join column sends them to many tasks by
    ``spread_by``; it is 0 on both sides for rows that have a key. ``side`` has
    one row per key.
    """
    rest = F.pmod(F.hash(spread_by), F.lit(SPREAD)) + 1
    left = rows.withColumn("_lane", F.when(F.col(key).isNull(), rest).otherwise(0))
    right = side.withColumnRenamed(key, "_key").withColumn("_side_lane", F.pmod(F.hash("_key"), F.lit(1)))
    match = [F.col(key) == F.col("_key"), F.col("_lane") == F.col("_side_lane")]
    return left.join(right, match, "left").drop("_lane", "_side_lane", "_key")


def parts_of(stored: DataFrame) -> int:
    """The number of tasks for lookups in a stored table, whose files know their number of rows.

    Spark puts small parts of a shuffle together by their compressed size, and ids compress so well that millions of
    them came into the memory of one task.
    """
    return max(1, -(-stored.count() // PART_ROWS))


def in_parts(rows: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """The rows dealt over ``parts`` tasks by the columns, or as they are without ``parts``."""
    return rows.repartition(parts, *columns) if parts else rows
