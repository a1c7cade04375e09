"""Appends with defaults, insert-ignore and ordered loading."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.schemas import DEFAULTS, LOAD_ORDER, layout
from stockweave.session import STORED_COMPRESSION


def with_defaults(rows: DataFrame, table: str, as_of: date, now: datetime) -> DataFrame:
    """``rows`` in the layout of ``table``: absent columns are NULL, NULLs take the column default."""
    defaults = DEFAULTS.get(table, {})
    present = set(rows.columns)
    columns = []
    for field in layout(table):
        value = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in defaults:
            default = {"now": now, "as_of": as_of}.get(defaults[field.name], defaults[field.name])
            value = F.coalesce(value, F.lit(default))
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet, one row per key.

    A key that repeats inside ``new`` keeps its smallest row, so the choice does
    not depend on how the rows are spread over tasks.
    """
    others = [c for c in new.columns if c not in keys]
    if others:
        first = F.min(F.struct(*others)).alias("_row")
        unique = new.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*new.columns)
    else:
        unique = new.distinct()
    return unique.join(existing.select(*keys), keys, "left_anti")


def append(rows: DataFrame, folder: str, table: str) -> None:
    """Add rows to a stored table."""
    rows.write.mode("append").option("compression", STORED_COMPRESSION).parquet(f"{folder}/{table}")


def append_batch(rows: DataFrame, folder: str, table: str, batch_id: str, day: str | None = None) -> None:
    """Add the rows of a batch to a stored table, in folders by batch and, with ``day``, by its month.

    A batch has its own folder, which a repeated run writes anew, so a batch never stands in the table twice.
    Readers get ``batch_id`` and ``month`` as columns; a filter on them skips whole folders.
    """
    place = f"{folder}/{table}/batch_id={batch_id}"
    if day is None:
        rows.write.mode("overwrite").parquet(place)
    else:
        month = F.date_format(day, "yyyy-MM")
        rows.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(place)


def load_in_order(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Append every table, parents before the children that refer to them."""
    names = [name for name in LOAD_ORDER if name in tables]
    for name in names:
        append(tables[name], folder, name)
    return names
