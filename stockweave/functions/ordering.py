"""Sort keys with the NULL placement of the source system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(column: str) -> Column:
    """Ascending, NULLs at the end."""
    return F.col(column).asc_nulls_last()


def desc(column: str) -> Column:
    """Descending, NULLs at the start."""
    return F.col(column).desc_nulls_first()


def desc_nulls_last(column: str) -> Column:
    """Descending, NULLs at the end."""
    return F.col(column).desc_nulls_last()
