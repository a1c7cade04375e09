"""Bulk forms of keyed writes: each returns the new state of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.joins import in_parts


def _match(columns: list[str], blank_as_null: list[str]) -> list:
    """Equality per key column; in ``blank_as_null`` columns NULL and '' are the same."""
    same = []
    for c in columns:
        left, right = F.col(c), F.col(f"new_{c}")
        if c in blank_as_null:
            same.append(F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit("")))
        else:
            same.append(left == right)
    return same


def upsert_by_key(
    existing: DataFrame,
    changes: DataFrame,
    keys: list[str],
    order: str,
    blank_as_null: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``existing`` with ``changes`` written over or added, plus ``write_kind``.

    The row with the highest ``order`` wins where a key repeats in ``changes``.
    Columns that ``changes`` lacks keep their value on update and are NULL on
    insert. write_kind is kept, updated or inserted.
    """
    values = [c for c in changes.columns if c not in keys and c != order]
    folded = [F.coalesce(F.col(k), F.lit("")).alias(k) if k in blank_as_null else F.col(k) for k in keys]
    latest = (
        changes.groupBy(*folded)
        .agg(F.max_by(F.struct(*(values or [order])), order).alias("row"))
        .select(*[F.col(k).alias(f"new_{k}") for k in keys], F.col("row"), F.lit(True).alias("is_new"))
    )
    joined = existing.withColumn("is_old", F.lit(True)).join(latest, _match(keys, list(blank_as_null)), "full")
    columns = []
    for c in existing.columns:
        if c in keys:
            fresh = F.nullif(F.col(f"new_{c}"), F.lit("")) if c in blank_as_null else F.col(f"new_{c}")
            columns.append(F.when(F.col("is_old"), F.col(c)).otherwise(fresh).alias(c))
        elif c in values:
            columns.append(F.when(F.col("is_new"), F.col(f"row.{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    kind = (
        F.when(F.col("is_old").isNull(), "inserted").when(F.col("is_new"), "updated").otherwise("kept").alias("write_kind")
    )
    return joined.select(*columns, kind)


def update_by_key(
    existing: DataFrame, changes: DataFrame, key: str, unique_by: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows with the columns of ``changes`` replaced, and the changes refused (``update_rejects``)."""
    rejects = update_rejects(existing, changes, key, unique_by)
    return apply_update(existing, changes.join(rejects.select(key), key, "left_anti"), key), rejects


def update_rejects(
    existing: DataFrame, changes: DataFrame, key: str, unique_by: list[str], parts: int | None = None
) -> DataFrame:
    """(key, reject_reason) of the changes whose key is unknown, or whose values in ``unique_by`` another row already has.

    ``changes`` has one row per key. Keys are looked up in ``parts`` tasks if given (``joins.parts_of``).
    """
    others = existing.select(F.col(key).alias("other_key"), *[F.col(c).alias(f"o_{c}") for c in unique_by])
    clash = changes.join(
        others,
        [F.col(c) == F.col(f"o_{c}") for c in unique_by] + [F.col(key) != F.col("other_key")],
        "left_semi",
    ).select(key)
    known = in_parts(existing.select(key).filter(F.col(key).isNotNull()), parts, key)
    taken = in_parts(clash, parts, key).join(known, key, "left_semi")
    unknown = in_parts(changes.select(key), parts, key).join(known, key, "left_anti")
    return taken.withColumn("reject_reason", F.lit("taken_by_other_row")).unionByName(
        unknown.withColumn("reject_reason", F.lit("row_missing"))
    )


def apply_update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` replaced; ``changes`` has one row per key."""
    values = [c for c in changes.columns if c != key]
    good = changes.select(key, F.struct(*values).alias("row"), F.lit(True).alias("is_changed"))
    columns = [
        F.when(F.col("is_changed"), F.col(f"row.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in existing.columns
    ]
    return existing.join(good, key, "left").select(*columns)


def deactivate(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with is_active false where the key is in ``ids``."""
    flagged = ids.select(key).distinct().withColumn("is_off", F.lit(True))
    return (
        existing.join(flagged, key, "left")
        .withColumn("is_active", F.when(F.col("is_off"), F.lit(False)).otherwise(F.col("is_active")))
        .select(*existing.columns)
    )
