"""Keyed writes to stored tables, and the audit rows between two of their versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from stockweave.functions.joins import parts_of
from stockweave.operators import writes
from stockweave.operators.audit import audit_diff
from stockweave.session import cut_lineage
from stockweave.sources import stored


def upsert_stored(
    folder: str, changes: DataFrame, keys: list[str], order: str, blank_as_null: tuple[str, ...] = (), **options: int
) -> int:
    """``writes.upsert_by_key`` on a stored table; returns the new version."""
    fixed = cut_lineage(changes)

    def change(rows: DataFrame) -> DataFrame:
        return writes.upsert_by_key(rows, fixed, keys, order, blank_as_null).drop("write_kind")

    return stored.rewrite(folder, fixed, keys, change, adds_rows=True, blank_as_null=blank_as_null, **options)


def update_stored(
    folder: str, changes: DataFrame, key: str, unique_by: list[str], **options: int
) -> tuple[int, DataFrame]:
    """``writes.update_by_key`` on a stored table; returns the version and the changes refused.

    Refusals look at the key and ``unique_by`` of the whole table, as any row can have the values; only files with accepted
    changes are read whole and replaced.
    """
    spark = changes.sparkSession
    fixed = cut_lineage(changes)
    rows = stored.read(spark, folder)
    rejects = cut_lineage(writes.update_rejects(rows, fixed, key, unique_by, parts_of(rows)))
    good = cut_lineage(fixed.join(rejects.select(key), key, "left_anti"))
    version = stored.rewrite(folder, good, [key], lambda rows: writes.apply_update(rows, good, key), **options)
    return version, rejects


def deactivate_stored(folder: str, ids: DataFrame, key: str, **options: int) -> int:
    """``writes.deactivate`` on a stored table; returns the version."""
    fixed = cut_lineage(ids.select(key).distinct())
    return stored.rewrite(folder, fixed, [key], lambda rows: writes.deactivate(rows, fixed, key), **options)


def audit_versions(
    spark: SparkSession,
    folder: str,
    old: int,
    new: int,
    keys: list[str],
    table: str,
    changed_at: datetime,
    user_id: int | None = None,
    ip_address: str | None = None,
) -> DataFrame:
    """``audit.audit_diff`` between two versions of a stored table.

    Only files that one version has alone are read, so the work grows with the change and not with the table.
    """
    before, after = stored.changed_rows(spark, folder, old, new)
    return audit_diff(before, after, keys, table, changed_at, user_id, ip_address)
