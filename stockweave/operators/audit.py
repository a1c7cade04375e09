"""Audit rows from table snapshots and sign-in events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.inet import parse_inet
from stockweave.functions.ordering import asc
from stockweave.functions.scalars import row_json


def audit_diff(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    table: str,
    changed_at: datetime,
    user_id: int | None = None,
    ip_address: str | None = None,
) -> DataFrame:
    """One audit row per inserted, updated or deleted row, with JSON images.

    Only rows that differ give an UPDATE; a statement that rewrites a row with
    the same values leaves no trace in a pair of snapshots.
    """
    columns = old.columns
    before = old.select(
        *[F.col(k).alias(f"o_{k}") for k in keys], F.struct(*columns).alias("before"), row_json(*columns).alias("old_data")
    )
    after = new.select(
        *[F.col(k).alias(f"n_{k}") for k in keys], F.struct(*columns).alias("after"), row_json(*columns).alias("new_data")
    )
    action = (
        F.when(F.col("before").isNull(), "INSERT")
        .when(F.col("after").isNull(), "DELETE")
        .when(~F.col("before").eqNullSafe(F.col("after")), "UPDATE")
    )
    parts = [
        F.concat(
            F.lit(f"{k}="), F.coalesce(F.coalesce(F.col(f"n_{k}"), F.col(f"o_{k}")).cast("string"), F.lit("null"))
        )
        for k in keys
    ]
    match = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    return (
        before.join(after, match, "full")
        .select(
            F.lit(user_id).cast("bigint").alias("user_id"),
            action.alias("action_type"),
            F.lit(table).alias("table_name"),
            F.concat_ws(", ", *parts).alias("record_id"),
            F.lit(changed_at).alias("changed_at"),
            "old_data",
            "new_data",
            F.lit(ip_address).cast("string").alias("ip_address"),
            F.lit(True).alias("success"),
        )
        .filter(F.col("action_type").isNotNull())
    )


def auth_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows of sign-in events (user_id, action_type, changed_at, ip_address, success), and the rejects.

    Only LOGIN and LOGOUT are sign-in events. An unknown user has no record id. An address may be missing, but must
    be one.
    """
    known = F.coalesce(F.col("action_type").isin("LOGIN", "LOGOUT"), F.lit(False))
    addressed = parse_inet(F.col("ip_address"))["reason"].isNull()
    rows = events.filter(known & addressed).select(
        "user_id",
        "action_type",
        F.lit("users").alias("table_name"),
        F.concat(F.lit("user_id="), F.col("user_id").cast("string")).alias("record_id"),
        "changed_at",
        F.lit(None).cast("string").alias("old_data"),
        F.lit(None).cast("string").alias("new_data"),
        "ip_address",
        "success",
    )
    reason = F.when(~known, "unsupported_action").otherwise("invalid_address")
    rejects = events.filter(~known | ~addressed).select(
        "user_id", "action_type", "changed_at", reason.alias("reject_reason")
    )
    return rows, rejects


def audited_table_names(audit_log: DataFrame) -> DataFrame:
    """The tables the log mentions."""
    return audit_log.select("table_name").distinct().orderBy(asc("table_name"))


def audit_user_names(users: DataFrame) -> DataFrame:
    """Users to filter the log by."""
    return users.select("user_id", "username").orderBy(asc("username"), asc("user_id"))
