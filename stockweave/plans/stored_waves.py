"""Waves on a set of stored tables: each judges its requests and commits all that follows from them at once.

Requests are judged against the version that is the latest when a wave begins. A wave that meets another commit raises
``Conflict`` and changes nothing.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.operators.movements import apply_consumption, judge_ship_lines, ship_lines
from stockweave.operators.transitions import apply_status
from stockweave.plans.delivery_wave import run_delivery_wave
from stockweave.plans.production_wave import run_production_wave
from stockweave.session import counted_broadcasts, cut_lineage
from stockweave.sources.stored_set import Transaction


def commit_production_wave(
    spark: SparkSession, folder: str, requests: DataFrame, now: datetime, user_id: int | None = None, **options
) -> tuple[int, DataFrame]:
    """``run_production_wave`` with new statuses, used materials, finished lots and audit rows in one commit.

    Returns the version and the judged requests. A repeated run finds the batches in their new status.
    """
    with counted_broadcasts(spark):
        change = Transaction(spark, folder, **options)
        wave = run_production_wave(change.tables, cut_lineage(requests), now)
        judged, takes = cut_lineage(wave.judged), wave.takes
        moved = judged.filter(F.col("reject_reason").isNull())
        key = "production_batch_id"
        change.rewrite("production_batches", moved, [key], lambda rows: apply_status(rows, judged, key))
        change.rewrite(
            "raw_material_stock", takes, ["stock_id"], lambda rows: apply_consumption(rows, takes, "stock_id", now)[0]
        )
        change.insert("finished_goods_stock", wave.new_lots.withColumn("updated_at", F.lit(now)), key)
        change.audit(now, user_id)
        return change.commit(), judged


def commit_delivery_wave(
    spark: SparkSession, folder: str, requests: DataFrame, as_of: date, now: datetime, user_id: int | None = None, **options
) -> tuple[int, DataFrame]:
    """``run_delivery_wave`` with new statuses and totals, material lots, supplier invoices and audit rows in one commit.

    Returns the version and the judged requests. A repeated run finds the deliveries in their new status.
    """
    change = Transaction(spark, folder, **options)
    wave = run_delivery_wave(change.tables, cut_lineage(requests), as_of)
    judged = cut_lineage(wave.judged)
    moved = judged.filter(F.col("reject_reason").isNull()).select("delivery_id")
    after = cut_lineage(wave.deliveries.join(moved, "delivery_id", "left_semi"))

    def replace(rows: DataFrame) -> DataFrame:
        return rows.join(moved, "delivery_id", "left_anti").unionByName(after.join(rows, "delivery_id", "left_semi"))

    change.rewrite("raw_material_deliveries", moved, ["delivery_id"], replace)
    change.insert("raw_material_stock", wave.new_lots.withColumn("updated_at", F.lit(now)), "delivery_item_id")
    change.append("supplier_invoices", wave.new_invoices)
    change.audit(now, user_id)
    return change.commit(), judged


def commit_ship_lines(
    spark: SparkSession, folder: str, requests: DataFrame, as_of: date, now: datetime, user_id: int | None = None, **options
) -> tuple[int, DataFrame]:
    """``ship_lines`` with the lines of shipments and what they take from finished lots in one commit.

    Returns the version and (request_id, reject_reason) of the refused requests. Requests carry no document of their own, so
    a wave that is run again ships again, as far as orders have something left; run one again only after a ``Conflict``.
    """
    change = Transaction(spark, folder, **options)
    t = change.tables
    judged = judge_ship_lines(
        cut_lineage(requests),
        t["shipments"],
        t["invoices"],
        t["customer_orders"],
        t["order_items"],
        t["finished_goods_stock"],
        t["quality_checks"],
        t["shipment_items"],
        as_of,
    )
    lines, rejects = ship_lines(judged)
    lines, rejects = cut_lineage(lines), cut_lineage(rejects)
    takes = lines.select("finished_stock_id", F.col("quantity").alias("take_qty"))
    key = "finished_stock_id"
    change.rewrite("finished_goods_stock", takes, [key], lambda rows: apply_consumption(rows, takes, key, now)[0])
    change.insert("shipment_items", lines, "request_id")
    change.audit(now, user_id)
    return change.commit(), rejects
