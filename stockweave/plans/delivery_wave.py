"""A wave of delivery status requests: new statuses, missing lots and supplier invoices."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.operators.movements import create_supplier_invoices, delivery_to_stock, delivery_totals
from stockweave.operators.transitions import apply_delivery_status, delivery_transitions


@dataclass
class DeliveryWave:
    judged: DataFrame
    deliveries: DataFrame
    new_lots: DataFrame
    new_invoices: DataFrame


def run_delivery_wave(t, requests: DataFrame, as_of: date) -> DeliveryWave:
    """Applies requests (delivery_id, new_status, user_id): receiving stocks the lines, accepting also invoices them."""
    items = t["delivery_items"]
    judged = delivery_transitions(t["raw_material_deliveries"], requests, items)
    moved = judged.filter(F.col("reject_reason").isNull())
    deliveries = apply_delivery_status(t["raw_material_deliveries"], judged)
    stocked = deliveries.join(moved.filter(F.col("new_status").isin("received", "accepted")), "delivery_id", "left_semi")
    lots, _ = delivery_to_stock(stocked, items, t["raw_material_stock"])
    accepted = deliveries.join(moved.filter(F.col("new_status") == "accepted"), "delivery_id", "left_semi")
    invoices, _ = create_supplier_invoices(accepted, items, t["supplier_invoices"], as_of)
    totals = delivery_totals(accepted, items).select("delivery_id", F.col("total_amount").alias("new_total"))
    deliveries = (
        deliveries.join(totals, "delivery_id", "left")
        .withColumn("total_amount", F.coalesce("new_total", "total_amount"))
        .drop("new_total")
    )
    return DeliveryWave(judged, deliveries, lots, invoices)
