"""Status changes: which are allowed, what guards them, what they set."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.literals import literal_rows
from stockweave.operators.gates import payment_status, shipment_coverage
from stockweave.schemas import EDGES, ORDER_ROLE_EDGES, PAYABLE_INVOICE_STATUSES


def is_edge(kind: str, current: Column, new: Column) -> Column:
    """Whether ``current`` may become ``new``."""
    return F.concat_ws(">", current, new).isin([f"{a}>{b}" for a, b in EDGES[kind]])


def is_order_edge_for_role(role: Column, current: Column, new: Column) -> Column:
    """Admins may use every order edge, technologists one, other roles none."""
    step = F.concat_ws(">", current, new)
    allowed = (role == "admin") & is_edge("order", current, new)
    for code, a, b in ORDER_ROLE_EDGES:
        allowed = allowed | ((role == code) & (step == f"{a}>{b}"))
    return F.coalesce(allowed, F.lit(False))


def _paired(current: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    state = current.select(key, F.col("status_code").alias("current_status"))
    return requests.join(state, key, "left")


def _basic_reason(allowed: Column) -> Column:
    return F.when(F.col("current_status").isNull(), "document_missing").when(
        F.col("new_status").isNull() | ~allowed, "transition_not_allowed"
    )


def validate_transitions(current: DataFrame, requests: DataFrame, key: str, kind: str) -> DataFrame:
    """Requests (key, new_status) with the present status and a reject reason or NULL."""
    allowed = is_edge(kind, F.col("current_status"), F.col("new_status"))
    return _paired(current, requests, key).withColumn("reject_reason", _basic_reason(allowed))


def order_transitions(
    orders: DataFrame,
    requests: DataFrame,
    invoices: DataFrame,
    order_items: DataFrame,
    shipment_items: DataFrame,
    shipments: DataFrame,
) -> DataFrame:
    """Order requests (order_id, new_status, role_code) judged by edge, role and guards.

    Shipping needs a paid invoice and shipments that cover every line; completing
    needs a delivered shipment.
    """
    allowed = is_order_edge_for_role(F.col("role_code"), F.col("current_status"), F.col("new_status"))
    covered = shipment_coverage(order_items, shipment_items, shipments).select("order_id", "is_covered")
    delivered = (
        shipments.filter(F.col("status_code") == "delivered")
        .select("order_id")
        .distinct()
        .withColumn("is_delivered", F.lit(True))
    )
    ships = F.col("new_status") == "shipped"
    reason = (
        _basic_reason(allowed)
        .when(ships & (F.col("payment_state") == "no_invoice"), "no_invoice")
        .when(ships & (F.col("payment_state") == "unpaid"), "invoice_not_paid")
        .when(ships & ~F.coalesce(F.col("is_covered"), F.lit(False)), "not_covered_by_shipments")
        .when((F.col("new_status") == "completed") & F.col("is_delivered").isNull(), "no_delivered_shipment")
    )
    return (
        _paired(orders, requests, "order_id")
        .join(payment_status(orders, invoices).select("order_id", "payment_state"), "order_id", "left")
        .join(covered, "order_id", "left")
        .join(delivered, "order_id", "left")
        .select("order_id", "role_code", "current_status", "new_status", reason.alias("reject_reason"))
    )


def shipment_transitions(
    shipments: DataFrame, requests: DataFrame, orders: DataFrame, invoices: DataFrame, shipment_items: DataFrame
) -> DataFrame:
    """Shipment requests judged by edge; shipping needs payment, shipping and delivering need lines."""
    allowed = is_edge("shipment", F.col("current_status"), F.col("new_status"))
    filled = shipment_items.select("shipment_id").distinct().withColumn("has_items", F.lit(True))
    paid = payment_status(orders, invoices).select("order_id", "payment_state")
    ships = F.col("new_status") == "shipped"
    moves = F.col("new_status").isin("shipped", "delivered")
    reason = (
        _basic_reason(allowed)
        .when(ships & (F.col("payment_state") == "no_invoice"), "no_invoice")
        .when(ships & (F.col("payment_state") == "unpaid"), "invoice_not_paid")
        .when(moves & F.col("has_items").isNull(), "no_items")
    )
    return (
        _paired(shipments, requests, "shipment_id")
        .join(shipments.select("shipment_id", "order_id"), "shipment_id", "left")
        .join(paid, "order_id", "left")
        .join(filled, "shipment_id", "left")
        .select("shipment_id", "current_status", "new_status", reason.alias("reject_reason"))
    )


def delivery_transitions(deliveries: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """Delivery requests judged by edge; receiving and accepting need lines, accepting an amount above 0."""
    allowed = is_edge("delivery", F.col("current_status"), F.col("new_status"))
    totals = items.groupBy("delivery_id").agg(
        F.count("*").alias("item_count"), F.sum(F.col("quantity") * F.col("unit_price")).alias("amount")
    )
    stocked = F.col("new_status").isin("received", "accepted")
    reason = (
        _basic_reason(allowed)
        .when(stocked & F.col("item_count").isNull(), "no_items")
        .when((F.col("new_status") == "accepted") & (F.col("amount") <= 0), "no_items")
    )
    return (
        _paired(deliveries, requests, "delivery_id")
        .join(totals, "delivery_id", "left")
        .select(*requests.columns, "current_status", reason.alias("reject_reason"))
    )


def invoice_payments(invoices: DataFrame, payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments (invoice_id, customer_id) judged: own invoice, still payable."""
    owner = orders.select("order_id", F.col("customer_id").alias("owner_id"))
    state = invoices.join(owner, "order_id").select(
        "invoice_id", "owner_id", F.col("status_code").alias("current_status")
    )
    reason = (
        F.when(F.col("current_status").isNull(), "invoice_missing")
        .when(~F.col("owner_id").eqNullSafe(F.col("customer_id")), "invoice_of_other_customer")
        .when(F.col("current_status") == "paid", "already_paid")
        .when(~F.col("current_status").isin(*PAYABLE_INVOICE_STATUSES), "not_payable")
    )
    return payments.join(state, "invoice_id", "left").select(
        "invoice_id", "customer_id", "current_status", reason.alias("reject_reason")
    )


def tech_card_transitions(cards: DataFrame, requests: DataFrame) -> DataFrame:
    """Card requests judged by edge; an active card needs an approver and is the only one of its product.

    Of several activations for one product in the same batch, the lowest card id wins.
    """
    allowed = is_edge("tech_card", F.col("current_status"), F.col("new_status"))
    details = cards.select("tech_card_id", "product_id", "approved_by_user_id")
    judged = (
        _paired(cards, requests, "tech_card_id")
        .join(details, "tech_card_id", "left")
        .withColumn(
            "reject_reason",
            _basic_reason(allowed).when(
                (F.col("new_status") == "active") & F.col("approved_by_user_id").isNull(), "approver_missing"
            ),
        )
    )
    activations = judged.filter(F.col("reject_reason").isNull() & (F.col("new_status") == "active"))
    holders = (
        cards.filter(F.col("status_code") == "active")
        .select("product_id", F.lit(0).alias("turn"), F.col("tech_card_id").alias("holder_id"))
        .unionByName(activations.select("product_id", F.lit(1).alias("turn"), F.col("tech_card_id").alias("holder_id")))
        .groupBy("product_id")
        .agg(F.min(F.struct("turn", "holder_id")).alias("first"))
        .select("product_id", F.col("first.holder_id").alias("holder_id"))
    )
    taken = (
        (F.col("new_status") == "active")
        & F.col("reject_reason").isNull()
        & (F.col("holder_id") != F.col("tech_card_id"))
    )
    return judged.join(holders, "product_id", "left").select(
        "tech_card_id",
        "current_status",
        "new_status",
        F.when(taken, "product_has_active_card").otherwise(F.col("reject_reason")).alias("reject_reason"),
    )


def next_statuses(documents: DataFrame, key: str, kind: str, dictionary: DataFrame) -> DataFrame:
    """Every allowed target of every document, with its name; unknown targets are left out.

    The edge list is a handful of literals, so the documents are not shuffled.
    """
    edges = literal_rows(documents.sparkSession, EDGES[kind], ["status_code", "new_status"])
    named = edges.join(
        dictionary.select(F.col("status_code").alias("new_status"), F.col("name").alias("new_name")), "new_status"
    )
    return documents.select(key, "status_code").join(named, "status_code").select(
        key, "status_code", "new_status", "new_name"
    )


# -- effects of accepted changes ----------------------------------------------------


def _accepted(judged: DataFrame, key: str, *extra: str) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNull()).select(key, "new_status", *extra)


def apply_status(documents: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Documents with the accepted new statuses set."""
    return (
        documents.join(_accepted(judged, key), key, "left")
        .withColumn("status_code", F.coalesce("new_status", "status_code"))
        .select(*documents.columns)
    )


def apply_invoice_status(invoices: DataFrame, judged: DataFrame, key: str, now: datetime) -> DataFrame:
    """As ``apply_status``; paying stamps paid_at, any other change clears it."""
    changed = F.col("new_status").isNotNull()
    paid_at = F.when(F.col("new_status") == "paid", F.lit(now)).when(changed, F.lit(None)).otherwise(F.col("paid_at"))
    return (
        invoices.join(_accepted(judged, key), key, "left")
        .withColumn("paid_at", paid_at.cast(invoices.schema["paid_at"].dataType))
        .withColumn("status_code", F.coalesce("new_status", "status_code"))
        .select(*invoices.columns)
    )


def apply_shipment_status(shipments: DataFrame, judged: DataFrame, now: datetime) -> DataFrame:
    """As ``apply_status``; shipping stamps shipped_at unless it is set."""
    shipped_at = F.when(F.col("new_status") == "shipped", F.coalesce(F.col("shipped_at"), F.lit(now))).otherwise(
        F.col("shipped_at")
    )
    return (
        shipments.join(_accepted(judged, "shipment_id"), "shipment_id", "left")
        .withColumn("shipped_at", shipped_at.cast(shipments.schema["shipped_at"].dataType))
        .withColumn("status_code", F.coalesce("new_status", "status_code"))
        .select(*shipments.columns)
    )


def apply_delivery_status(deliveries: DataFrame, judged: DataFrame) -> DataFrame:
    """As ``apply_status``; receiving or accepting records the acting user (user_id of the request)."""
    actor = F.when(F.col("new_status").isin("received", "accepted"), F.col("user_id")).otherwise(
        F.col("received_by_user_id")
    )
    return (
        deliveries.join(_accepted(judged, "delivery_id", "user_id"), "delivery_id", "left")
        .withColumn("received_by_user_id", actor)
        .withColumn("status_code", F.coalesce("new_status", "status_code"))
        .select(*deliveries.columns)
    )
