"""Stock movements and the documents they create."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockweave.functions.joins import left_lookup
from stockweave.functions.scalars import clean_text, document_number, line_amount
from stockweave.functions.scan import numbered
from stockweave.operators.admission import admit
from stockweave.operators.gates import (
    approved_keys,
    available_quantity,
    payment_status,
    shipped_so_far,
    without_active_invoice,
)
from stockweave.operators.rules import key_text, short_key
from stockweave.schemas import INVOICEABLE_ORDER_STATUSES, MONEY, QUANTITY, STOCKED_DELIVERY_STATUSES
from stockweave.session import cut_lineage

#: States of a shipment that lines are added to.
_OPEN, _CLOSED, _NO_INVOICE, _UNPAID = range(4)

#: Why a shipping request is refused by its shipment, and by its lot.
_BY_SHIPMENT = ("shipment_missing", "shipment_closed", "quantity_not_positive", "no_invoice", "invoice_not_paid")
_BY_LOT = ("lot_expired", "lot_too_small", "lot_not_approved")


def apply_consumption(lots: DataFrame, takes: DataFrame, key: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Lots after taking ``take_qty``; lots that hold less than asked are returned untouched as rejects.

    ``takes`` may name a lot many times. Quantities are rounded to the lot's
    three places only at the end.
    """
    asked = takes.groupBy(key).agg(F.sum("take_qty").alias("take_qty"))
    joined = lots.join(asked, key, "left")
    enough = F.col("take_qty").isNotNull() & (F.col("quantity_current") >= F.col("take_qty"))
    updated = joined.select(
        *[c for c in lots.columns if c not in ("quantity_current", "updated_at")],
        F.when(enough, F.round(F.col("quantity_current") - F.col("take_qty"), 3))
        .otherwise(F.col("quantity_current"))
        .cast(QUANTITY)
        .alias("quantity_current"),
        F.when(enough, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*lots.columns)
    short = joined.filter(F.col("quantity_current") < F.col("take_qty")).select(key, "quantity_current", "take_qty")
    return updated, short


def finalize_batches(batches: DataFrame, stock: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New finished lots of completed batches, and the batches that already have one.

    A lot holds produced minus defective and expires after the product's shelf
    life; a batch without good output gets no lot.
    """
    done = stock.select("production_batch_id")
    fresh = batches.join(done, "production_batch_id", "left_anti")
    day = F.to_date("production_date")
    good = F.col("quantity_produced") - F.col("quantity_defective")
    lots = (
        fresh.filter(good > 0)
        .join(products.select("product_id", "shelf_life_days"), "product_id")
        .select(
            "product_id",
            "production_batch_id",
            "batch_number",
            good.cast(QUANTITY).alias("quantity_current"),
            day.alias("production_date"),
            F.date_add(day, F.col("shelf_life_days")).alias("expiry_date"),
        )
    )
    rejects = batches.join(done, "production_batch_id", "left_semi").select(
        "production_batch_id", F.lit("already_stocked").alias("reject_reason")
    )
    return lots, rejects


def delivery_to_stock(
    deliveries: DataFrame, items: DataFrame, stock: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The lots still missing for received or accepted deliveries, and the deliveries refused.

    Running it again after the lots are stored creates nothing.
    """
    reason = F.when(~F.col("status_code").isin(*STOCKED_DELIVERY_STATUSES), "status_not_stockable").when(
        F.col("item_count").isNull(), "no_items"
    )
    counts = items.groupBy("delivery_id").agg(F.count("*").alias("item_count"))
    judged = deliveries.join(counts, "delivery_id", "left").select(
        "delivery_id", "status_code", reason.alias("reject_reason")
    )
    open_ids = judged.filter(F.col("reject_reason").isNull()).select("delivery_id")
    stocked = stock.filter(F.col("delivery_item_id").isNotNull()).select("delivery_item_id")
    lots = (
        items.join(open_ids, "delivery_id", "left_semi")
        .join(stocked, "delivery_item_id", "left_anti")
        .select(
            "material_id", "delivery_item_id", "batch_number", F.col("quantity").alias("quantity_current"), "expiry_date"
        )
    )
    return lots, judged.filter(F.col("reject_reason").isNotNull()).select("delivery_id", "reject_reason")


def items_totals(items: DataFrame) -> DataFrame:
    """Line count and amount (quantity x price) per delivery."""
    return items.groupBy("delivery_id").agg(
        F.count("*").alias("item_count"), F.sum(F.col("quantity") * F.col("unit_price")).alias("items_amount")
    )


def delivery_totals(deliveries: DataFrame, items: DataFrame) -> DataFrame:
    """Deliveries with total_amount recomputed from their lines; 0 without lines."""
    total = F.round(F.coalesce(F.col("items_amount"), F.lit(0)), 2).cast(MONEY)
    return (
        deliveries.join(items_totals(items), "delivery_id", "left")
        .withColumn("total_amount", total)
        .select(*deliveries.columns)
    )


def price_delivery_lines(requests: DataFrame, deliveries: DataFrame, supplier_materials: DataFrame) -> DataFrame:
    """New delivery lines priced from the supplier's list, each with a reject reason or NULL."""
    prices = supplier_materials.filter(F.col("is_active")).select(
        "supplier_id", "material_id", F.col("purchase_price").alias("unit_price"), F.lit(True).alias("is_assigned")
    )
    reason = (
        F.when(F.col("delivery_status").isNull(), "delivery_missing")
        .when(F.col("delivery_status") != "planned", "delivery_closed")
        .when(F.col("quantity") <= 0, "quantity_not_positive")
        .when(F.col("expiry_date") <= F.col("delivery_date"), "expiry_before_delivery")
        .when(F.col("is_assigned").isNull(), "material_not_assigned")
        .when(F.col("unit_price").isNull(), "price_missing")
    )
    headers = deliveries.select(
        "delivery_id", "supplier_id", "delivery_date", F.col("status_code").alias("delivery_status")
    )
    return (
        requests.join(headers, "delivery_id", "left")
        .join(prices, ["supplier_id", "material_id"], "left")
        .select(
            "request_id",
            "delivery_id",
            "material_id",
            "quantity",
            "unit_price",
            clean_text(F.col("batch_number")).alias("batch_number"),
            "expiry_date",
            reason.alias("reject_reason"),
        )
    )


def number_documents(
    new: DataFrame, existing: DataFrame, id_column: str, number_column: str, prefix: str, order: str
) -> DataFrame:
    """New documents with the next free ids, in the order of a unique column, and their numbers.

    The new rows are written once to the shared folder, as numbering passes over
    them more than once.
    """
    new = cut_lineage(new)
    last = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("last")).scalar()
    return (
        numbered(new, order, id_column, start=last)
        .withColumn(number_column, document_number(prefix, F.col(id_column)))
    )


def create_supplier_invoices(
    deliveries: DataFrame, items: DataFrame, supplier_invoices: DataFrame, as_of: date
) -> tuple[DataFrame, DataFrame]:
    """Invoices for accepted deliveries that have none, due in seven days, and the refused deliveries."""
    reason = (
        F.when(F.col("status_code").isin("rejected", "cancelled"), "delivery_refused")
        .when(F.col("status_code") != "accepted", "delivery_not_accepted")
        .when(F.col("item_count").isNull() | (F.col("items_amount") <= 0), "no_items")
    )
    judged = (
        deliveries.join(supplier_invoices.select("delivery_id"), "delivery_id", "left_anti")
        .join(items_totals(items), "delivery_id", "left")
        .withColumn("reject_reason", reason)
    )
    new = judged.filter(F.col("reject_reason").isNull()).select(
        "delivery_id",
        "supplier_id",
        F.lit(as_of).alias("issue_date"),
        F.lit(as_of + timedelta(days=7)).alias("due_date"),
        F.round("items_amount", 2).cast(MONEY).alias("amount"),
        F.lit("issued").alias("status_code"),
        clean_text(F.col("document_ref")).alias("document_ref"),
        F.concat(F.lit("Счёт создан автоматически по поставке "), F.col("delivery_number"), F.lit(".")).alias("note"),
    )
    created = number_documents(
        new, supplier_invoices, "supplier_invoice_id", "supplier_invoice_number", "SINV-WEB-", "delivery_id"
    )
    return created, judged.filter(F.col("reject_reason").isNotNull()).select("delivery_id", "reject_reason")


def create_customer_invoices(
    orders: DataFrame, order_items: DataFrame, invoices: DataFrame, issue_date: date, due_date: date | None = None
) -> tuple[DataFrame, DataFrame]:
    """Invoices for all orders that may be invoiced, and the orders refused with the reason."""
    totals = order_items.groupBy("order_id").agg(
        F.count("*").alias("item_count"), F.coalesce(F.sum("line_amount"), F.lit(0)).alias("items_amount")
    )
    free = without_active_invoice(orders, invoices).select("order_id", F.lit(True).alias("is_free"))
    reason = (
        F.when(~F.col("status_code").isin(*INVOICEABLE_ORDER_STATUSES), "order_not_invoiceable")
        .when(F.col("item_count").isNull(), "no_items")
        .when(F.col("items_amount") <= 0, "amount_not_positive")
        .when(F.col("is_free").isNull(), "already_invoiced")
    )
    judged = (
        orders.select("order_id", "status_code")
        .join(totals, "order_id", "left")
        .join(free, "order_id", "left")
        .withColumn("reject_reason", reason)
    )
    new = judged.filter(F.col("reject_reason").isNull()).select(
        "order_id",
        F.lit(issue_date).alias("issue_date"),
        F.lit(due_date).cast("date").alias("due_date"),
        F.col("items_amount").cast(MONEY).alias("amount"),
        F.lit("issued").alias("status_code"),
    )
    created = number_documents(new, invoices, "invoice_id", "invoice_number", "INV-WEB-", "order_id")
    return created, judged.filter(F.col("reject_reason").isNotNull()).select("order_id", "reject_reason")


def create_shipments(
    requests: DataFrame, orders: DataFrame, invoices: DataFrame, shipments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Planned shipments (one request per order) for ready, paid orders, and the refused requests."""
    headers = orders.select("order_id", "order_date", F.col("status_code").alias("order_status"))
    reason = (
        F.when(F.col("order_status").isNull(), "order_missing")
        .when(F.col("order_status") != "ready", "order_not_ready")
        .when(F.col("payment_state") == "no_invoice", "no_invoice")
        .when(F.col("payment_state") == "unpaid", "invoice_not_paid")
        .when(F.to_date("shipped_at") < F.to_date("order_date"), "shipped_before_order")
    )
    judged = (
        requests.join(headers, "order_id", "left")
        .join(payment_status(orders, invoices), "order_id", "left")
        .withColumn("reject_reason", reason)
    )
    new = judged.filter(F.col("reject_reason").isNull()).select(
        "order_id", "shipped_at", F.lit("planned").alias("status_code"), "delivery_address"
    )
    created = number_documents(new, shipments, "shipment_id", "shipment_number", "SHP-WEB-", "order_id")
    return created, judged.filter(F.col("reject_reason").isNotNull()).select("order_id", "reject_reason")


def judge_ship_lines(
    requests: DataFrame,
    shipments: DataFrame,
    invoices: DataFrame,
    orders: DataFrame,
    order_items: DataFrame,
    stock: DataFrame,
    checks: DataFrame,
    shipment_items: DataFrame,
    as_of: date,
    in_steps: bool = False,
) -> DataFrame:
    """Every shipping request on its own against the present state, with a reject reason or NULL.

    With ``in_steps``, requests are written as a table in the shared folder before their order lines are looked up, so that
    what was shuffled until then need not stay on disk beside the order lines.
    """
    # The tables beside the requests are joined with each other first, and the widest comes last, so that the requests move
    # once for each of their three keys. They carry little: ids of text as short bytes, the first refusal as a number, and
    # what later checks compare only where there is none.
    packs_request = _is_text(requests, "request_id")
    packs_line = all(_is_text(df, "order_item_id") for df in (requests, order_items, shipment_items))
    if packs_request:
        requests = requests.withColumn("request_id", short_key(F.col("request_id")))
    if packs_line:
        line_id = short_key(F.col("order_item_id"))
        requests = requests.withColumn("order_item_id", line_id)
        # Spark tests again for NULLs what it joins with, and would make the bytes twice, unless it knows that there are none.
        order_items, shipment_items = (
            df.filter(F.col("order_item_id").isNotNull()).withColumn("order_item_id", F.coalesce(line_id, F.lit(b"")))
            for df in (order_items, shipment_items)
        )
    paid = payment_status(orders, invoices).select(F.col("order_id").alias("shipment_order"), "payment_state")
    headers = (
        shipments.select(
            "shipment_id", F.col("order_id").alias("shipment_order"), F.col("status_code").alias("shipment_status")
        )
        .join(paid, "shipment_order", "left")
        .select(
            "shipment_id",
            "shipment_order",
            F.when(F.col("shipment_status") != "planned", _CLOSED)
            .when(F.col("payment_state") == "no_invoice", _NO_INVOICE)
            .when(F.col("payment_state") == "unpaid", _UNPAID)
            .when(F.col("shipment_status").isNotNull(), _OPEN)
            .alias("shipment_state"),
        )
        .withColumn("shipment_state", F.col("shipment_state").cast("tinyint"))
    )
    approved = approved_keys(checks, "production_batch_id", "finished_product").withColumn("is_approved", F.lit(True))
    lots = (
        stock.select(
            "finished_stock_id",
            F.col("product_id").alias("lot_product"),
            F.col("quantity_current").alias("lot_quantity"),
            (F.col("expiry_date") < F.lit(as_of)).alias("is_expired"),
            "production_batch_id",
        )
        .join(approved, "production_batch_id", "left")
        .drop("production_batch_id")
    )
    lines = (
        order_items.join(shipped_so_far(shipment_items), "order_item_id", "left")
        .select(
            "order_item_id",
            F.col("order_id").alias("line_order"),
            F.col("product_id").alias("line_product"),
            (F.col("quantity") - F.coalesce(F.col("shipped_quantity"), F.lit(0))).alias("line_remaining"),
        )
    )
    asked = ["request_id", "shipment_id", "order_item_id", "finished_stock_id", "quantity"]
    is_open = F.col("refusal").isNull()
    by_shipment = _first(
        F.col("shipment_state").isNull(),
        F.col("shipment_state") == _CLOSED,
        F.col("quantity") <= 0,
        F.col("shipment_state") == _NO_INVOICE,
        F.col("shipment_state") == _UNPAID,
    )
    by_lot = _first(F.col("is_expired"), F.col("lot_quantity") < F.col("quantity"), F.col("is_approved").isNull())
    headed = (
        requests.join(headers, "shipment_id", "left")
        .withColumn("refusal", by_shipment)
        .select(*asked, "refusal", F.when(is_open, F.col("shipment_order")).alias("shipment_order"))
    )
    looked = left_lookup(headed, lots, "finished_stock_id", "request_id").select(
        *asked,
        "shipment_order",
        "lot_quantity",
        F.when(is_open, F.col("lot_product")).alias("lot_product"),
        F.when(is_open, by_lot + len(_BY_SHIPMENT)).otherwise(F.col("refusal")).cast("tinyint").alias("refusal"),
    )
    if in_steps:
        looked = cut_lineage(looked)
    refusal = F.get(F.array(*map(F.lit, _BY_SHIPMENT + _BY_LOT)), F.col("refusal").cast("int"))
    reason = (
        F.when(F.col("refusal") < len(_BY_SHIPMENT), refusal)
        .when(F.col("line_order").isNull() | (F.col("line_order") != F.col("shipment_order")), "line_of_other_order")
        .when(F.col("lot_product").isNull(), "lot_missing")
        .when(F.col("lot_product") != F.col("line_product"), "lot_of_other_product")
        .when(F.col("refusal").isNotNull(), refusal)
        .when(F.col("quantity") > F.col("line_remaining"), "exceeds_order")
    )
    return looked.join(lines, "order_item_id", "left").select(
        (key_text(F.col("request_id")) if packs_request else F.col("request_id")).alias("request_id"),
        "shipment_id",
        (key_text(F.col("order_item_id")) if packs_line else F.col("order_item_id")).alias("order_item_id"),
        F.col("line_product").alias("product_id"),
        "finished_stock_id",
        "quantity",
        "lot_quantity",
        "line_remaining",
        reason.alias("reject_reason"),
    )


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, StringType)


def _first(*conditions: Column) -> Column:
    """The number of the first condition that holds, or NULL."""
    found = F
    for number, condition in enumerate(conditions):
        found = found.when(condition, F.lit(number))
    return found.cast("tinyint")


def _judged_once(judged: DataFrame) -> DataFrame:
    """``judged`` as a table in the shared folder, as its accepted and its refused requests are read several times.

    A refused request keeps its id and reason only.
    """
    kept = F.col("reject_reason").isNull()
    always = ("request_id", "reject_reason")
    return cut_lineage(judged.select(*[F.col(c) if c in always else F.when(kept, F.col(c)).alias(c) for c in judged.columns]))


def ship_lines(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New shipment lines of a request batch served in request order, and all rejects.

    ``judged`` comes from ``judge_ship_lines``. Requests share lots and order
    lines; each takes from both or is refused, as if handled one after another.
    """
    judged = _judged_once(judged)
    sound = judged.filter(F.col("reject_reason").isNull())
    day = F.lit(date(1970, 1, 1)).alias("day")
    lot = F.concat(F.lit("lot:"), F.col("finished_stock_id").cast("string"))
    line = F.concat(F.lit("line:"), F.col("order_item_id").cast("string"))
    pairs = F.explode(
        F.array(
            F.struct(lot.alias("resource_id"), F.col("lot_quantity").alias("capacity")),
            F.struct(line.alias("resource_id"), F.col("line_remaining").alias("capacity")),
        )
    )
    drawn = sound.select("request_id", "quantity", day, F.lit(0).alias("skip"), pairs.alias("pair")).select(
        "request_id", "quantity", "day", "skip", "pair.resource_id", "pair.capacity"
    )
    capacity = drawn.groupBy("resource_id").agg(F.max("capacity").alias("capacity"))
    _, refused = admit(drawn.drop("capacity"), capacity)
    lines = sound.join(refused, "request_id", "left_anti").select(
        "request_id", "shipment_id", "order_item_id", "product_id", "finished_stock_id", "quantity"
    )
    rejects = judged.filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")
    return lines, rejects.unionByName(
        refused.select("request_id", F.lit("taken_by_earlier_request").alias("reject_reason"))
    )


def judge_order_lines(
    requests: DataFrame, orders: DataFrame, order_items: DataFrame, products: DataFrame, stock: DataFrame,
    checks: DataFrame, as_of: date,
) -> DataFrame:
    """Requests to add order lines, each on its own, with what the order may still add."""
    offers = available_quantity(products, stock, checks, as_of).select("product_id", "price", "quantity_available")
    present = order_items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("present_quantity"))
    is_draft = F.col("status_code") == "draft"
    headers = orders.select("order_id", F.when(F.col("status_code").isNotNull(), is_draft).alias("is_draft"))
    room = F.col("quantity_available") - F.coalesce(F.col("present_quantity"), F.lit(0))
    reason = (
        F.when(F.col("is_draft").isNull(), "order_missing")
        .when(~F.col("is_draft"), "order_not_draft")
        .when(F.col("quantity") <= 0, "quantity_not_positive")
        .when(F.col("price").isNull(), "product_unavailable")
        .when(F.col("quantity_available") <= 0, "out_of_stock")
        .when(F.col("quantity") > room, "insufficient_stock")
    )
    return (
        requests.join(headers, "order_id", "left")
        .join(offers, "product_id", "left")
        .join(present, ["order_id", "product_id"], "left")
        .select(
            "request_id",
            "order_id",
            "product_id",
            "quantity",
            "price",
            "present_quantity",
            room.alias("room"),
            reason.alias("reject_reason"),
        )
    )


def order_line_admission(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines after admitting requests in request order, and the rejected requests.

    Requests for a product an order already has add to that line and re-price it
    at the present price.
    """
    judged = _judged_once(judged)
    sound = judged.filter(F.col("reject_reason").isNull())
    resource = F.concat(F.col("order_id").cast("string"), F.lit("/"), F.col("product_id").cast("string"))
    needs = sound.select(
        "request_id",
        resource.alias("resource_id"),
        F.lit(date(1970, 1, 1)).alias("day"),
        "quantity",
        F.lit(0).alias("skip"),
        "room",
    )
    capacity = needs.groupBy("resource_id").agg(F.max("room").alias("capacity"))
    _, refused = admit(needs.drop("room"), capacity)
    total = F.sum("quantity") + F.coalesce(F.max("present_quantity"), F.lit(0))
    lines = (
        sound.join(refused, "request_id", "left_anti")
        .groupBy("order_id", "product_id")
        .agg(
            total.cast(QUANTITY).alias("quantity"),
            F.max("price").alias("unit_price"),
            F.count("*").alias("request_count"),
            F.bool_or(F.col("present_quantity").isNotNull()).alias("was_present"),
        )
        .withColumn("line_amount", line_amount(F.col("quantity"), F.col("unit_price")))
    )
    rejects = judged.filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")
    return lines, rejects.unionByName(refused.select("request_id", F.lit("insufficient_stock").alias("reject_reason")))
