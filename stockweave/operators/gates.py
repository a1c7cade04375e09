"""Quality gates, availability and the conditions that open or close a document."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.intervals import nodes_of_day, nodes_of_interval
from stockweave.functions.ordering import asc, desc
from stockweave.functions.scalars import label
from stockweave.schemas import (
    ACTIVE_INVOICE_STATUSES,
    COVERING_SHIPMENT_STATUSES,
    INVOICEABLE_ORDER_STATUSES,
)

#: Cards of a product with which each of its batches is compared one by one.
FEW_CARDS = 16


def approved_keys(checks: DataFrame, key: str, check_type: str) -> DataFrame:
    """Checked objects with at least one 'passed' and no 'failed' check.

    One pre-aggregated pass answers both conditions, so an object with very many
    checks is reduced before the shuffle.
    """
    verdicts = checks.filter(
        (F.col("check_type") == check_type)
        & F.col("result_code").isin("passed", "failed")
        & F.col(key).isNotNull()
    )
    return (
        verdicts.groupBy(key)
        .agg(F.bool_or(F.col("result_code") == "failed").alias("has_failed"))
        .filter(~F.col("has_failed"))
        .select(key)
    )


def qc_passed_lots(lots: DataFrame, checks: DataFrame, key: str, check_type: str) -> DataFrame:
    """The lots whose checked object is approved."""
    return lots.join(approved_keys(checks, key, check_type), key, "left_semi")


def usable_finished_lots(stock: DataFrame, checks: DataFrame, as_of: date) -> DataFrame:
    """Finished lots that are in stock, not expired and approved."""
    live = stock.filter((F.col("quantity_current") > 0) & (F.col("expiry_date") >= F.lit(as_of)))
    return qc_passed_lots(live, checks, "production_batch_id", "finished_product")


def _stock_per_product(lots: DataFrame) -> DataFrame:
    return lots.groupBy("product_id").agg(F.sum("quantity_current").alias("quantity_available"))


def _with_stock(products: DataFrame, lots: DataFrame) -> DataFrame:
    """Active products with the quantity of the given lots; 0 when there is none."""
    return (
        products.filter(F.col("is_active"))
        .join(_stock_per_product(lots), "product_id", "left")
        .withColumn("quantity_available", F.coalesce("quantity_available", F.lit(0)))
    )


def available_quantity(products: DataFrame, stock: DataFrame, checks: DataFrame, as_of: date) -> DataFrame:
    """Approved, unexpired quantity of every active product, zeros included."""
    return _with_stock(products, usable_finished_lots(stock, checks, as_of)).select(
        "product_id", "name", "category", "unit", "price", "shelf_life_days", "is_active", "quantity_available"
    )


def orderable_products(products: DataFrame, stock: DataFrame, checks: DataFrame, as_of: date) -> DataFrame:
    """The products that can be ordered now: available quantity above zero."""
    return (
        _with_stock(products, usable_finished_lots(stock, checks, as_of))
        .filter(F.col("quantity_available") > 0)
        .select("product_id", "name", "price", "quantity_available")
    )


def ungated_availability(products: DataFrame, stock: DataFrame, as_of: date, k: int | None = 10) -> DataFrame:
    """The catalogue of the client start page, by name: no quality gate, first ``k`` products."""
    live = stock.filter((F.col("quantity_current") > 0) & (F.col("expiry_date") >= F.lit(as_of)))
    listed = (
        _with_stock(products, live)
        .select("product_id", "name", "price", "unit", "quantity_available")
        .orderBy(asc("name"), asc("product_id"))
    )
    return listed.limit(k) if k else listed


def payment_status(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices and paid invoices per order, and the state they amount to."""
    counts = invoices.groupBy("order_id").agg(
        F.count("*").alias("invoice_count"), F.count_if(F.col("status_code") == "paid").alias("paid_count")
    )
    invoice_count = F.coalesce("invoice_count", F.lit(0))
    paid_count = F.coalesce("paid_count", F.lit(0))
    state = F.when(invoice_count == 0, "no_invoice").when(paid_count == 0, "unpaid").otherwise("paid")
    return (
        orders.select("order_id")
        .join(counts, "order_id", "left")
        .select(
            "order_id",
            invoice_count.alias("invoice_count"),
            paid_count.alias("paid_count"),
            state.alias("payment_state"),
        )
    )


def shippable_orders(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Ready orders with a paid invoice, newest id first."""
    paid = invoices.filter(F.col("status_code") == "paid").select("order_id")
    return (
        orders.filter(F.col("status_code") == "ready")
        .join(paid, "order_id", "left_semi")
        .select("order_id", label(F.col("order_number"), F.col("status_code")).alias("display_name"))
        .orderBy(desc("order_id"))
    )


def without_active_invoice(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """The orders that have no issued, overdue or paid invoice."""
    active = invoices.filter(F.col("status_code").isin(*ACTIVE_INVOICE_STATUSES)).select("order_id")
    return orders.join(active, "order_id", "left_anti")


def invoiceable_orders(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Confirmed or later orders without an active invoice, newest id first."""
    open_orders = orders.filter(F.col("status_code").isin(*INVOICEABLE_ORDER_STATUSES))
    return (
        without_active_invoice(open_orders, invoices)
        .select("order_id", label(F.col("order_number"), F.col("status_code")).alias("display_name"))
        .orderBy(desc("order_id"))
    )


def pickable_lots(
    order_id: int, stock: DataFrame, checks: DataFrame, order_items: DataFrame, products: DataFrame, as_of: date
) -> DataFrame:
    """The usable lots of one order's products, earliest expiry first."""
    wanted = order_items.filter(F.col("order_id") == order_id).select("product_id")
    lots = usable_finished_lots(stock, checks, as_of).join(wanted, "product_id", "left_semi")
    return (
        lots.join(products.select("product_id", "name"), "product_id")
        .select(
            "finished_stock_id",
            "product_id",
            "batch_number",
            "quantity_current",
            "expiry_date",
            F.concat(
                F.col("name"),
                F.lit(" / "),
                F.col("batch_number"),
                F.lit(" / остаток "),
                F.col("quantity_current").cast("string"),
                F.lit(" / годен до "),
                F.col("expiry_date").cast("string"),
            ).alias("display_name"),
        )
        .orderBy(asc("expiry_date"), asc("finished_stock_id"))
    )


def pickable_by_order(stock: DataFrame, checks: DataFrame, order_items: DataFrame, as_of: date) -> DataFrame:
    """For every order and product: the lots that can be picked, summed up, and the first to pick.

    Lots are summed per product before they meet the orders, so the result grows
    with the order lines, not with orders times lots.
    """
    first = F.min(F.struct("expiry_date", "finished_stock_id"))
    lots = (
        usable_finished_lots(stock, checks, as_of)
        .groupBy("product_id")
        .agg(F.count("*").alias("lot_count"), F.sum("quantity_current").alias("pickable_quantity"), first.alias("first"))
        .select(
            "product_id",
            "lot_count",
            "pickable_quantity",
            F.col("first.finished_stock_id").alias("first_lot_id"),
            F.col("first.expiry_date").alias("first_expiry"),
        )
    )
    wanted = order_items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("ordered_quantity"))
    return wanted.join(lots, "product_id").select(
        "order_id", "product_id", "ordered_quantity", "lot_count", "pickable_quantity", "first_lot_id", "first_expiry"
    )


def line_coverage(
    order_items: DataFrame,
    shipment_items: DataFrame,
    shipments: DataFrame,
    statuses: tuple[str, ...] = COVERING_SHIPMENT_STATUSES,
) -> DataFrame:
    """Ordered and shipped quantity per order line, counting shipments in ``statuses``."""
    counted = shipments.filter(F.col("status_code").isin(*statuses)).select("shipment_id")
    shipped = (
        shipment_items.join(counted, "shipment_id", "left_semi")
        .groupBy("order_item_id")
        .agg(F.sum("quantity").alias("shipped_quantity"))
    )
    return order_items.join(shipped, "order_item_id", "left").select(
        "order_id",
        "order_item_id",
        F.col("quantity").alias("ordered_quantity"),
        F.coalesce("shipped_quantity", F.lit(0)).alias("shipped_quantity"),
    )


def shipment_coverage(
    order_items: DataFrame,
    shipment_items: DataFrame,
    shipments: DataFrame,
    statuses: tuple[str, ...] = COVERING_SHIPMENT_STATUSES,
) -> DataFrame:
    """Per order with lines: whether no line is short."""
    lines = line_coverage(order_items, shipment_items, shipments, statuses)
    short = F.col("shipped_quantity") < F.col("ordered_quantity")
    return lines.groupBy("order_id").agg(
        F.count("*").alias("line_count"),
        F.count_if(short).alias("short_lines"),
        F.bool_and(~short).alias("is_covered"),
    )


def shipped_so_far(shipment_items: DataFrame) -> DataFrame:
    """Quantity per order line over all shipments, cancelled ones too."""
    return shipment_items.groupBy("order_item_id").agg(F.sum("quantity").alias("shipped_quantity"))


def overship_check(requests: DataFrame, order_items: DataFrame, shipment_items: DataFrame) -> DataFrame:
    """Each request alone: whether it would ship more than the line orders."""
    lines = order_items.select("order_item_id", F.col("quantity").alias("ordered_quantity"))
    return (
        requests.select("request_id", "order_item_id", F.col("quantity").alias("requested_quantity"))
        .join(lines, "order_item_id")
        .join(shipped_so_far(shipment_items), "order_item_id", "left")
        .withColumn("shipped_quantity", F.coalesce("shipped_quantity", F.lit(0)))
        .withColumn(
            "fits", F.col("shipped_quantity") + F.col("requested_quantity") <= F.col("ordered_quantity")
        )
    )


def tech_card_reason(day: Column, product_id: Column) -> Column:
    """Why a tech card cannot be used that day for that product; NULL when it can."""
    return (
        F.when(F.col("card_product_id").isNull(), "card_missing")
        .when(F.col("card_product_id") != product_id, "card_of_other_product")
        .when(F.col("card_status") != "active", "card_not_active")
        .when(F.col("effective_from") > day, "card_not_yet_effective")
        .when(F.col("effective_to") < day, "card_expired")
    )


def valid_tech_cards(uses: DataFrame, cards: DataFrame, products: DataFrame) -> DataFrame:
    """Uses of a card (production_batch_id, product_id, tech_card_id, day) with a reject reason."""
    side = cards.join(
        products.select("product_id", "shelf_life_days"), "product_id"
    ).select(
        "tech_card_id",
        F.col("product_id").alias("card_product_id"),
        F.col("status_code").alias("card_status"),
        "effective_from",
        "effective_to",
        "shelf_life_days",
    )
    reason = tech_card_reason(F.col("day"), F.col("product_id"))
    return uses.join(side, "tech_card_id", "left").select(
        "production_batch_id", "product_id", "tech_card_id", "day", "shelf_life_days", reason.alias("reject_reason")
    )


def cards_in_force(uses: DataFrame, cards: DataFrame) -> DataFrame:
    """(production_batch_id, tech_card_id): the active cards of the product that are effective on the day.

    A batch is compared with all cards of its product where these are at most ``FEW_CARDS``. For other products, days and
    periods meet by nodes of a tree of days (``functions.intervals``), so no card is compared with a batch outside its
    period, and a day of a product is looked up once, however many batches it has. Both joins are merges: Spark's guess of
    the size of the cards knows nothing of their nodes, so a broadcast could outgrow the driver.
    """
    # The lane is always 0. It keeps an equal key in the joins where the planner knows that there is just one product.
    key = ["product_id", "lane"]

    def lane(column: str) -> Column:
        return F.pmod(F.hash(column), F.lit(1)).alias("lane")

    active = cards.filter(F.col("status_code") == "active").select(
        "product_id", "tech_card_id", "effective_from", "effective_to", lane("tech_card_id")
    )
    used = uses.select("production_batch_id", "product_id", "day", lane("production_batch_id"))
    sizes = active.groupBy("product_id").agg(F.count("*").alias("card_count")).select("*", lane("card_count"))
    sized = active.join(sizes.hint("merge"), key)

    few = sized.filter(F.col("card_count") <= FEW_CARDS).drop("card_count")
    in_period = (F.col("effective_from") <= F.col("day")) & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("day")))
    compared = used.join(few.hint("merge"), key).filter(in_period).select("production_batch_id", "tech_card_id")

    crowded = sizes.filter(F.col("card_count") > FEW_CARDS).select(*key)
    nodes = sized.filter(F.col("card_count") > FEW_CARDS).select(
        "product_id", "tech_card_id", F.explode(nodes_of_interval(F.col("effective_from"), F.col("effective_to"))).alias("node")
    )
    looked = used.join(crowded.hint("merge"), key, "left_semi")
    asked = looked.select("product_id", "day").distinct().withColumn("node", F.explode(nodes_of_day(F.col("day"))))
    found = asked.join(nodes.hint("merge"), ["product_id", "node"]).select("product_id", "day", "tech_card_id")
    by_node = looked.join(found.hint("merge"), ["product_id", "day"]).select("production_batch_id", "tech_card_id")
    return compared.unionByName(by_node)


def editable_recipes(cards: DataFrame, batches: DataFrame) -> DataFrame:
    """Draft cards that no production batch uses."""
    return cards.filter(F.col("status_code") == "draft").join(
        batches.select("tech_card_id"), "tech_card_id", "left_anti"
    )


def stock_from_day(lots: DataFrame, days: DataFrame) -> DataFrame:
    """For each (material_id, day): stock that has not expired by that day.

    ``lots`` has material_id, expiry_date, gated (approved quantity) and ungated
    (any quantity). Lots are first added up per expiry day, so the window holds
    at most one row per calendar day on either side, however many lots there are.
    """
    daily = lots.groupBy("material_id", F.col("expiry_date").alias("day")).agg(
        F.sum("gated").alias("gated"), F.sum("ungated").alias("ungated"), F.lit(0).alias("is_asked")
    )
    asked = days.select("material_id", "day").distinct().select(
        "material_id", "day", F.lit(None).alias("gated"), F.lit(None).alias("ungated"), F.lit(1).alias("is_asked")
    )
    later = (
        Window.partitionBy("material_id")
        .orderBy(F.col("day").desc(), "is_asked")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        daily.unionByName(asked)
        .select(
            "material_id",
            "day",
            "is_asked",
            F.coalesce(F.sum("gated").over(later), F.lit(0)).alias("gated_left"),
            F.coalesce(F.sum("ungated").over(later), F.lit(0)).alias("ungated_left"),
        )
        .filter(F.col("is_asked") == 1)
        .drop("is_asked")
    )
