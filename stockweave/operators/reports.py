"""Period and stock reports. Dates are arguments; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.joins import left_lookup
from stockweave.functions.ordering import asc, desc, desc_nulls_last
from stockweave.functions.scalars import display_name, expiry_class, in_days
from stockweave.schemas import ACTIVE_ORDER_STATUSES, PAYABLE_INVOICE_STATUSES

TableSet = Mapping[str, DataFrame]


def _on_hand(t: TableSet) -> DataFrame:
    return t["raw_material_stock"].groupBy("material_id").agg(F.sum("quantity_current").alias("quantity_on_hand"))


def _materials_with_stock(t: TableSet) -> DataFrame:
    """All materials with their stock, 0 where there is none.

    Lots are added up by id below the join, so only one row per material moves.
    """
    return (
        t["raw_materials"]
        .join(_on_hand(t), "material_id", "left")
        .withColumn("quantity_on_hand", F.coalesce("quantity_on_hand", F.lit(0)))
    )


def material_stock_report(t: TableSet) -> DataFrame:
    """Stock per material name and unit; materials without lots are absent."""
    return (
        _on_hand(t)
        .join(t["raw_materials"].select("material_id", "name", "unit"), "material_id")
        .groupBy(F.col("name").alias("material_name"), "unit")
        .agg(F.sum("quantity_on_hand").alias("quantity_on_hand"))
        .orderBy(asc("material_name"), asc("unit"))
    )


def material_stock_all(t: TableSet) -> DataFrame:
    """Stock per material name, 0 included, lowest first."""
    return (
        _materials_with_stock(t)
        .groupBy("name")
        .agg(F.sum("quantity_on_hand").alias("qty"))
        .orderBy(asc("qty"), asc("name"))
    )


def low_stock(t: TableSet) -> DataFrame:
    """Materials below their minimum stock, one row per material id."""
    return (
        _materials_with_stock(t)
        .filter(F.col("quantity_on_hand") < F.col("min_stock_qty"))
        .select("material_id", "name", "min_stock_qty", "quantity_on_hand", "unit")
        .orderBy(asc("name"), asc("material_id"))
    )


def low_stock_report(t: TableSet) -> DataFrame:
    """Materials below their minimum stock, grouped by name, minimum and unit."""
    return (
        _materials_with_stock(t)
        .groupBy(F.col("name").alias("material_name"), "min_stock_qty", "unit")
        .agg(F.sum("quantity_on_hand").alias("quantity_on_hand"))
        .filter(F.col("quantity_on_hand") < F.col("min_stock_qty"))
        .orderBy(asc("material_name"))
    )


def stock_shortage(t: TableSet) -> DataFrame:
    """Minimum minus stock for every material; negative when there is more than enough."""
    return (
        _materials_with_stock(t)
        .select(
            "material_id",
            "name",
            "min_stock_qty",
            "quantity_on_hand",
            (F.col("min_stock_qty") - F.col("quantity_on_hand")).alias("shortage_qty"),
        )
        .orderBy(asc("name"), asc("material_id"))
    )


def finished_stock_report(t: TableSet) -> DataFrame:
    """Finished goods in stock per product name and unit."""
    lots = t["finished_goods_stock"].groupBy("product_id").agg(F.sum("quantity_current").alias("quantity_on_hand"))
    return (
        lots.join(t["products"].select("product_id", "name", "unit"), "product_id")
        .groupBy(F.col("name").alias("product_name"), "unit")
        .agg(F.sum("quantity_on_hand").alias("quantity_on_hand"))
        .orderBy(asc("product_name"), asc("unit"))
    )


def orders_in_period(t: TableSet, start: date, end: date) -> DataFrame:
    """Orders of the period with the customer's name, newest first."""
    return (
        t["customer_orders"]
        .filter(in_days(F.col("order_date"), start, end))
        .join(t["customers"], "customer_id")
        .select("order_number", display_name().alias("customer_name"), "order_date", "status_code")
        .orderBy(desc("order_date"), asc("order_number"))
    )


def production_in_period(t: TableSet, start: date, end: date) -> DataFrame:
    """Batches of the period with produced and defective quantity, newest first."""
    return (
        t["production_batches"]
        .filter(in_days(F.col("production_date"), start, end))
        .join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .select(
            "product_name", "batch_number", "production_date", "quantity_produced", "quantity_defective", "status_code"
        )
        .orderBy(desc("production_date"), asc("batch_number"))
    )


def sales_by_product(t: TableSet, start: date | None = None, end: date | None = None) -> DataFrame:
    """Quantity and amount sold per product name; orders of every status count.

    Lines are added up per product id before they meet the product names.
    """
    lines = t["order_items"].select("order_id", "product_id", "quantity", "line_amount")
    if start is not None:
        orders = t["customer_orders"].filter(in_days(F.col("order_date"), start, end)).select("order_id")
        lines = lines.join(orders, "order_id")
    sums = lines.groupBy("product_id").agg(F.sum("quantity").alias("q"), F.sum("line_amount").alias("a"))
    return (
        sums.join(t["products"].select("product_id", "name"), "product_id")
        .groupBy(F.col("name").alias("product_name"))
        .agg(F.sum("q").alias("total_quantity"), F.sum("a").alias("total_amount"))
        .orderBy(desc_nulls_last("total_amount"), asc("product_name"))
    )


def _supplier_invoices_named(t: TableSet) -> DataFrame:
    invoices = t["supplier_invoices"]
    return invoices.join(t["suppliers"].select("supplier_id", "company_name"), "supplier_id").join(
        t["raw_material_deliveries"].select("delivery_id", "delivery_number"), "delivery_id"
    )


def unpaid_supplier_invoices(t: TableSet, start: date, end: date) -> DataFrame:
    """Issued or overdue supplier invoices issued in the period, by due date."""
    return (
        _supplier_invoices_named(t)
        .filter(
            F.col("status_code").isin(*PAYABLE_INVOICE_STATUSES)
            & F.col("issue_date").between(F.lit(start), F.lit(end))
        )
        .select(
            "supplier_invoice_number",
            "company_name",
            "delivery_number",
            "issue_date",
            "due_date",
            "amount",
            "status_code",
        )
        .orderBy(asc("due_date"), desc("issue_date"), asc("supplier_invoice_number"))
    )


def paid_supplier_invoices(t: TableSet, start: date, end: date) -> DataFrame:
    """Supplier invoices paid in the period, latest payment first."""
    return (
        _supplier_invoices_named(t)
        .filter((F.col("status_code") == "paid") & in_days(F.col("paid_at"), start, end))
        .select(
            "supplier_invoice_number",
            "company_name",
            "delivery_number",
            "issue_date",
            "paid_at",
            "amount",
            "status_code",
        )
        .orderBy(desc("paid_at"), asc("supplier_invoice_number"))
    )


def supplier_invoice_summary(t: TableSet, start: date, end: date) -> DataFrame:
    """One row: what is owed now (whatever its date) and what was paid in the period."""
    owed = F.when(F.col("status_code").isin(*PAYABLE_INVOICE_STATUSES), F.col("amount")).otherwise(0)
    paid = F.when((F.col("status_code") == "paid") & in_days(F.col("paid_at"), start, end), F.col("amount")).otherwise(0)
    return t["supplier_invoices"].agg(
        F.coalesce(F.sum(owed), F.lit(0)).alias("outstanding_amount"),
        F.coalesce(F.sum(paid), F.lit(0)).alias("paid_amount"),
    )


def quality_checks_named(t: TableSet, checks: DataFrame) -> DataFrame:
    """Checks with the name of the material or product they are about.

    A check points to a delivery line or to a batch; both sides are looked up and
    the name that exists is taken. Each side gets its name first, so the checks
    pass two lookups, and the half without a key on a side is spread out.
    """
    materials = t["raw_materials"].select("material_id", F.col("name").alias("material_name"))
    products = t["products"].select("product_id", F.col("name").alias("product_name"))
    lines = t["delivery_items"].select("delivery_item_id", "material_id").join(materials, "material_id")
    batches = t["production_batches"].select("production_batch_id", "product_id").join(products, "product_id")
    named = left_lookup(checks, lines.drop("material_id"), "delivery_item_id", "quality_check_id")
    named = left_lookup(named, batches.drop("product_id"), "production_batch_id", "quality_check_id")
    return named.withColumn("object_name", F.coalesce("material_name", "product_name"))


def quality_in_period(t: TableSet, start: date, end: date) -> DataFrame:
    """Checks of the period with the checked object's name, newest first."""
    checks = t["quality_checks"].filter(in_days(F.col("checked_at"), start, end))
    return (
        quality_checks_named(t, checks)
        .select("check_type", "checked_at", "result_code", "document_number", "object_name", "quality_check_id")
        .orderBy(desc("checked_at"), asc("quality_check_id"))
        .drop("quality_check_id")
    )


def orders_by_month(t: TableSet) -> DataFrame:
    """Orders per month and year."""
    return (
        t["customer_orders"]
        .groupBy(F.date_trunc("month", "order_date").alias("order_month"), F.year("order_date").alias("order_year"))
        .agg(F.count("*").alias("orders_count"))
        .orderBy(asc("order_month"))
    )


def orders_per_customer(t: TableSet) -> DataFrame:
    """Orders per customer id, most first."""
    return (
        t["customer_orders"]
        .groupBy("customer_id")
        .agg(F.count("*").alias("orders_count"))
        .orderBy(desc("orders_count"), asc("customer_id"))
    )


def customer_activity(t: TableSet) -> DataFrame:
    """Orders and last order date per customer name, customers without orders included."""
    per_customer = (
        t["customer_orders"]
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("n"), F.max("order_date").alias("last"))
    )
    return (
        t["customers"]
        .join(per_customer, "customer_id", "left")
        .groupBy(display_name().alias("customer_name"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders_count"), F.max("last").alias("last_order_date"))
        .orderBy(desc("orders_count"), asc("customer_name"))
    )


def category_price_stats(t: TableSet) -> DataFrame:
    """Products and average price per category, dearest first; the average has four places."""
    return (
        t["products"]
        .groupBy("category")
        .agg(F.count("*").alias("products_count"), F.round(F.avg("price"), 4).alias("average_price"))
        .orderBy(desc("average_price"), asc("category"))
    )


def order_totals(t: TableSet) -> DataFrame:
    """Sum of line amounts per order that exists and has lines."""
    sums = t["order_items"].groupBy("order_id").agg(F.sum("line_amount").alias("order_amount"))
    return t["customer_orders"].select("order_id").join(sums, "order_id").orderBy(asc("order_id"))


def production_stats(t: TableSet) -> DataFrame:
    """One row: average defects, first and last production time."""
    return t["production_batches"].agg(
        F.round(F.avg("quantity_defective"), 4).alias("avg_defective_qty"),
        F.min("production_date").alias("first_production_at"),
        F.max("production_date").alias("last_production_at"),
    )


def kpi_dashboard(t: TableSet) -> DataFrame:
    """One row of counts for the staff start page; each table is read once."""
    orders = t["customer_orders"].agg(
        F.count("*").alias("order_count"),
        F.count_if(F.col("status_code").isin(*ACTIVE_ORDER_STATUSES)).alias("active_order_count"),
    )
    materials = _materials_with_stock(t).agg(
        F.struct(
            F.count("*").alias("all"),
            F.count_if(F.col("quantity_on_hand") < F.col("min_stock_qty")).alias("low"),
        ).alias("materials")
    )
    customers = t["customers"].agg(F.count("*").alias("customer_count"))
    products = t["products"].agg(F.count("*").alias("product_count"))
    return orders.select("*", materials.scalar().alias("materials")).select(
        customers.scalar().alias("customer_count"),
        "order_count",
        products.scalar().alias("product_count"),
        F.col("materials.all").alias("material_count"),
        "active_order_count",
        F.col("materials.low").alias("low_stock_material_count"),
    )


def customer_dashboard(t: TableSet) -> DataFrame:
    """Orders, invoices and shipments per customer, with the number of active products."""
    orders = t["customer_orders"].select("order_id", "customer_id")
    invoices = t["invoices"].groupBy("order_id").agg(F.count("*").alias("invoices"))
    shipments = t["shipments"].groupBy("order_id").agg(F.count("*").alias("shipments"))
    per_customer = (
        orders.join(invoices, "order_id", "left")
        .join(shipments, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("order_count"),
            F.coalesce(F.sum("invoices"), F.lit(0)).alias("invoice_count"),
            F.coalesce(F.sum("shipments"), F.lit(0)).alias("shipment_count"),
        )
    )
    active = t["products"].filter("is_active").agg(F.count("*")).scalar()
    return (
        t["customers"]
        .select("customer_id")
        .join(per_customer, "customer_id", "left")
        .fillna(0, ["order_count", "invoice_count", "shipment_count"])
        .withColumn("product_count", active)
    )


def recent_orders(t: TableSet, k: int = 5) -> DataFrame:
    """The newest ``k`` orders; the id settles ties."""
    latest = t["customer_orders"].orderBy(desc("order_date"), desc("order_id")).limit(k)
    return (
        latest.join(t["customers"], "customer_id")
        .select("order_id", "order_number", "status_code", "order_date", display_name().alias("customer_name"))
        .orderBy(desc("order_date"), desc("order_id"))
    )


def recent_audit(t: TableSet, k: int = 5) -> DataFrame:
    """The newest ``k`` audit rows with the user's name or 'system'."""
    latest = t["audit_log"].orderBy(desc("changed_at"), desc("audit_id")).limit(k)
    return (
        latest.join(t["users"].select("user_id", "username"), "user_id", "left")
        .select(
            "audit_id",
            "changed_at",
            "action_type",
            "table_name",
            "record_id",
            F.coalesce("username", F.lit("system")).alias("username"),
        )
        .orderBy(desc("changed_at"), desc("audit_id"))
    )


def _newest_per_customer(rows: DataFrame, order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))
    return rows.withColumn("place", rank).filter(F.col("place") <= k)


def recent_orders_per_customer(t: TableSet, k: int = 5) -> DataFrame:
    """The newest ``k`` orders of every customer.

    The rank filter is applied per task before the shuffle, so a customer with
    very many orders sends at most ``k`` rows from each task.
    """
    orders = t["customer_orders"].select("customer_id", "order_id", "order_number", "status_code", "order_date")
    return _newest_per_customer(orders, [desc("order_date"), desc("order_id")], k)


def recent_invoices_per_customer(t: TableSet, k: int = 5) -> DataFrame:
    """The newest ``k`` invoices of every customer."""
    rows = t["invoices"].join(t["customer_orders"].select("order_id", "customer_id"), "order_id").select(
        "customer_id", "invoice_id", "invoice_number", "issue_date", "amount", "status_code"
    )
    return _newest_per_customer(rows, [desc("issue_date"), desc("invoice_id")], k)


def recent_shipments_per_customer(t: TableSet, k: int = 5) -> DataFrame:
    """The latest ``k`` shipments of every customer; those not yet shipped come last."""
    rows = t["shipments"].join(t["customer_orders"].select("order_id", "customer_id"), "order_id").select(
        "customer_id", "shipment_id", "shipment_number", "shipped_at", "status_code", "delivery_address"
    )
    return _newest_per_customer(rows, [desc_nulls_last("shipped_at"), desc("shipment_id")], k)


def shipment_report(t: TableSet) -> DataFrame:
    """Every shipment's header with its line count and total quantity."""
    lines = t["shipment_items"].groupBy("shipment_id").agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("total_quantity")
    )
    employees = t["users"].select(F.col("user_id").alias("created_by_user_id"), F.col("full_name").alias("employee_name"))
    customers = t["customers"].select("customer_id", display_name().alias("customer_name"))
    headers = (
        t["shipments"]
        .join(t["customer_orders"].select("order_id", "order_number", "customer_id"), "order_id")
        .join(customers, "customer_id")
    )
    return (
        left_lookup(headers, employees, "created_by_user_id", "shipment_id")
        .join(lines, "shipment_id", "left")
        .select(
            "shipment_id",
            "shipment_number",
            "shipped_at",
            "status_code",
            "delivery_address",
            "waybill_number",
            "note",
            "order_number",
            "customer_name",
            "employee_name",
            F.coalesce("line_count", F.lit(0)).alias("line_count"),
            F.coalesce("total_quantity", F.lit(0)).alias("total_quantity"),
        )
    )


def shipment_report_lines(t: TableSet) -> DataFrame:
    """The lines below the shipment headers, with product and lot."""
    lots = t["finished_goods_stock"].select("finished_stock_id", "batch_number", "expiry_date")
    products = t["products"].select("product_id", F.col("name").alias("product_name"), "unit")
    return (
        left_lookup(t["shipment_items"].join(products, "product_id"), lots, "finished_stock_id", "shipment_item_id")
        .select(
            "shipment_id",
            "shipment_item_id",
            "product_name",
            "order_item_id",
            "batch_number",
            "quantity",
            "unit",
            "expiry_date",
        )
    )


def material_lot_register(t: TableSet, as_of: date) -> DataFrame:
    """Material lots with their expiry class, earliest expiry first."""
    materials = t["raw_materials"].select("material_id", F.col("name").alias("material_name"), "unit")
    return (
        t["raw_material_stock"]
        .join(materials, "material_id")
        .select(
            "stock_id",
            "material_name",
            "batch_number",
            "quantity_current",
            "unit",
            "expiry_date",
            "updated_at",
            expiry_class(F.col("expiry_date"), as_of).alias("expiry_class"),
        )
        .orderBy(asc("expiry_date"), asc("material_name"), asc("stock_id"))
    )


def finished_lot_register(t: TableSet, as_of: date) -> DataFrame:
    """Finished lots, marked when expired, earliest expiry first."""
    products = t["products"].select("product_id", F.col("name").alias("product_name"), "unit")
    return (
        t["finished_goods_stock"]
        .join(products, "product_id")
        .select(
            "finished_stock_id",
            "product_name",
            "batch_number",
            "quantity_current",
            "unit",
            "production_date",
            "expiry_date",
            (F.col("expiry_date") < F.lit(as_of)).alias("is_expired"),
        )
        .orderBy(asc("expiry_date"), asc("product_name"), asc("finished_stock_id"))
    )
