"""Registers, document details and pick lists."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.joins import left_lookup
from stockweave.functions.ordering import asc, desc, desc_nulls_last
from stockweave.functions.scalars import days_left, display_name, in_days, label
from stockweave.operators.reports import _materials_with_stock, quality_checks_named

TableSet = Mapping[str, DataFrame]


def where_given(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """Filters by the conditions that are not None, all together."""
    given = [c for c in conditions.values() if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def _equals(column: str, value) -> Column | None:
    return None if value in (None, "") else F.col(column) == F.lit(value)


# -- detail listings of the report script ------------------------------------


def order_contents(t: TableSet, order_id: int | None = None) -> DataFrame:
    """Order lines with order number, product and unit; of one order when given."""
    lines = where_given(t["order_items"], order=_equals("order_id", order_id))
    return (
        lines.join(t["customer_orders"].select("order_id", "order_number"), "order_id")
        .join(t["products"].select("product_id", F.col("name").alias("product_name"), "unit"), "product_id")
        .select("order_number", "order_item_id", "product_name", "quantity", "unit", "unit_price", "line_amount")
    )


def customer_orders(t: TableSet, customer_id: int) -> DataFrame:
    """One customer's orders, oldest first."""
    return (
        t["customer_orders"]
        .filter(F.col("customer_id") == customer_id)
        .join(t["customers"], "customer_id")
        .select("full_name", "company_name", "order_number", "order_date", "planned_shipment_date", "status_code")
        .orderBy(asc("order_date"), asc("order_number"))
    )


def invoices_by_order(t: TableSet) -> DataFrame:
    """Invoices with their order number, by issue date."""
    return (
        t["invoices"]
        .join(t["customer_orders"].select("order_id", "order_number"), "order_id")
        .select("order_number", "invoice_number", "issue_date", "due_date", "amount", "status_code")
        .orderBy(asc("issue_date"), asc("invoice_number"))
    )


def shipments_in_period(t: TableSet, start: date, end: date) -> DataFrame:
    """Shipments that left in the period, by time."""
    return (
        t["shipments"]
        .filter(in_days(F.col("shipped_at"), start, end))
        .join(t["customer_orders"].select("order_id", "order_number"), "order_id")
        .select("shipment_number", "order_number", "shipped_at", "status_code", "delivery_address")
        .orderBy(asc("shipped_at"), asc("shipment_number"))
    )


def active_recipes(t: TableSet) -> DataFrame:
    """Recipe lines of active cards with product and material names."""
    cards = t["tech_cards"].filter(F.col("status_code") == "active").select("tech_card_id", "product_id", "card_number")
    return (
        t["recipe_items"]
        .join(cards, "tech_card_id")
        .join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(t["raw_materials"].select("material_id", F.col("name").alias("material_name")), "material_id")
        .select("card_number", "product_name", "material_name", "stage", "quantity", "unit", "waste_percent")
        .orderBy(asc("card_number"), asc("stage"), asc("material_name"))
    )


# -- registers ----------------------------------------------------------------


def delivery_register(t: TableSet) -> DataFrame:
    return (
        t["raw_material_deliveries"]
        .join(t["suppliers"].select("supplier_id", "company_name"), "supplier_id")
        .select("delivery_id", "delivery_number", "company_name", "delivery_date", "status_code", "total_amount")
        .orderBy(desc("delivery_date"), desc("delivery_id"))
    )


def order_register(t: TableSet, customer_id: int | None = None, status_code: str | None = None) -> DataFrame:
    """Orders with the customer's name, newest first; filtered by what is given."""
    orders = where_given(
        t["customer_orders"],
        customer=_equals("customer_id", customer_id),
        status=_equals("status_code", status_code),
    )
    return (
        orders.join(t["customers"], "customer_id")
        .select(
            "order_id",
            "order_number",
            display_name().alias("customer_name"),
            "order_date",
            "planned_shipment_date",
            "status_code",
        )
        .orderBy(desc("order_date"), desc("order_id"))
    )


def invoice_register(t: TableSet, customer_id: int | None = None) -> DataFrame:
    orders = where_given(t["customer_orders"], customer=_equals("customer_id", customer_id))
    return (
        t["invoices"]
        .join(orders.select("order_id", "order_number"), "order_id")
        .select(
            "invoice_id", "invoice_number", "order_number", "issue_date", "due_date", "paid_at", "amount", "status_code"
        )
        .orderBy(desc("issue_date"), desc("invoice_id"))
    )


def supplier_invoice_register(t: TableSet) -> DataFrame:
    return (
        t["supplier_invoices"]
        .join(t["suppliers"].select("supplier_id", "company_name"), "supplier_id")
        .join(t["raw_material_deliveries"].select("delivery_id", "delivery_number"), "delivery_id")
        .select(
            "supplier_invoice_id",
            "supplier_invoice_number",
            "company_name",
            "delivery_number",
            "issue_date",
            "due_date",
            "amount",
            "status_code",
            "paid_at",
        )
        .orderBy(desc("issue_date"), desc("supplier_invoice_id"))
    )


def shipment_register(t: TableSet, customer_id: int | None = None) -> DataFrame:
    orders = where_given(t["customer_orders"], customer=_equals("customer_id", customer_id))
    return (
        t["shipments"]
        .join(orders.select("order_id", "order_number"), "order_id")
        .select("shipment_id", "shipment_number", "order_number", "shipped_at", "status_code", "waybill_number")
        .orderBy(desc_nulls_last("shipped_at"), desc("shipment_id"))
    )


def production_register(t: TableSet) -> DataFrame:
    return (
        t["production_batches"]
        .join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(t["tech_cards"].select("tech_card_id", "card_number"), "tech_card_id")
        .select(
            "production_batch_id",
            "batch_number",
            "product_name",
            "card_number",
            "production_date",
            "quantity_produced",
            "quantity_defective",
            "status_code",
        )
        .orderBy(desc("production_date"), desc("production_batch_id"))
    )


def tech_card_register(t: TableSet) -> DataFrame:
    return (
        t["tech_cards"]
        .join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .select(
            "tech_card_id", "card_number", "product_name", "version", "status_code", "effective_from", "effective_to"
        )
        .orderBy(asc("tech_card_id"))
    )


def customer_register(t: TableSet) -> DataFrame:
    return (
        t["customers"]
        .select("customer_id", "customer_type", display_name().alias("display_name"), "phone", "email", "is_active")
        .orderBy(asc("customer_id"))
    )


def supplier_register(t: TableSet) -> DataFrame:
    return (
        t["suppliers"]
        .select("supplier_id", "company_name", "contact_person", "phone", "email", "is_active")
        .orderBy(asc("supplier_id"))
    )


def material_register(t: TableSet) -> DataFrame:
    """Materials with stock and whether it is below the minimum."""
    return (
        _materials_with_stock(t)
        .select(
            "material_id",
            "name",
            "unit",
            "min_stock_qty",
            "quantity_on_hand",
            "shelf_life_days",
            "is_active",
            (F.col("quantity_on_hand") < F.col("min_stock_qty")).alias("is_low"),
        )
        .orderBy(asc("material_id"))
    )


def product_register(t: TableSet) -> DataFrame:
    return (
        t["products"]
        .select("product_id", "name", "category", "unit", "price", "shelf_life_days", "is_active")
        .orderBy(asc("product_id"))
    )


def quality_register(t: TableSet, check_type: str | None = None, result_code: str | None = None) -> DataFrame:
    """Quality checks with the object's name, newest first; filtered by what is given."""
    checks = where_given(
        t["quality_checks"], kind=_equals("check_type", check_type), result=_equals("result_code", result_code)
    )
    return (
        quality_checks_named(t, checks)
        .select("quality_check_id", "check_type", "checked_at", "result_code", "document_number", "object_name")
        .orderBy(desc("checked_at"), desc("quality_check_id"))
    )


def audit_search(
    t: TableSet,
    user_id: int | None = None,
    table_name: str | None = None,
    action_type: str | None = None,
    changed_on: date | None = None,
) -> DataFrame:
    """Audit rows with the user's name or 'system', newest first; filtered by what is given."""
    day = None if changed_on is None else in_days(F.col("changed_at"), changed_on, changed_on)
    rows = where_given(
        t["audit_log"],
        user=_equals("user_id", user_id),
        table=_equals("table_name", table_name),
        action=_equals("action_type", action_type),
        day=day,
    )
    return (
        left_lookup(rows, t["users"].select("user_id", "username"), "user_id", "audit_id")
        .select(
            "audit_id",
            "changed_at",
            F.coalesce("username", F.lit("system")).alias("username"),
            "action_type",
            "table_name",
            "record_id",
            "success",
        )
        .orderBy(desc("changed_at"), desc("audit_id"))
    )


# -- header and child rows ------------------------------------------------------


def delivery_details(t: TableSet) -> DataFrame:
    """Deliveries with supplier, lines and supplier invoice; one row per line, or one without lines."""
    invoice = t["supplier_invoices"].select(
        "delivery_id",
        "supplier_invoice_number",
        F.col("amount").alias("invoice_amount"),
        F.col("status_code").alias("invoice_status"),
    )
    materials = t["raw_materials"].select("material_id", F.col("name").alias("material_name"))
    items = (
        t["delivery_items"]
        .join(materials, "material_id")
        .select(
            "delivery_id", "delivery_item_id", "material_name", "quantity", "unit_price", "batch_number", "expiry_date"
        )
    )
    return (
        t["raw_material_deliveries"]
        .select("delivery_id", "delivery_number", "delivery_date", "status_code", "supplier_id")
        .join(t["suppliers"].select("supplier_id", "company_name"), "supplier_id")
        .join(invoice, "delivery_id", "left")
        .join(items, "delivery_id", "left")
    )


def order_details(t: TableSet) -> DataFrame:
    """Orders with customer and lines; one row per line, or one for an empty order."""
    products = t["products"].select("product_id", F.col("name").alias("product_name"))
    items = (
        t["order_items"]
        .join(products, "product_id")
        .select("order_id", "order_item_id", "product_name", "quantity", "unit_price", "line_amount")
    )
    customers = t["customers"].select("customer_id", display_name().alias("customer_name"))
    return (
        t["customer_orders"]
        .select("order_id", "order_number", "customer_id", "order_date", "status_code")
        .join(customers, "customer_id")
        .join(items, "order_id", "left")
    )


def order_shipments(t: TableSet) -> DataFrame:
    """Shipments below each order."""
    return t["customer_orders"].select("order_id", "order_number").join(
        t["shipments"].select("order_id", "shipment_id", "shipment_number", "shipped_at", "status_code", "delivery_address"),
        "order_id",
    )


def tech_card_details(t: TableSet) -> DataFrame:
    """Cards with product, approver and recipe lines."""
    approvers = t["users"].select(
        F.col("user_id").alias("approved_by_user_id"), F.col("full_name").alias("approved_by_name")
    )
    materials = t["raw_materials"].select("material_id", F.col("name").alias("material_name"))
    recipe = (
        t["recipe_items"]
        .join(materials, "material_id")
        .select("tech_card_id", "recipe_item_id", "material_name", "quantity", "unit", "stage", "waste_percent")
    )
    return (
        t["tech_cards"]
        .select("tech_card_id", "card_number", "version", "status_code", "product_id", "approved_by_user_id")
        .join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(approvers, "approved_by_user_id", "left")
        .join(recipe, "tech_card_id", "left")
        .drop("approved_by_user_id")
    )


def product_details(t: TableSet) -> DataFrame:
    """Products with their tech cards."""
    cards = t["tech_cards"].select(
        "product_id", "tech_card_id", "card_number", "version", "status_code", "effective_from", "effective_to"
    )
    return t["products"].select("product_id", "name", "price", "shelf_life_days").join(cards, "product_id", "left")


def supplier_details(t: TableSet) -> DataFrame:
    """Suppliers with the materials they offer."""
    materials = t["raw_materials"].select("material_id", F.col("name").alias("material_name"))
    offers = (
        t["supplier_materials"]
        .join(materials, "material_id")
        .select(
            "supplier_id",
            "supplier_material_id",
            "material_name",
            "purchase_price",
            "lead_time_days",
            F.col("is_active").alias("offer_active"),
        )
    )
    return t["suppliers"].select("supplier_id", "company_name", "phone").join(offers, "supplier_id", "left")


def material_details(t: TableSet) -> DataFrame:
    """Materials with their lots."""
    lots = t["raw_material_stock"].select("material_id", "stock_id", "batch_number", "quantity_current", "expiry_date")
    return t["raw_materials"].select("material_id", "name", "unit", "min_stock_qty").join(lots, "material_id", "left")


def customer_details(t: TableSet) -> DataFrame:
    """Customers with their orders."""
    orders = t["customer_orders"].select(
        "customer_id", "order_number", "order_date", "status_code", "planned_shipment_date"
    )
    customers = t["customers"].select("customer_id", display_name().alias("customer_name"), "phone")
    return customers.join(orders, "customer_id", "left")


def invoice_headers(t: TableSet) -> DataFrame:
    """Invoices with order number and customer."""
    orders = t["customer_orders"].select("order_id", "order_number", "customer_id")
    return t["invoices"].join(orders, "order_id").select(
        "invoice_id",
        "invoice_number",
        "order_id",
        "issue_date",
        "due_date",
        "paid_at",
        "amount",
        "status_code",
        "order_number",
        "customer_id",
    )


# -- users and roles --------------------------------------------------------------


def _roles_of_users(t: TableSet) -> DataFrame:
    """(user_id, role_id, role_code, role_name), each pair once."""
    return t["user_roles"].select("user_id", "role_id").distinct().join(t["roles"], "role_id").select(
        "user_id", "role_id", "role_code", "role_name"
    )


def users_with_roles(t: TableSet) -> DataFrame:
    """Users with their role names in order, joined by ', '; '' when there is none.

    A user holds each role once, so the collected list is as short as the role
    dictionary.
    """
    names = _roles_of_users(t).groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("role_name")), ", ").alias("roles")
    )
    return (
        t["users"]
        .select("user_id", "username", "full_name", "status_code")
        .join(names, "user_id", "left")
        .withColumn("roles", F.coalesce("roles", F.lit("")))
        .orderBy(asc("user_id"))
    )


def role_members(t: TableSet) -> DataFrame:
    """Roles with the number of users that hold them."""
    members = t["user_roles"].groupBy("role_id").agg(F.count("user_id").alias("assigned_users"))
    return (
        t["roles"]
        .join(members, "role_id", "left")
        .select("role_id", "role_code", "role_name", F.coalesce("assigned_users", F.lit(0)).alias("assigned_users"))
        .orderBy(asc("role_id"))
    )


def active_users_with_role(t: TableSet, *role_codes: str) -> DataFrame:
    """Active users that hold any of the roles, each once, by name."""
    holders = (
        t["user_roles"].join(t["roles"].filter(F.col("role_code").isin(*role_codes)), "role_id").select("user_id")
    )
    return (
        t["users"]
        .filter(F.col("status_code") == "active")
        .join(holders, "user_id", "left_semi")
        .select("user_id", "full_name")
        .orderBy(asc("full_name"), asc("user_id"))
    )


# -- date arithmetic and pick lists ------------------------------------------------


def invoice_age(t: TableSet, as_of: date) -> DataFrame:
    """Age of every invoice in days."""
    return t["invoices"].select(
        "invoice_number", "issue_date", (-days_left(F.col("issue_date"), as_of)).alias("age_days")
    )


def delivery_due(t: TableSet, days: int = 7) -> DataFrame:
    """Deliveries with the day payment is planned for."""
    return t["raw_material_deliveries"].select(
        "delivery_number", "delivery_date", F.date_add("delivery_date", days).alias("planned_payment_date")
    )


def days_to_expiry(t: TableSet, as_of: date) -> DataFrame:
    """Days each finished lot has left."""
    return t["finished_goods_stock"].select(
        "batch_number", "expiry_date", days_left(F.col("expiry_date"), as_of).alias("days_to_expiry")
    )


def active_names(t: TableSet, table: str, key: str, name: str = "name") -> DataFrame:
    """Active rows of a table as (key, name), by name."""
    return t[table].filter("is_active").select(key, name).orderBy(asc(name), asc(key))


def customer_names(t: TableSet) -> DataFrame:
    """Customers as (id, display name), by name."""
    return (
        t["customers"]
        .select("customer_id", display_name().alias("display_name"))
        .orderBy(asc("display_name"), asc("customer_id"))
    )


def active_card_labels(t: TableSet) -> DataFrame:
    """Active tech cards as 'number / vN / product'."""
    products = t["products"].select("product_id", "name")
    version = F.concat(F.lit("v"), F.col("version").cast("string"))
    return (
        t["tech_cards"]
        .filter(F.col("status_code") == "active")
        .join(products, "product_id")
        .orderBy(asc("name"), asc("card_number"), desc("version"))
        .select("tech_card_id", label(F.col("card_number"), version, F.col("name")).alias("card_label"))
    )


def delivery_item_labels(t: TableSet) -> DataFrame:
    """Delivery lines as 'material / lot', with words for a missing lot number."""
    materials = t["raw_materials"].select("material_id", "name")
    return (
        t["delivery_items"]
        .join(materials, "material_id")
        .select(
            "delivery_item_id",
            label(F.col("name"), F.coalesce(F.col("batch_number"), F.lit("без партии"))).alias("display_name"),
        )
        .orderBy(desc("delivery_item_id"))
    )


def batch_labels(t: TableSet) -> DataFrame:
    """Production batches as 'number / product'."""
    return (
        t["production_batches"]
        .join(t["products"].select("product_id", "name"), "product_id")
        .select("production_batch_id", label(F.col("batch_number"), F.col("name")).alias("display_name"))
        .orderBy(desc("production_batch_id"))
    )


def order_line_labels(t: TableSet) -> DataFrame:
    """Order lines as 'product / заказано quantity'."""
    ordered = F.concat(F.lit("заказано "), F.col("quantity").cast("string"))
    return (
        t["order_items"]
        .join(t["products"].select("product_id", "name"), "product_id")
        .select("order_item_id", "product_id", label(F.col("name"), ordered).alias("display_name"))
    )


def status_names(t: TableSet, dictionary: str) -> DataFrame:
    """A status dictionary as (code, name), by name."""
    return t[dictionary].select("status_code", "name").orderBy(asc("name"))
