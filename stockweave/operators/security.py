"""Row policies, grants and role rules, applied to many rows at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.literals import literal_rows
from stockweave.schemas import LAYOUTS, STATUSES

TableSet = Mapping[str, DataFrame]

# Roles in order of priority.
ROLE_PRIORITY = ("admin", "technologist", "warehouse_worker", "quality_control", "client")

# Staff roles that see every row of a protected table.
STAFF_ACCESS = {
    "customer_orders": ("admin", "technologist", "warehouse_worker", "quality_control"),
    "order_items": ("admin", "technologist", "warehouse_worker", "quality_control"),
    "invoices": ("admin",),
    "shipments": ("admin", "warehouse_worker"),
    "shipment_items": ("admin", "warehouse_worker"),
}

# Roles that may open a section. Admins may open all.
SECTION_ROLES = {
    "dashboard": ("admin", "technologist", "warehouse_worker", "quality_control", "client"),
    "customers": ("admin",),
    "suppliers": ("admin", "warehouse_worker"),
    "materials": ("admin", "technologist", "warehouse_worker", "quality_control"),
    "deliveries": ("admin", "warehouse_worker"),
    "material_stock": ("admin", "technologist", "warehouse_worker", "quality_control"),
    "products": ("admin", "technologist", "warehouse_worker", "quality_control", "client"),
    "tech_cards": ("admin", "technologist"),
    "orders": ("admin", "technologist", "warehouse_worker", "client"),
    "production": ("admin", "technologist"),
    "finished_stock": ("admin", "technologist", "warehouse_worker"),
    "quality": ("admin", "quality_control"),
    "invoices": ("admin", "client"),
    "supplier_invoices": ("admin", "warehouse_worker"),
    "shipments": ("admin", "warehouse_worker", "client"),
    "reports": ("admin", "technologist", "warehouse_worker", "quality_control"),
    "audit": ("admin",),
    "users_roles": ("admin",),
}

# Roles that may do an action. Admins may do all.
ACTION_ROLES = {
    "orders.view_all": ("admin", "technologist", "warehouse_worker"),
    "orders.view_own": ("client",),
    "orders.create": ("admin", "client"),
    "orders.add_item": ("admin", "client"),
    "orders.change_status": ("admin", "technologist"),
    "orders.cancel": ("admin",),
    "invoices.view_all": ("admin",),
    "invoices.view_own": ("client",),
    "invoices.create": ("admin",),
    "invoices.change_status": ("admin",),
    "invoices.pay_own": ("client",),
    "supplier_invoices.view": ("warehouse_worker",),
    "supplier_invoices.pay": ("admin",),
    "supplier_invoices.manage": ("admin",),
    "shipments.view_all": ("admin", "warehouse_worker"),
    "shipments.view_own": ("client",),
    "shipments.create": ("admin", "warehouse_worker"),
    "shipments.add_item": ("admin", "warehouse_worker"),
    "shipments.change_status": ("admin", "warehouse_worker"),
    "shipments.report": ("admin", "warehouse_worker", "client"),
    "production.view": ("admin", "technologist"),
    "production.create": ("admin", "technologist"),
    "production.change_status": ("admin", "technologist"),
    "quality.view": ("admin", "quality_control"),
    "quality.create": ("admin", "quality_control"),
    "audit.view": ("admin",),
    "users.manage": ("admin",),
    "deliveries.view": ("admin", "warehouse_worker"),
    "deliveries.create": ("admin", "warehouse_worker"),
    "deliveries.add_item": ("admin", "warehouse_worker"),
    "deliveries.change_status": ("admin", "warehouse_worker"),
    "materials.manage": ("admin", "warehouse_worker"),
    "suppliers.manage_materials": ("admin", "warehouse_worker"),
    "products.manage": ("admin",),
    "tech_cards.manage": ("admin", "technologist"),
    "tech_cards.view": ("admin", "technologist"),
    "tech_cards.change_status": ("admin", "technologist"),
    "reports.view_full": ("admin",),
    "reports.view_production": ("technologist",),
    "reports.view_warehouse": ("warehouse_worker",),
    "reports.view_quality": ("quality_control",),
}

# Database grants. Admins hold all four privileges on every table.
READ_GRANTS = {
    "technologist": (
        *STATUSES,
        "users",
        "roles",
        "user_roles",
        "raw_materials",
        "products",
        "tech_cards",
        "recipe_items",
        "customer_orders",
        "order_items",
        "production_batches",
        "quality_checks",
    ),
    "warehouse_worker": (
        "order_statuses",
        "shipment_statuses",
        "delivery_statuses",
        "production_statuses",
        "user_statuses",
        "customers",
        "users",
        "suppliers",
        "supplier_invoices",
        "raw_materials",
        "products",
        "customer_orders",
        "order_items",
        "production_batches",
        "finished_goods_stock",
    ),
    "quality_control": (
        "delivery_statuses",
        "production_statuses",
        "quality_statuses",
        "tech_card_statuses",
        "user_statuses",
        "users",
        "suppliers",
        "raw_materials",
        "raw_material_deliveries",
        "delivery_items",
        "products",
        "tech_cards",
        "production_batches",
        "quality_checks",
    ),
    "client": (
        "order_statuses",
        "invoice_statuses",
        "shipment_statuses",
        "products",
        "customer_orders",
        "order_items",
        "invoices",
        "shipments",
        "shipment_items",
    ),
}
WRITE_GRANTS = {  # insert and update
    "technologist": ("products", "tech_cards", "recipe_items", "production_batches"),
    "warehouse_worker": (
        "suppliers",
        "supplier_materials",
        "raw_material_deliveries",
        "delivery_items",
        "raw_material_stock",
        "finished_goods_stock",
        "shipments",
        "shipment_items",
    ),
    "quality_control": ("quality_checks",),
}


def row_policy(t: TableSet, table: str, role: str, user_id: int | None) -> DataFrame:
    """The rows of a protected table that a user sees in a role.

    Staff see all rows of the tables open to them. Clients see the rows of their
    own customer, child tables through their parents. Everybody else, and a user
    without a customer, sees nothing.
    """
    rows = t[table]
    if role in STAFF_ACCESS[table]:
        return rows
    if role != "client" or user_id is None:
        return rows.filter(F.lit(False))
    own = t["users"].filter(F.col("user_id") == user_id).select("customer_id")
    orders = t["customer_orders"].join(own, "customer_id", "left_semi")
    if table == "customer_orders":
        return orders
    if table == "shipment_items":
        shipments = t["shipments"].join(orders.select("order_id"), "order_id", "left_semi")
        return rows.join(shipments.select("shipment_id"), "shipment_id", "left_semi")
    return rows.join(orders.select("order_id"), "order_id", "left_semi")


def visible_rows(t: TableSet, table: str, users: DataFrame) -> DataFrame:
    """(user_id, key columns …): the rows of ``table`` each client user sees, for many users at once."""
    own = users.filter(F.col("customer_id").isNotNull()).select("user_id", "customer_id")
    orders = t["customer_orders"].join(own, "customer_id").select("user_id", "order_id")
    if table == "customer_orders":
        return orders
    if table == "shipment_items":
        shipments = t["shipments"].select("order_id", "shipment_id").join(orders, "order_id")
        return t[table].join(shipments.select("user_id", "shipment_id"), "shipment_id")
    return t[table].join(orders, "order_id")


def own_rows(rows: DataFrame, customer_id: int | None) -> DataFrame:
    """Rows of one customer; nothing for a user without a customer."""
    return rows.filter(F.col("customer_id") == F.lit(customer_id))


def _rules(spark: SparkSession, rules: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    pairs = [(rule, role) for rule, roles in rules.items() for role in sorted({*roles, "admin"})]
    return literal_rows(spark, pairs, [name, "role_code"])


def _role_codes(t: TableSet) -> DataFrame:
    return t["user_roles"].select("user_id", "role_id").distinct().join(t["roles"], "role_id").select(
        "user_id", "role_code"
    )


def _allowed(t: TableSet, rules: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    spark = t["user_roles"].sparkSession
    return _role_codes(t).join(_rules(spark, rules, name), "role_code").select("user_id", name).distinct()


def can_access(t: TableSet) -> DataFrame:
    """(user_id, section) for every section a user may open."""
    return _allowed(t, SECTION_ROLES, "section")


def has_action(t: TableSet) -> DataFrame:
    """(user_id, action) for every action a user may do."""
    return _allowed(t, ACTION_ROLES, "action")


def primary_role(t: TableSet) -> DataFrame:
    """Every user with the first of their roles by priority; NULL without one."""
    place = reduce(
        lambda chain, pair: chain.when(F.col("role_code") == pair[1], pair[0]), enumerate(ROLE_PRIORITY), F
    )
    first = _role_codes(t).groupBy("user_id").agg(F.min_by("role_code", place).alias("primary_role"))
    return t["users"].select("user_id", "username").join(first, "user_id", "left")


def load_users(t: TableSet) -> DataFrame:
    """Users with the sorted array of their role codes (empty without roles) and their primary role."""
    roles = _role_codes(t).groupBy("user_id").agg(F.array_sort(F.collect_list("role_code")).alias("roles"))
    return (
        t["users"]
        .join(roles, "user_id", "left")
        .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
        .join(primary_role(t).select("user_id", "primary_role"), "user_id", "left")
    )


def grants(spark: SparkSession) -> DataFrame:
    """(role_code, object_name, can_select, can_insert, can_update, can_delete) as granted in the database."""
    rows = [("admin", table, True, True, True, True) for table in LAYOUTS]
    for role, readable in READ_GRANTS.items():
        writable = WRITE_GRANTS.get(role, ())
        for table in dict.fromkeys((*readable, *writable)):
            rows.append((role, table, table in readable, table in writable, table in writable, False))
    return literal_rows(
        spark, rows, ["role_code", "object_name", "can_select", "can_insert", "can_update", "can_delete"]
    )


def grants_matrix(t: TableSet) -> DataFrame:
    """Database grants beside the stored role permissions, with the number of users each pair concerns."""
    privileges = ("can_select", "can_insert", "can_update", "can_delete")
    given = grants(t["roles"].sparkSession).select(
        "role_code", "object_name", *[F.col(p).alias(f"granted_{p[4:]}") for p in privileges]
    )
    stored = (
        t["role_permissions"]
        .join(t["roles"].select("role_id", "role_code"), "role_id")
        .select("role_code", "object_name", *[F.col(p).alias(f"stored_{p[4:]}") for p in privileges])
    )
    holders = _role_codes(t).groupBy("role_code").agg(F.count("*").alias("user_count"))
    both = given.join(stored, ["role_code", "object_name"], "full")
    agrees = reduce(
        lambda a, b: a & b,
        [F.col(f"granted_{p[4:]}").eqNullSafe(F.col(f"stored_{p[4:]}")) for p in privileges],
    )
    return (
        both.withColumn("agrees", agrees)
        .join(holders, "role_code", "left")
        .withColumn("user_count", F.coalesce("user_count", F.lit(0)))
    )
