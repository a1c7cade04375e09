"""Table layouts, status codes, transition edges and integrity rules, all as data."""

from __future__ import annotations

from pyspark.sql.types import StructType

MONEY = "decimal(12,2)"
QUANTITY = "decimal(12,3)"

_STATUS_LAYOUT = "status_code string, name string, description string"

# ---------------------------------------------------------------------------
# Status dictionaries (code, display name).
# ---------------------------------------------------------------------------
STATUSES = {
    "order_statuses": [
        ("draft", "Draft"),
        ("confirmed", "Confirmed"),
        ("in_production", "In Production"),
        ("ready", "Ready"),
        ("shipped", "Shipped"),
        ("completed", "Completed"),
        ("cancelled", "Cancelled"),
    ],
    "invoice_statuses": [
        ("issued", "Issued"),
        ("paid", "Paid"),
        ("overdue", "Overdue"),
        ("cancelled", "Cancelled"),
    ],
    "shipment_statuses": [
        ("planned", "Planned"),
        ("shipped", "Shipped"),
        ("delivered", "Delivered"),
        ("cancelled", "Cancelled"),
    ],
    "delivery_statuses": [
        ("planned", "Planned"),
        ("received", "Received"),
        ("accepted", "Accepted"),
        ("rejected", "Rejected"),
        ("cancelled", "Cancelled"),
    ],
    "production_statuses": [
        ("planned", "Planned"),
        ("in_progress", "In Progress"),
        ("completed", "Completed"),
        ("rejected", "Rejected"),
    ],
    "quality_statuses": [
        ("passed", "Passed"),
        ("failed", "Failed"),
        ("conditional", "Conditional"),
    ],
    "tech_card_statuses": [
        ("draft", "Draft"),
        ("active", "Active"),
        ("archived", "Archived"),
    ],
    "user_statuses": [
        ("active", "Active"),
        ("blocked", "Blocked"),
        ("disabled", "Disabled"),
    ],
}

# ---------------------------------------------------------------------------
# Allowed status changes (from, to) per document kind.
# ---------------------------------------------------------------------------
EDGES = {
    "order": [
        ("draft", "confirmed"),
        ("draft", "cancelled"),
        ("confirmed", "in_production"),
        ("confirmed", "cancelled"),
        ("in_production", "ready"),
        ("ready", "shipped"),
        ("shipped", "completed"),
    ],
    "shipment": [
        ("planned", "shipped"),
        ("planned", "cancelled"),
        ("shipped", "delivered"),
    ],
    "delivery": [
        ("planned", "received"),
        ("planned", "cancelled"),
        ("received", "accepted"),
        ("received", "rejected"),
    ],
    "production": [
        ("planned", "in_progress"),
        ("planned", "cancelled"),
        ("in_progress", "completed"),
        ("in_progress", "cancelled"),
    ],
    "invoice": [
        ("issued", "paid"),
        ("issued", "overdue"),
        ("overdue", "paid"),
    ],
    "tech_card": [
        ("draft", "active"),
        ("draft", "archived"),
        ("active", "archived"),
    ],
}

#: Edges a role other than admin may use on orders.
ORDER_ROLE_EDGES = [("technologist", "confirmed", "in_production")]

DICTIONARY_OF = {
    "order": "order_statuses",
    "shipment": "shipment_statuses",
    "delivery": "delivery_statuses",
    "production": "production_statuses",
    "invoice": "invoice_statuses",
    "tech_card": "tech_card_statuses",
}

# Status sets used by the operators.
INVOICEABLE_ORDER_STATUSES = ("confirmed", "in_production", "ready", "shipped", "completed")
ACTIVE_ORDER_STATUSES = ("confirmed", "in_production", "ready", "shipped")
ACTIVE_INVOICE_STATUSES = ("issued", "overdue", "paid")
PAYABLE_INVOICE_STATUSES = ("issued", "overdue")
STOCKED_DELIVERY_STATUSES = ("received", "accepted")
COVERING_SHIPMENT_STATUSES = ("shipped", "delivered")

# ---------------------------------------------------------------------------
# Table layouts.
# ---------------------------------------------------------------------------
LAYOUTS = {
    **{name: _STATUS_LAYOUT for name in STATUSES},
    "customers": (
        "customer_id bigint, customer_type string, full_name string, company_name string, phone string, "
        "email string, delivery_address string, created_at timestamp, is_active boolean"
    ),
    "suppliers": (
        "supplier_id bigint, company_name string, contact_person string, phone string, email string, "
        "address string, created_at timestamp, is_active boolean"
    ),
    "raw_materials": (
        f"material_id bigint, name string, unit string, min_stock_qty {QUANTITY}, shelf_life_days int, "
        "storage_conditions string, is_active boolean"
    ),
    "products": (
        f"product_id bigint, name string, category string, unit string, price {MONEY}, shelf_life_days int, "
        "is_active boolean, created_at timestamp"
    ),
    "roles": "role_id bigint, role_code string, role_name string, description string",
    "users": (
        "user_id bigint, username string, password_hash string, full_name string, email string, phone string, "
        "status_code string, customer_id bigint, created_at timestamp, last_login_at timestamp"
    ),
    "user_roles": "user_id bigint, role_id bigint, assigned_at timestamp, assigned_by_user_id bigint",
    "role_permissions": (
        "permission_id bigint, role_id bigint, object_name string, can_select boolean, can_insert boolean, "
        "can_update boolean, can_delete boolean"
    ),
    "supplier_materials": (
        f"supplier_material_id bigint, supplier_id bigint, material_id bigint, purchase_price {MONEY}, "
        "lead_time_days int, is_active boolean"
    ),
    "raw_material_deliveries": (
        "delivery_id bigint, supplier_id bigint, delivery_number string, delivery_date date, status_code string, "
        f"received_by_user_id bigint, document_ref string, total_amount {MONEY}, note string"
    ),
    "delivery_items": (
        f"delivery_item_id bigint, delivery_id bigint, material_id bigint, quantity {QUANTITY}, "
        f"unit_price {MONEY}, batch_number string, expiry_date date"
    ),
    "raw_material_stock": (
        "stock_id bigint, material_id bigint, delivery_item_id bigint, batch_number string, "
        f"quantity_current {QUANTITY}, expiry_date date, updated_at timestamp"
    ),
    "tech_cards": (
        "tech_card_id bigint, product_id bigint, card_number string, version int, status_code string, "
        "effective_from date, effective_to date, baking_time_min int, baking_temperature_c decimal(5,2), "
        "process_description string, approved_by_user_id bigint"
    ),
    "recipe_items": (
        f"recipe_item_id bigint, tech_card_id bigint, material_id bigint, quantity {QUANTITY}, unit string, "
        "stage string, waste_percent decimal(5,2), note string"
    ),
    "customer_orders": (
        "order_id bigint, order_number string, customer_id bigint, order_date timestamp, "
        "planned_shipment_date date, status_code string, created_by_user_id bigint, comment string"
    ),
    "order_items": (
        f"order_item_id bigint, order_id bigint, product_id bigint, quantity {QUANTITY}, unit_price {MONEY}, "
        f"line_amount {MONEY}"
    ),
    "production_batches": (
        "production_batch_id bigint, batch_number string, product_id bigint, tech_card_id bigint, "
        f"production_date timestamp, shift string, quantity_produced {QUANTITY}, quantity_defective {QUANTITY}, "
        "responsible_user_id bigint, status_code string, note string"
    ),
    "finished_goods_stock": (
        "finished_stock_id bigint, product_id bigint, production_batch_id bigint, batch_number string, "
        f"quantity_current {QUANTITY}, production_date date, expiry_date date, updated_at timestamp"
    ),
    "quality_checks": (
        "quality_check_id bigint, check_type string, delivery_item_id bigint, production_batch_id bigint, "
        "checked_at timestamp, inspector_user_id bigint, result_code string, parameter_name string, "
        "measured_value string, standard_value string, document_number string, note string"
    ),
    "invoices": (
        "invoice_id bigint, invoice_number string, order_id bigint, issue_date date, due_date date, "
        f"paid_at timestamp, amount {MONEY}, status_code string, note string"
    ),
    "supplier_invoices": (
        "supplier_invoice_id bigint, supplier_invoice_number string, delivery_id bigint, supplier_id bigint, "
        f"issue_date date, due_date date, paid_at timestamp, amount {MONEY}, status_code string, "
        "document_ref string, note string"
    ),
    "shipments": (
        "shipment_id bigint, shipment_number string, order_id bigint, shipped_at timestamp, status_code string, "
        "delivery_address string, waybill_number string, created_by_user_id bigint, note string"
    ),
    "shipment_items": (
        "shipment_item_id bigint, shipment_id bigint, order_item_id bigint, product_id bigint, "
        f"finished_stock_id bigint, quantity {QUANTITY}"
    ),
    "audit_log": (
        "audit_id bigint, user_id bigint, action_type string, table_name string, record_id string, "
        "changed_at timestamp, old_data string, new_data string, ip_address string, success boolean"
    ),
}

#: Parents before children: the order in which tables can be loaded and checked.
LOAD_ORDER = list(LAYOUTS)

PRIMARY_KEYS = {
    **{name: ("status_code",) for name in STATUSES},
    "customers": ("customer_id",),
    "suppliers": ("supplier_id",),
    "raw_materials": ("material_id",),
    "products": ("product_id",),
    "roles": ("role_id",),
    "users": ("user_id",),
    "user_roles": ("user_id", "role_id"),
    "role_permissions": ("permission_id",),
    "supplier_materials": ("supplier_material_id",),
    "raw_material_deliveries": ("delivery_id",),
    "delivery_items": ("delivery_item_id",),
    "raw_material_stock": ("stock_id",),
    "tech_cards": ("tech_card_id",),
    "recipe_items": ("recipe_item_id",),
    "customer_orders": ("order_id",),
    "order_items": ("order_item_id",),
    "production_batches": ("production_batch_id",),
    "finished_goods_stock": ("finished_stock_id",),
    "quality_checks": ("quality_check_id",),
    "invoices": ("invoice_id",),
    "supplier_invoices": ("supplier_invoice_id",),
    "shipments": ("shipment_id",),
    "shipment_items": ("shipment_item_id",),
    "audit_log": ("audit_id",),
}

#: Columns by whose ranges the files of a stored table are cut, where that is not the key: lines lie with their document,
#: lots with their material or product in the order in which they are used up, and documents with their period.
#: Readers by these columns then skip the other files by their statistics.
STORED_BY = {
    "supplier_materials": ("supplier_id", "material_id"),
    "raw_material_deliveries": ("delivery_date", "delivery_id"),
    "delivery_items": ("delivery_id", "delivery_item_id"),
    "raw_material_stock": ("material_id", "expiry_date"),
    "tech_cards": ("product_id", "effective_from"),
    "recipe_items": ("tech_card_id", "material_id"),
    "customer_orders": ("order_date", "order_id"),
    "order_items": ("order_id", "product_id"),
    "production_batches": ("production_date", "production_batch_id"),
    "finished_goods_stock": ("product_id", "expiry_date"),
    "quality_checks": ("checked_at", "quality_check_id"),
    "invoices": ("order_id", "invoice_id"),
    "supplier_invoices": ("issue_date", "supplier_invoice_id"),
    "shipments": ("order_id", "shipment_id"),
    "shipment_items": ("shipment_id", "order_item_id"),
    "audit_log": ("changed_at", "audit_id"),
}

# The tables whose changes are audited.
AUDITED_TABLES = (
    "customers",
    "suppliers",
    "raw_materials",
    "products",
    "tech_cards",
    "recipe_items",
    "customer_orders",
    "order_items",
    "production_batches",
    "quality_checks",
    "invoices",
    "supplier_invoices",
    "shipments",
    "users",
    "roles",
    "user_roles",
)

#: Column defaults of an append; callables take (as_of date, now timestamp) literals.
DEFAULTS = {
    "customers": {"created_at": "now", "is_active": True},
    "suppliers": {"created_at": "now", "is_active": True},
    "raw_materials": {"min_stock_qty": 0, "is_active": True},
    "users": {"created_at": "now"},
    "role_permissions": {"can_select": False, "can_insert": False, "can_update": False, "can_delete": False},
    "user_roles": {"assigned_at": "now"},
    "supplier_materials": {"is_active": True},
    "raw_material_deliveries": {"delivery_date": "as_of", "total_amount": 0},
    "raw_material_stock": {"updated_at": "now"},
    "products": {"is_active": True, "created_at": "now"},
    "recipe_items": {"waste_percent": 0},
    "customer_orders": {"order_date": "now"},
    "production_batches": {"production_date": "now", "quantity_defective": 0},
    "finished_goods_stock": {"updated_at": "now"},
    "quality_checks": {"checked_at": "now"},
    "invoices": {"issue_date": "as_of"},
    "audit_log": {"changed_at": "now", "success": True},
}


def layout(table: str) -> StructType:
    """The Spark schema of a table."""
    return StructType.fromDDL(LAYOUTS[table])
