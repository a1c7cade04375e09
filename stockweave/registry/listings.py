"""Registers, details, pick lists and date listings."""

from __future__ import annotations

from datetime import date

from stockweave.operators import listings
from stockweave.registry.base import AS_OF, END, START, query

_NAME = "coalesce(c.company_name, c.full_name)"

query(
    "r17_order_contents",
    """
SELECT o.order_number, i.order_item_id, p.name AS product_name, i.quantity, p.unit, i.unit_price, i.line_amount
FROM {order_items} AS i
JOIN {customer_orders} AS o ON o.order_id = i.order_id
JOIN {products} AS p ON p.product_id = i.product_id""",
    decimals="quantity unit_price line_amount",
)(lambda t: listings.order_contents(t))

query(
    "r17_one_order_contents",
    """
SELECT o.order_number, i.order_item_id, p.name AS product_name, i.quantity, p.unit, i.unit_price, i.line_amount
FROM {order_items} AS i
JOIN {customer_orders} AS o ON o.order_id = i.order_id
JOIN {products} AS p ON p.product_id = i.product_id
WHERE i.order_id = 42""",
    decimals="quantity unit_price line_amount",
)(lambda t: listings.order_contents(t, 42))

query(
    "r17_customer_orders",
    """
SELECT c.full_name, c.company_name, o.order_number, o.order_date, o.planned_shipment_date, o.status_code
FROM {customer_orders} AS o JOIN {customers} AS c ON c.customer_id = o.customer_id WHERE o.customer_id = 7""",
)(lambda t: listings.customer_orders(t, 7))

query(
    "r17_invoices_by_order",
    """
SELECT o.order_number, i.invoice_number, i.issue_date, i.due_date, i.amount, i.status_code
FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id""",
    decimals="amount",
)(listings.invoices_by_order)

query(
    "r17_shipments_in_period",
    """
SELECT s.shipment_number, o.order_number, s.shipped_at, s.status_code, s.delivery_address
FROM {shipments} AS s JOIN {customer_orders} AS o ON o.order_id = s.order_id
WHERE CAST(s.shipped_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
)(lambda t: listings.shipments_in_period(t, START, END))

query(
    "r18_active_recipes",
    """
SELECT tc.card_number, p.name AS product_name, rm.name AS material_name, ri.stage, ri.quantity, ri.unit, ri.waste_percent
FROM {recipe_items} AS ri
JOIN {tech_cards} AS tc ON tc.tech_card_id = ri.tech_card_id
JOIN {products} AS p ON p.product_id = tc.product_id
JOIN {raw_materials} AS rm ON rm.material_id = ri.material_id
WHERE tc.status_code = 'active'""",
    decimals="quantity waste_percent",
)(listings.active_recipes)

query(
    "r24_audit_search",
    """
SELECT a.audit_id, a.changed_at, coalesce(u.username, 'system') AS username, a.action_type, a.table_name, a.record_id, a.success
FROM {audit_log} AS a LEFT JOIN {users} AS u ON u.user_id = a.user_id""",
)(lambda t: listings.audit_search(t))

query(
    "r24_audit_search_filtered",
    """
SELECT a.audit_id, a.changed_at, coalesce(u.username, 'system') AS username, a.action_type, a.table_name, a.record_id, a.success
FROM {audit_log} AS a LEFT JOIN {users} AS u ON u.user_id = a.user_id
WHERE a.table_name = 'users' AND a.action_type = 'LOGIN' AND CAST(a.changed_at AS DATE) = DATE '2024-01-05'""",
)(
    lambda t: listings.audit_search(
        t, table_name="users", action_type="LOGIN", changed_on=date(2024, 1, 5)
    )
)

query(
    "r25_document_registers",
    f"""
SELECT o.order_id, o.order_number, {_NAME} AS customer_name, o.order_date, o.planned_shipment_date, o.status_code
FROM {{customer_orders}} AS o JOIN {{customers}} AS c ON c.customer_id = o.customer_id""",
)(lambda t: listings.order_register(t))

query(
    "r25_orders_filtered",
    f"""
SELECT o.order_id, o.order_number, {_NAME} AS customer_name, o.order_date, o.planned_shipment_date, o.status_code
FROM {{customer_orders}} AS o JOIN {{customers}} AS c ON c.customer_id = o.customer_id
WHERE o.status_code = 'ready'""",
)(lambda t: listings.order_register(t, status_code="ready"))

query(
    "r25_deliveries",
    """
SELECT d.delivery_id, d.delivery_number, s.company_name, d.delivery_date, d.status_code, d.total_amount
FROM {raw_material_deliveries} AS d JOIN {suppliers} AS s ON s.supplier_id = d.supplier_id""",
    decimals="total_amount",
)(listings.delivery_register)

query(
    "r25_invoices",
    """
SELECT i.invoice_id, i.invoice_number, o.order_number, i.issue_date, i.due_date, i.paid_at, i.amount, i.status_code
FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id""",
    decimals="amount",
)(lambda t: listings.invoice_register(t))

query(
    "r25_supplier_invoices",
    """
SELECT si.supplier_invoice_id, si.supplier_invoice_number, s.company_name, d.delivery_number, si.issue_date, si.due_date,
       si.amount, si.status_code, si.paid_at
FROM {supplier_invoices} AS si
JOIN {suppliers} AS s ON s.supplier_id = si.supplier_id
JOIN {raw_material_deliveries} AS d ON d.delivery_id = si.delivery_id""",
    decimals="amount",
)(listings.supplier_invoice_register)

query(
    "r25_shipments",
    """
SELECT s.shipment_id, s.shipment_number, o.order_number, s.shipped_at, s.status_code, s.waybill_number
FROM {shipments} AS s JOIN {customer_orders} AS o ON o.order_id = s.order_id""",
)(lambda t: listings.shipment_register(t))

query(
    "r25_production",
    """
SELECT b.production_batch_id, b.batch_number, p.name AS product_name, tc.card_number, b.production_date,
       b.quantity_produced, b.quantity_defective, b.status_code
FROM {production_batches} AS b
JOIN {products} AS p ON p.product_id = b.product_id
JOIN {tech_cards} AS tc ON tc.tech_card_id = b.tech_card_id""",
    decimals="quantity_produced quantity_defective",
)(listings.production_register)

query(
    "r25_tech_cards",
    """
SELECT tc.tech_card_id, tc.card_number, p.name AS product_name, tc.version, tc.status_code, tc.effective_from, tc.effective_to
FROM {tech_cards} AS tc JOIN {products} AS p ON p.product_id = tc.product_id""",
)(listings.tech_card_register)

query(
    "r25_customers",
    f"""
SELECT c.customer_id, c.customer_type, {_NAME} AS display_name, c.phone, c.email, c.is_active FROM {{customers}} AS c""",
)(listings.customer_register)

query(
    "r25_suppliers",
    "SELECT supplier_id, company_name, contact_person, phone, email, is_active FROM {suppliers}",
)(listings.supplier_register)

query(
    "r25_materials",
    """
SELECT m.material_id, m.name, m.unit, m.min_stock_qty, coalesce(sum(s.quantity_current), 0) AS quantity_on_hand,
       m.shelf_life_days, m.is_active, coalesce(sum(s.quantity_current), 0) < m.min_stock_qty AS is_low
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
GROUP BY m.material_id, m.name, m.unit, m.min_stock_qty, m.shelf_life_days, m.is_active""",
    decimals="min_stock_qty quantity_on_hand",
)(listings.material_register)

query(
    "r25_products",
    "SELECT product_id, name, category, unit, price, shelf_life_days, is_active FROM {products}",
    decimals="price",
)(listings.product_register)

query(
    "r25_quality_filtered",
    """
SELECT qc.quality_check_id, qc.check_type, qc.checked_at, qc.result_code, qc.document_number, coalesce(rm.name, p.name) AS object_name
FROM {quality_checks} AS qc
LEFT JOIN {delivery_items} AS di ON di.delivery_item_id = qc.delivery_item_id
LEFT JOIN {raw_materials} AS rm ON rm.material_id = di.material_id
LEFT JOIN {production_batches} AS pb ON pb.production_batch_id = qc.production_batch_id
LEFT JOIN {products} AS p ON p.product_id = pb.product_id
WHERE qc.check_type = 'finished_product' AND qc.result_code = 'failed'""",
)(lambda t: listings.quality_register(t, "finished_product", "failed"))

query(
    "r26_document_details",
    f"""
SELECT o.order_id, o.order_number, o.customer_id, o.order_date, o.status_code, {_NAME} AS customer_name,
       i.order_item_id, p.name AS product_name, i.quantity, i.unit_price, i.line_amount
FROM {{customer_orders}} AS o
JOIN {{customers}} AS c ON c.customer_id = o.customer_id
LEFT JOIN {{order_items}} AS i ON i.order_id = o.order_id
LEFT JOIN {{products}} AS p ON p.product_id = i.product_id""",
    decimals="quantity unit_price line_amount",
)(listings.order_details)

query(
    "r26_order_shipments",
    """
SELECT o.order_id, o.order_number, s.shipment_id, s.shipment_number, s.shipped_at, s.status_code, s.delivery_address
FROM {customer_orders} AS o JOIN {shipments} AS s ON s.order_id = o.order_id""",
)(listings.order_shipments)

query(
    "r26_delivery_details",
    """
SELECT d.delivery_id, d.delivery_number, d.delivery_date, d.status_code, d.supplier_id, s.company_name,
       si.supplier_invoice_number, si.amount AS invoice_amount, si.status_code AS invoice_status,
       i.delivery_item_id, m.name AS material_name, i.quantity, i.unit_price, i.batch_number, i.expiry_date
FROM {raw_material_deliveries} AS d
JOIN {suppliers} AS s ON s.supplier_id = d.supplier_id
LEFT JOIN {supplier_invoices} AS si ON si.delivery_id = d.delivery_id
LEFT JOIN {delivery_items} AS i ON i.delivery_id = d.delivery_id
LEFT JOIN {raw_materials} AS m ON m.material_id = i.material_id""",
    decimals="invoice_amount quantity unit_price",
)(listings.delivery_details)

query(
    "r26_tech_card_details",
    """
SELECT tc.tech_card_id, tc.card_number, tc.version, tc.status_code, tc.product_id, p.name AS product_name,
       u.full_name AS approved_by_name, ri.recipe_item_id, m.name AS material_name, ri.quantity, ri.unit, ri.stage, ri.waste_percent
FROM {tech_cards} AS tc
JOIN {products} AS p ON p.product_id = tc.product_id
LEFT JOIN {users} AS u ON u.user_id = tc.approved_by_user_id
LEFT JOIN {recipe_items} AS ri ON ri.tech_card_id = tc.tech_card_id
LEFT JOIN {raw_materials} AS m ON m.material_id = ri.material_id""",
    decimals="quantity waste_percent",
)(listings.tech_card_details)

query(
    "r26_product_details",
    """
SELECT p.product_id, p.name, p.price, p.shelf_life_days, tc.tech_card_id, tc.card_number, tc.version, tc.status_code,
       tc.effective_from, tc.effective_to
FROM {products} AS p LEFT JOIN {tech_cards} AS tc ON tc.product_id = p.product_id""",
    decimals="price",
)(listings.product_details)

query(
    "r26_supplier_details",
    """
SELECT s.supplier_id, s.company_name, s.phone, sm.supplier_material_id, m.name AS material_name, sm.purchase_price,
       sm.lead_time_days, sm.is_active AS offer_active
FROM {suppliers} AS s
LEFT JOIN {supplier_materials} AS sm ON sm.supplier_id = s.supplier_id
LEFT JOIN {raw_materials} AS m ON m.material_id = sm.material_id""",
    decimals="purchase_price",
)(listings.supplier_details)

query(
    "r26_material_details",
    """
SELECT m.material_id, m.name, m.unit, m.min_stock_qty, s.stock_id, s.batch_number, s.quantity_current, s.expiry_date
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id""",
    decimals="min_stock_qty quantity_current",
)(listings.material_details)

query(
    "r26_customer_details",
    f"""
SELECT c.customer_id, {_NAME} AS customer_name, c.phone, o.order_number, o.order_date, o.status_code, o.planned_shipment_date
FROM {{customers}} AS c LEFT JOIN {{customer_orders}} AS o ON o.customer_id = c.customer_id""",
)(listings.customer_details)

query(
    "r26_invoice_headers",
    """
SELECT i.invoice_id, i.invoice_number, i.order_id, i.issue_date, i.due_date, i.paid_at, i.amount, i.status_code,
       o.order_number, o.customer_id
FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id""",
    decimals="amount",
)(listings.invoice_headers)

query(
    "r27_role_members",
    """
SELECT r.role_id, r.role_code, r.role_name, count(ur.user_id) AS assigned_users
FROM {roles} AS r LEFT JOIN {user_roles} AS ur ON ur.role_id = r.role_id GROUP BY r.role_id, r.role_code, r.role_name""",
)(listings.role_members)

query(
    "r27_users_with_roles",
    """
SELECT u.user_id, u.username, u.full_name, u.status_code,
       coalesce(string_agg(r.role_name, ', ' ORDER BY r.role_name), '') AS roles
FROM {users} AS u
LEFT JOIN {user_roles} AS ur ON ur.user_id = u.user_id
LEFT JOIN {roles} AS r ON r.role_id = ur.role_id
GROUP BY u.user_id, u.username, u.full_name, u.status_code""",
)(listings.users_with_roles)

query(
    "r28_active_users_with_role",
    """
SELECT DISTINCT u.user_id, u.full_name
FROM {users} AS u
JOIN {user_roles} AS ur ON ur.user_id = u.user_id
JOIN {roles} AS r ON r.role_id = ur.role_id
WHERE u.status_code = 'active' AND r.role_code IN ('admin', 'technologist')""",
)(lambda t: listings.active_users_with_role(t, "admin", "technologist"))

query(
    "r29_invoice_age",
    "SELECT invoice_number, issue_date, CAST(date_diff('day', issue_date, DATE '1998-01-15') AS INTEGER) AS age_days FROM {invoices}",
)(lambda t: listings.invoice_age(t, AS_OF))

query(
    "r29_delivery_due",
    "SELECT delivery_number, delivery_date, delivery_date + 7 AS planned_payment_date FROM {raw_material_deliveries}",
)(lambda t: listings.delivery_due(t))

query(
    "r29_days_to_expiry",
    "SELECT batch_number, expiry_date, CAST(date_diff('day', DATE '1998-01-15', expiry_date) AS INTEGER) AS days_to_expiry FROM {finished_goods_stock}",
)(lambda t: listings.days_to_expiry(t, AS_OF))

query(
    "r30_active_lists",
    "SELECT material_id, name FROM {raw_materials} WHERE is_active",
)(lambda t: listings.active_names(t, "raw_materials", "material_id"))

query(
    "r30_active_suppliers",
    "SELECT supplier_id, company_name FROM {suppliers} WHERE is_active",
)(lambda t: listings.active_names(t, "suppliers", "supplier_id", "company_name"))

query(
    "r30_customer_names",
    f"SELECT c.customer_id, {_NAME} AS display_name FROM {{customers}} AS c",
)(listings.customer_names)

query(
    "r30_active_card_labels",
    """
SELECT tc.tech_card_id, tc.card_number || ' / v' || CAST(tc.version AS VARCHAR) || ' / ' || p.name AS card_label
FROM {tech_cards} AS tc JOIN {products} AS p ON p.product_id = tc.product_id WHERE tc.status_code = 'active'""",
)(listings.active_card_labels)

query(
    "r30_delivery_item_labels",
    """
SELECT di.delivery_item_id, rm.name || ' / ' || coalesce(di.batch_number, 'без партии') AS display_name
FROM {delivery_items} AS di JOIN {raw_materials} AS rm ON rm.material_id = di.material_id""",
)(listings.delivery_item_labels)

query(
    "r30_batch_labels",
    """
SELECT b.production_batch_id, b.batch_number || ' / ' || p.name AS display_name
FROM {production_batches} AS b JOIN {products} AS p ON p.product_id = b.product_id""",
)(listings.batch_labels)

query(
    "r30_order_line_labels",
    """
SELECT i.order_item_id, i.product_id, p.name || ' / заказано ' || CAST(i.quantity AS VARCHAR) AS display_name
FROM {order_items} AS i JOIN {products} AS p ON p.product_id = i.product_id""",
)(listings.order_line_labels)
