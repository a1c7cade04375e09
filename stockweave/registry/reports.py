"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import reports
from stockweave.plans.report_page import report_page
from stockweave.registry.base import AS_OF, END, START, query

_PERIOD = "BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"


@query(
    "r1_material_stock_report",
    """
SELECT m.name AS material_name, sum(s.quantity_current) AS quantity_on_hand, m.unit
FROM {raw_material_stock} AS s JOIN {raw_materials} AS m ON m.material_id = s.material_id
GROUP BY m.name, m.unit""",
    decimals="quantity_on_hand",
)
def r1(t):
    return reports.material_stock_report(t)


@query(
    "r1_material_stock_all",
    """
SELECT m.name, coalesce(sum(s.quantity_current), 0) AS qty
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
GROUP BY m.name""",
    decimals="qty",
)
def r1_all(t):
    return reports.material_stock_all(t)


@query(
    "r2_low_stock",
    """
SELECT m.material_id, m.name, m.min_stock_qty, coalesce(sum(s.quantity_current), 0) AS quantity_on_hand, m.unit
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
GROUP BY m.material_id, m.name, m.min_stock_qty, m.unit
HAVING coalesce(sum(s.quantity_current), 0) < m.min_stock_qty""",
    decimals="min_stock_qty quantity_on_hand",
)
def r2_by_id(t):
    return reports.low_stock(t)


@query(
    "r2_low_stock_report",
    """
SELECT m.name AS material_name, m.min_stock_qty, coalesce(sum(s.quantity_current), 0) AS quantity_on_hand, m.unit
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
GROUP BY m.name, m.min_stock_qty, m.unit
HAVING coalesce(sum(s.quantity_current), 0) < m.min_stock_qty""",
    decimals="min_stock_qty quantity_on_hand",
)
def r2(t):
    return reports.low_stock_report(t)


@query(
    "r3_stock_shortage",
    """
SELECT m.material_id, m.name, m.min_stock_qty, coalesce(sum(s.quantity_current), 0) AS quantity_on_hand,
       m.min_stock_qty - coalesce(sum(s.quantity_current), 0) AS shortage_qty
FROM {raw_materials} AS m LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
GROUP BY m.material_id, m.name, m.min_stock_qty""",
    decimals="min_stock_qty quantity_on_hand shortage_qty",
)
def r3(t):
    return reports.stock_shortage(t)


@query(
    "r4_finished_stock_report",
    """
SELECT p.name AS product_name, sum(f.quantity_current) AS quantity_on_hand, p.unit
FROM {finished_goods_stock} AS f JOIN {products} AS p ON p.product_id = f.product_id
GROUP BY p.name, p.unit""",
    decimals="quantity_on_hand",
)
def r4(t):
    return reports.finished_stock_report(t)


@query(
    "r5_orders_in_period",
    f"""
SELECT o.order_number, coalesce(c.company_name, c.full_name) AS customer_name, o.order_date, o.status_code
FROM {{customer_orders}} AS o JOIN {{customers}} AS c ON c.customer_id = o.customer_id
WHERE CAST(o.order_date AS DATE) {_PERIOD}""",
)
def r5(t):
    return reports.orders_in_period(t, START, END)


@query(
    "r6_production_in_period",
    f"""
SELECT p.name AS product_name, b.batch_number, b.production_date, b.quantity_produced, b.quantity_defective, b.status_code
FROM {{production_batches}} AS b JOIN {{products}} AS p ON p.product_id = b.product_id
WHERE CAST(b.production_date AS DATE) {_PERIOD}""",
    decimals="quantity_produced quantity_defective",
)
def r6(t):
    return reports.production_in_period(t, START, END)


@query(
    "r7_sales_by_product",
    f"""
SELECT p.name AS product_name, sum(i.quantity) AS total_quantity, sum(i.line_amount) AS total_amount
FROM {{order_items}} AS i
JOIN {{customer_orders}} AS o ON o.order_id = i.order_id
JOIN {{products}} AS p ON p.product_id = i.product_id
WHERE CAST(o.order_date AS DATE) {_PERIOD}
GROUP BY p.name""",
    decimals="total_quantity total_amount",
)
def r7(t):
    return reports.sales_by_product(t, START, END)


@query(
    "r7_sales_all_time",
    """
SELECT p.name AS product_name, sum(i.quantity) AS total_quantity, sum(i.line_amount) AS total_amount
FROM {order_items} AS i JOIN {products} AS p ON p.product_id = i.product_id
GROUP BY p.name""",
    decimals="total_quantity total_amount",
)
def r7_all(t):
    return reports.sales_by_product(t)


_SUPPLIER_INVOICES = """
FROM {supplier_invoices} AS si
JOIN {suppliers} AS s ON s.supplier_id = si.supplier_id
JOIN {raw_material_deliveries} AS d ON d.delivery_id = si.delivery_id"""


@query(
    "r8_unpaid_supplier_invoices",
    f"""
SELECT si.supplier_invoice_number, s.company_name, d.delivery_number, si.issue_date, si.due_date, si.amount, si.status_code
{_SUPPLIER_INVOICES}
WHERE si.status_code IN ('issued', 'overdue') AND si.issue_date {_PERIOD}""",
    decimals="amount",
)
def r8(t):
    return reports.unpaid_supplier_invoices(t, START, END)


@query(
    "r9_paid_supplier_invoices",
    f"""
SELECT si.supplier_invoice_number, s.company_name, d.delivery_number, si.issue_date, si.paid_at, si.amount, si.status_code
{_SUPPLIER_INVOICES}
WHERE si.status_code = 'paid' AND CAST(si.paid_at AS DATE) {_PERIOD}""",
    decimals="amount",
)
def r9(t):
    return reports.paid_supplier_invoices(t, START, END)


@query(
    "r10_supplier_invoice_summary",
    f"""
SELECT coalesce(sum(CASE WHEN status_code IN ('issued', 'overdue') THEN amount ELSE 0 END), 0) AS outstanding_amount,
       coalesce(sum(CASE WHEN status_code = 'paid' AND CAST(paid_at AS DATE) {_PERIOD}
                         THEN amount ELSE 0 END), 0) AS paid_amount
FROM {{supplier_invoices}}""",
    decimals="outstanding_amount paid_amount",
)
def r10(t):
    return reports.supplier_invoice_summary(t, START, END)


_CHECKED_OBJECT = """
FROM {quality_checks} AS qc
LEFT JOIN {delivery_items} AS di ON di.delivery_item_id = qc.delivery_item_id
LEFT JOIN {raw_materials} AS rm ON rm.material_id = di.material_id
LEFT JOIN {production_batches} AS pb ON pb.production_batch_id = qc.production_batch_id
LEFT JOIN {products} AS p ON p.product_id = pb.product_id"""


@query(
    "r11_quality_in_period",
    f"""
SELECT qc.check_type, qc.checked_at, qc.result_code, qc.document_number, coalesce(rm.name, p.name) AS object_name
{_CHECKED_OBJECT}
WHERE CAST(qc.checked_at AS DATE) {_PERIOD}""",
)
def r11(t):
    return reports.quality_in_period(t, START, END)


@query(
    "r12_orders_by_month",
    """
SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS order_month,
       CAST(extract(year FROM order_date) AS INTEGER) AS order_year, count(*) AS orders_count
FROM {customer_orders} GROUP BY 1, 2""",
)
def r12(t):
    df = reports.orders_by_month(t)
    return df.withColumn("order_month", F.col("order_month").cast("timestamp_ntz"))


@query(
    "r13_orders_per_customer",
    "SELECT customer_id, count(*) AS orders_count FROM {customer_orders} GROUP BY customer_id",
)
def r13(t):
    return reports.orders_per_customer(t)


@query(
    "r13_customer_activity",
    """
SELECT coalesce(c.company_name, c.full_name) AS customer_name, count(o.order_id) AS orders_count,
       max(o.order_date) AS last_order_date
FROM {customers} AS c LEFT JOIN {customer_orders} AS o ON o.customer_id = c.customer_id
GROUP BY 1""",
)
def r13_named(t):
    return reports.customer_activity(t)


@query(
    "r14_category_price_stats",
    """
SELECT category, count(*) AS products_count, round(sum(price)::DOUBLE / count(price), 4) AS average_price
FROM {products} GROUP BY category""",
)
def r14(t):
    return reports.category_price_stats(t)


@query(
    "r15_order_totals",
    """
SELECT o.order_id, sum(i.line_amount) AS order_amount
FROM {customer_orders} AS o JOIN {order_items} AS i ON i.order_id = o.order_id GROUP BY o.order_id""",
    decimals="order_amount",
)
def r15(t):
    return reports.order_totals(t)


@query(
    "r16_production_stats",
    """
SELECT round(sum(quantity_defective)::DOUBLE / count(quantity_defective), 4) AS avg_defective_qty,
       min(production_date) AS first_production_at, max(production_date) AS last_production_at
FROM {production_batches}""",
)
def r16(t):
    return reports.production_stats(t)


@query(
    "r19_kpi_dashboard",
    """
SELECT (SELECT count(*) FROM {customers}) AS customer_count,
       (SELECT count(*) FROM {customer_orders}) AS order_count,
       (SELECT count(*) FROM {products}) AS product_count,
       (SELECT count(*) FROM {raw_materials}) AS material_count,
       (SELECT count(*) FROM {customer_orders}
        WHERE status_code IN ('confirmed', 'in_production', 'ready', 'shipped')) AS active_order_count,
       (SELECT count(*) FROM (SELECT m.material_id FROM {raw_materials} AS m
                              LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
                              GROUP BY m.material_id, m.min_stock_qty
                              HAVING coalesce(sum(s.quantity_current), 0) < m.min_stock_qty) AS l) AS low_stock_material_count""",
)
def r19(t):
    return reports.kpi_dashboard(t)


@query(
    "r20_customer_dashboard",
    """
SELECT c.customer_id,
       (SELECT count(*) FROM {customer_orders} AS o WHERE o.customer_id = c.customer_id) AS order_count,
       (SELECT count(*) FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id
        WHERE o.customer_id = c.customer_id) AS invoice_count,
       (SELECT count(*) FROM {shipments} AS s JOIN {customer_orders} AS o ON o.order_id = s.order_id
        WHERE o.customer_id = c.customer_id) AS shipment_count,
       (SELECT count(*) FROM {products} WHERE is_active) AS product_count
FROM {customers} AS c""",
)
def r20(t):
    return reports.customer_dashboard(t)


@query(
    "r21_recent_k",
    """
SELECT o.order_id, o.order_number, o.status_code, o.order_date, coalesce(c.company_name, c.full_name) AS customer_name
FROM {customer_orders} AS o JOIN {customers} AS c ON c.customer_id = o.customer_id
ORDER BY o.order_date DESC, o.order_id DESC LIMIT 5""",
)
def r21(t):
    return reports.recent_orders(t)


@query(
    "r21_recent_audit",
    """
SELECT a.audit_id, a.changed_at, a.action_type, a.table_name, a.record_id, coalesce(u.username, 'system') AS username
FROM {audit_log} AS a LEFT JOIN {users} AS u ON u.user_id = a.user_id
ORDER BY a.changed_at DESC, a.audit_id DESC LIMIT 5""",
)
def r21_audit(t):
    return reports.recent_audit(t)


@query(
    "r21_recent_orders_per_customer",
    """
SELECT customer_id, order_id, order_number, status_code, order_date,
       CAST(row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) AS INTEGER) AS place
FROM {customer_orders} QUALIFY place <= 5""",
)
def r21_orders(t):
    return reports.recent_orders_per_customer(t)


@query(
    "r21_recent_invoices_per_customer",
    """
SELECT o.customer_id, i.invoice_id, i.invoice_number, i.issue_date, i.amount, i.status_code,
       CAST(row_number() OVER (PARTITION BY o.customer_id ORDER BY i.issue_date DESC, i.invoice_id DESC) AS INTEGER) AS place
FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id QUALIFY place <= 5""",
    decimals="amount",
)
def r21_invoices(t):
    return reports.recent_invoices_per_customer(t)


@query(
    "r21_recent_shipments_per_customer",
    """
SELECT o.customer_id, s.shipment_id, s.shipment_number, s.shipped_at, s.status_code, s.delivery_address,
       CAST(row_number() OVER (PARTITION BY o.customer_id ORDER BY s.shipped_at DESC NULLS LAST, s.shipment_id DESC)
            AS INTEGER) AS place
FROM {shipments} AS s JOIN {customer_orders} AS o ON o.order_id = s.order_id QUALIFY place <= 5""",
)
def r21_shipments(t):
    return reports.recent_shipments_per_customer(t)


@query(
    "r22_shipment_report",
    """
SELECT s.shipment_id, s.shipment_number, s.shipped_at, s.status_code, s.delivery_address, s.waybill_number, s.note,
       o.order_number, coalesce(c.company_name, c.full_name) AS customer_name, u.full_name AS employee_name,
       (SELECT count(*) FROM {shipment_items} AS i WHERE i.shipment_id = s.shipment_id) AS line_count,
       coalesce((SELECT sum(quantity) FROM {shipment_items} AS i WHERE i.shipment_id = s.shipment_id), 0) AS total_quantity
FROM {shipments} AS s
JOIN {customer_orders} AS o ON o.order_id = s.order_id
JOIN {customers} AS c ON c.customer_id = o.customer_id
LEFT JOIN {users} AS u ON u.user_id = s.created_by_user_id""",
    decimals="total_quantity",
)
def r22(t):
    return reports.shipment_report(t)


@query(
    "r22_shipment_report_lines",
    """
SELECT i.shipment_id, i.shipment_item_id, p.name AS product_name, i.order_item_id, f.batch_number, i.quantity, p.unit,
       f.expiry_date
FROM {shipment_items} AS i
JOIN {products} AS p ON p.product_id = i.product_id
LEFT JOIN {finished_goods_stock} AS f ON f.finished_stock_id = i.finished_stock_id""",
    decimals="quantity",
)
def r22_lines(t):
    return reports.shipment_report_lines(t)


@query(
    "r23_lot_register",
    """
SELECT s.stock_id, m.name AS material_name, s.batch_number, s.quantity_current, m.unit, s.expiry_date, s.updated_at,
       CASE WHEN s.expiry_date < DATE '1998-01-15' THEN 'expired'
            WHEN s.expiry_date <= DATE '1998-01-22' THEN 'expiring' ELSE 'ok' END AS expiry_class
FROM {raw_material_stock} AS s JOIN {raw_materials} AS m ON m.material_id = s.material_id""",
    decimals="quantity_current",
)
def r23(t):
    return reports.material_lot_register(t, AS_OF)


@query(
    "r23_finished_lot_register",
    """
SELECT f.finished_stock_id, p.name AS product_name, f.batch_number, f.quantity_current, p.unit, f.production_date,
       f.expiry_date, f.expiry_date < DATE '1998-01-15' AS is_expired
FROM {finished_goods_stock} AS f JOIN {products} AS p ON p.product_id = f.product_id""",
    decimals="quantity_current",
)
def r23_finished(t):
    return reports.finished_lot_register(t, AS_OF)


@query(
    "report_page_sections",
    f"""
SELECT 'low_stock' AS section, (SELECT count(*) FROM (SELECT 1 FROM {{raw_materials}} AS m
         LEFT JOIN {{raw_material_stock}} AS s ON s.material_id = m.material_id
         GROUP BY m.name, m.min_stock_qty, m.unit
         HAVING coalesce(sum(s.quantity_current), 0) < m.min_stock_qty) AS x) AS row_count
UNION ALL SELECT 'material_stock', (SELECT count(DISTINCT material_id) FROM {{raw_material_stock}})
UNION ALL SELECT 'finished_stock', (SELECT count(DISTINCT product_id) FROM {{finished_goods_stock}})
UNION ALL SELECT 'orders', (SELECT count(*) FROM {{customer_orders}} WHERE CAST(order_date AS DATE) {_PERIOD})
UNION ALL SELECT 'production', (SELECT count(*) FROM {{production_batches}} WHERE CAST(production_date AS DATE) {_PERIOD})
UNION ALL SELECT 'sales', (SELECT count(DISTINCT i.product_id) FROM {{order_items}} AS i
         JOIN {{customer_orders}} AS o ON o.order_id = i.order_id WHERE CAST(o.order_date AS DATE) {_PERIOD})
UNION ALL SELECT 'unpaid_supplier_invoices', (SELECT count(*) FROM {{supplier_invoices}}
         WHERE status_code IN ('issued', 'overdue') AND issue_date {_PERIOD})
UNION ALL SELECT 'paid_supplier_invoices', (SELECT count(*) FROM {{supplier_invoices}}
         WHERE status_code = 'paid' AND CAST(paid_at AS DATE) {_PERIOD})
UNION ALL SELECT 'supplier_invoice_summary', 1
UNION ALL SELECT 'quality', (SELECT count(*) FROM {{quality_checks}} WHERE CAST(checked_at AS DATE) {_PERIOD})""",
)
def all_sections(t):
    sections = report_page(t, "admin", AS_OF, START, END)
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("section"), "row_count")
        for name, df in sections.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result
