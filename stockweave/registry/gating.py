"""Quality gates and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import gates
from stockweave.registry.base import AS_OF, query

_PASSED = """EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.production_batch_id = f.production_batch_id
              AND q.check_type = 'finished_product' AND q.result_code = 'passed')
  AND NOT EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.production_batch_id = f.production_batch_id
              AND q.check_type = 'finished_product' AND q.result_code = 'failed')"""

_USABLE = f"f.quantity_current > 0 AND f.expiry_date >= DATE '1998-01-15' AND {_PASSED}"

query(
    "g1_qc_passed_lots",
    """
SELECT s.* FROM {raw_material_stock} AS s
WHERE s.delivery_item_id IN (
  SELECT q.delivery_item_id FROM {quality_checks} AS q WHERE q.check_type = 'raw_material' AND q.delivery_item_id IS NOT NULL
  GROUP BY q.delivery_item_id
  HAVING count(*) FILTER (WHERE q.result_code = 'passed') > 0 AND count(*) FILTER (WHERE q.result_code = 'failed') = 0)""",
    decimals="quantity_current",
)(lambda t: gates.qc_passed_lots(t["raw_material_stock"], t["quality_checks"], "delivery_item_id", "raw_material"))

query(
    "g1_qc_passed_batches",
    f"SELECT f.finished_stock_id, f.product_id FROM {{finished_goods_stock}} AS f WHERE {_PASSED}",
)(
    lambda t: gates.qc_passed_lots(
        t["finished_goods_stock"], t["quality_checks"], "production_batch_id", "finished_product"
    ).select("finished_stock_id", "product_id")
)

query(
    "g2_available_quantity",
    f"""
SELECT p.product_id, p.name, p.category, p.unit, p.price, p.shelf_life_days, p.is_active,
       coalesce(sum(u.quantity_current), 0) AS quantity_available
FROM {{products}} AS p
LEFT JOIN (SELECT f.* FROM {{finished_goods_stock}} AS f WHERE {_USABLE}) AS u ON u.product_id = p.product_id
WHERE p.is_active
GROUP BY ALL""",
    decimals="price quantity_available",
)(lambda t: gates.available_quantity(t["products"], t["finished_goods_stock"], t["quality_checks"], AS_OF))

query(
    "g2_orderable_products",
    f"""
SELECT p.product_id, p.name, p.price, sum(f.quantity_current) AS quantity_available
FROM {{products}} AS p JOIN {{finished_goods_stock}} AS f ON f.product_id = p.product_id
WHERE p.is_active AND {_USABLE}
GROUP BY p.product_id, p.name, p.price""",
    decimals="price quantity_available",
)(lambda t: gates.orderable_products(t["products"], t["finished_goods_stock"], t["quality_checks"], AS_OF))

_UNGATED = """
SELECT p.product_id, p.name, p.price, p.unit, coalesce(sum(f.quantity_current), 0) AS quantity_available
FROM {products} AS p
LEFT JOIN {finished_goods_stock} AS f
  ON f.product_id = p.product_id AND f.quantity_current > 0 AND f.expiry_date >= DATE '1998-01-15'
WHERE p.is_active
GROUP BY p.product_id, p.name, p.price, p.unit"""

query("g3_ungated_availability", _UNGATED, decimals="price quantity_available")(
    lambda t: gates.ungated_availability(t["products"], t["finished_goods_stock"], AS_OF, k=None)
)

query("g3_client_catalogue", _UNGATED + " ORDER BY p.name, p.product_id LIMIT 10", decimals="price quantity_available")(
    lambda t: gates.ungated_availability(t["products"], t["finished_goods_stock"], AS_OF)
)

query(
    "g4_shippable_orders",
    """
SELECT o.order_id, o.order_number || ' / ' || o.status_code AS display_name FROM {customer_orders} AS o
WHERE o.status_code = 'ready'
  AND EXISTS (SELECT 1 FROM {invoices} AS i WHERE i.order_id = o.order_id AND i.status_code = 'paid')""",
)(lambda t: gates.shippable_orders(t["customer_orders"], t["invoices"]))

query(
    "g5_invoiceable_orders",
    """
SELECT o.order_id, o.order_number || ' / ' || o.status_code AS display_name FROM {customer_orders} AS o
WHERE o.status_code IN ('confirmed', 'in_production', 'ready', 'shipped', 'completed')
  AND NOT EXISTS (SELECT 1 FROM {invoices} AS i WHERE i.order_id = o.order_id
                  AND i.status_code IN ('issued', 'overdue', 'paid'))""",
)(lambda t: gates.invoiceable_orders(t["customer_orders"], t["invoices"]))

query(
    "g6_pickable_lots",
    f"""
SELECT f.finished_stock_id, f.product_id, f.batch_number, f.quantity_current, f.expiry_date,
       p.name || ' / ' || f.batch_number || ' / остаток ' || CAST(f.quantity_current AS VARCHAR)
         || ' / годен до ' || CAST(f.expiry_date AS VARCHAR) AS display_name
FROM {{finished_goods_stock}} AS f JOIN {{products}} AS p ON p.product_id = f.product_id
WHERE f.product_id IN (SELECT product_id FROM {{order_items}} WHERE order_id = 42) AND {_USABLE}""",
    decimals="quantity_current",
)(
    lambda t: gates.pickable_lots(
        42, t["finished_goods_stock"], t["quality_checks"], t["order_items"], t["products"], AS_OF
    )
)

query(
    "g6_pickable_by_order",
    f"""
SELECT w.order_id, w.product_id, w.ordered_quantity, l.lot_count, l.pickable_quantity, l.first_lot_id, l.first_expiry
FROM (SELECT order_id, product_id, sum(quantity) AS ordered_quantity FROM {{order_items}} GROUP BY order_id, product_id) AS w
JOIN (SELECT f.product_id, count(*) AS lot_count, sum(f.quantity_current) AS pickable_quantity,
             first(f.finished_stock_id ORDER BY f.expiry_date, f.finished_stock_id) AS first_lot_id,
             min(f.expiry_date) AS first_expiry
      FROM {{finished_goods_stock}} AS f WHERE {_USABLE} GROUP BY f.product_id) AS l ON l.product_id = w.product_id""",
    decimals="ordered_quantity pickable_quantity",
)(
    lambda t: gates.pickable_by_order(t["finished_goods_stock"], t["quality_checks"], t["order_items"], AS_OF)
)

_LINES = """
SELECT i.order_id, i.order_item_id, i.quantity AS ordered_quantity,
       coalesce(sum(CASE WHEN s.shipment_id IS NOT NULL THEN si.quantity ELSE 0 END), 0) AS shipped_quantity
FROM {order_items} AS i
LEFT JOIN {shipment_items} AS si ON si.order_item_id = i.order_item_id
LEFT JOIN {shipments} AS s ON s.shipment_id = si.shipment_id AND s.status_code IN ('shipped', 'delivered')
GROUP BY i.order_id, i.order_item_id, i.quantity"""

query("g7_line_coverage", _LINES, decimals="ordered_quantity shipped_quantity")(
    lambda t: gates.line_coverage(t["order_items"], t["shipment_items"], t["shipments"])
)

query(
    "g7_shipment_coverage",
    f"""
SELECT order_id, count(*) AS line_count, count(*) FILTER (WHERE shipped_quantity < ordered_quantity) AS short_lines,
       bool_and(shipped_quantity >= ordered_quantity) AS is_covered
FROM ({_LINES}) AS l GROUP BY order_id""",
)(lambda t: gates.shipment_coverage(t["order_items"], t["shipment_items"], t["shipments"]))

query(
    "g8_payment_status",
    """
SELECT o.order_id, count(i.invoice_id) AS invoice_count,
       count(*) FILTER (WHERE i.status_code = 'paid') AS paid_count,
       CASE WHEN count(i.invoice_id) = 0 THEN 'no_invoice'
            WHEN count(*) FILTER (WHERE i.status_code = 'paid') = 0 THEN 'unpaid' ELSE 'paid' END AS payment_state
FROM {customer_orders} AS o LEFT JOIN {invoices} AS i ON i.order_id = o.order_id GROUP BY o.order_id""",
)(lambda t: gates.payment_status(t["customer_orders"], t["invoices"]))

query(
    "g9_overship_check",
    """
SELECT r.request_id, r.order_item_id, r.quantity AS requested_quantity, i.quantity AS ordered_quantity,
       coalesce((SELECT sum(quantity) FROM {shipment_items} AS s WHERE s.order_item_id = r.order_item_id), 0) AS shipped_quantity,
       coalesce((SELECT sum(quantity) FROM {shipment_items} AS s WHERE s.order_item_id = r.order_item_id), 0) + r.quantity
         <= i.quantity AS fits
FROM {shipment_line_requests} AS r JOIN {order_items} AS i ON i.order_item_id = r.order_item_id""",
    decimals="requested_quantity ordered_quantity shipped_quantity",
)(lambda t: gates.overship_check(t["shipment_line_requests"], t["order_items"], t["shipment_items"]))

query(
    "g11_valid_tech_cards",
    """
SELECT b.production_batch_id, b.product_id, b.tech_card_id, CAST(b.production_date AS DATE) AS day, p.shelf_life_days,
       CASE WHEN tc.tech_card_id IS NULL THEN 'card_missing'
            WHEN tc.product_id <> b.product_id THEN 'card_of_other_product'
            WHEN tc.status_code <> 'active' THEN 'card_not_active'
            WHEN tc.effective_from > CAST(b.production_date AS DATE) THEN 'card_not_yet_effective'
            WHEN tc.effective_to < CAST(b.production_date AS DATE) THEN 'card_expired' END AS reject_reason
FROM {production_batches} AS b
LEFT JOIN {tech_cards} AS tc ON tc.tech_card_id = b.tech_card_id
LEFT JOIN {products} AS p ON p.product_id = tc.product_id""",
)(
    lambda t: gates.valid_tech_cards(
        t["production_batches"].select(
            "production_batch_id", "product_id", "tech_card_id", F.to_date("production_date").alias("day")
        ),
        t["tech_cards"],
        t["products"],
    )
)

query(
    "j13_cards_in_force",
    """
SELECT b.production_batch_id, tc.tech_card_id
FROM {production_batches} AS b
JOIN {tech_cards} AS tc ON tc.product_id = b.product_id AND tc.status_code = 'active'
 AND tc.effective_from <= CAST(b.production_date AS DATE)
 AND (tc.effective_to IS NULL OR tc.effective_to >= CAST(b.production_date AS DATE))""",
)(
    lambda t: gates.cards_in_force(
        t["production_batches"].select("production_batch_id", "product_id", F.to_date("production_date").alias("day")),
        t["tech_cards"],
    )
)

query(
    "g12_editable_recipes",
    """
SELECT tc.tech_card_id, tc.card_number, tc.status_code FROM {tech_cards} AS tc
WHERE tc.status_code = 'draft'
  AND NOT EXISTS (SELECT 1 FROM {production_batches} AS b WHERE b.tech_card_id = tc.tech_card_id)""",
)(
    lambda t: gates.editable_recipes(t["tech_cards"], t["production_batches"]).select(
        "tech_card_id", "card_number", "status_code"
    )
)
