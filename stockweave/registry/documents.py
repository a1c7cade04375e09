"""Movements, documents, keyed writes and status transitions."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from stockweave.operators import fefo, movements, transitions, writes
from stockweave.plans import stored_waves, stored_writes
from stockweave.plans.delivery_wave import run_delivery_wave
from stockweave.plans.production_wave import judge_production_requests, run_production_wave
from stockweave.registry.base import AS_OF, NOW, query
from stockweave.schemas import layout
from stockweave.session import shared_folder
from stockweave.sources import stored, stored_set


def _open_batches(t):
    return t["production_batches"].filter(F.col("status_code").isin("planned", "in_progress"))


def _admission_sql(needs: str) -> str:
    """CTEs that decide requests in rounds: ``needs`` gives request_id, resource_id, day, q, e, cap.

    ``decided`` has every need with status yes or no.
    """
    return f"""
needs AS ({needs}),
rounds AS (
  SELECT 0 AS round, request_id, resource_id, day, CAST(q AS DECIMAL(38,10)) AS q, CAST(e AS DECIMAL(38,10)) AS e,
         CAST(cap AS DECIMAL(38,10)) AS cap, 'open' AS status FROM needs
  UNION ALL
  SELECT round + 1, request_id, resource_id, day, q, e, cap,
         CASE WHEN status <> 'open' THEN status WHEN fits THEN 'yes' WHEN misses THEN 'no' ELSE 'open' END
  FROM (
    SELECT *, bool_and(high <= cap) OVER (PARTITION BY request_id) AS fits,
           bool_or(low > cap) OVER (PARTITION BY request_id) AS misses
    FROM (
      SELECT *, c_high + max(e - c_high + q_high) OVER w AS high, c_low + max(e - c_low + q_low) OVER w + q - q_low AS low
      FROM (
        SELECT *, sum(q_high) OVER w AS c_high, sum(q_low) OVER w AS c_low
        FROM (SELECT *, CASE WHEN status = 'no' THEN 0 ELSE q END AS q_high,
                     CASE WHEN status = 'yes' THEN q ELSE 0 END AS q_low,
                     count(*) FILTER (WHERE status = 'open') OVER () AS n_open FROM rounds) AS a
        WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)) AS b
      WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)) AS c) AS d
  WHERE n_open > 0),
decided AS (SELECT * FROM rounds WHERE round = (SELECT max(round) FROM rounds))"""


# -- materials ------------------------------------------------------------------

_REQUIREMENT = """
SELECT b.production_batch_id, CAST(b.production_date AS DATE) AS day, r.recipe_item_id, r.material_id,
       CAST(b.quantity_produced * r.quantity * CAST(1 + CAST(coalesce(r.waste_percent, 0) AS DECIMAL(7,4)) / 100 AS DECIMAL(9,4))
            AS DECIMAL(28,10)) AS required_qty
FROM {production_batches} AS b JOIN {recipe_items} AS r ON r.tech_card_id = b.tech_card_id"""

query("m2_recipe_requirement", _REQUIREMENT, decimals="required_qty")(
    lambda t: fefo.recipe_requirement(t["production_batches"], t["recipe_items"])
)

_DEMAND = f"""
SELECT x.production_batch_id, x.day, x.material_id, sum(x.required_qty) AS quantity
FROM ({_REQUIREMENT} WHERE b.status_code IN ('planned', 'in_progress')) AS x
GROUP BY x.production_batch_id, x.day, x.material_id"""

_GATED = """
SELECT s.stock_id, s.material_id, s.expiry_date, s.quantity_current AS ungated,
       CASE WHEN EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.delivery_item_id = s.delivery_item_id
                         AND q.check_type = 'raw_material' AND q.result_code = 'passed')
             AND NOT EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.delivery_item_id = s.delivery_item_id
                             AND q.check_type = 'raw_material' AND q.result_code = 'failed')
            THEN s.quantity_current ELSE 0 END AS gated
FROM {raw_material_stock} AS s WHERE s.quantity_current > 0"""

query(
    "m3_production_feasibility",
    f"""
WITH demand AS ({_DEMAND}), lots AS ({_GATED}),
judged AS (
  SELECT d.production_batch_id, d.material_id, d.quantity AS required_qty,
         coalesce(sum(l.gated), 0) AS available_qty, coalesce(sum(l.ungated), 0) AS any_qty
  FROM demand AS d LEFT JOIN lots AS l ON l.material_id = d.material_id AND l.expiry_date >= d.day
  GROUP BY d.production_batch_id, d.material_id, d.quantity)
SELECT production_batch_id, material_id, required_qty, available_qty,
       CASE WHEN any_qty > 0 AND available_qty = 0 THEN 'not_quality_approved'
            WHEN available_qty < required_qty THEN 'insufficient' ELSE 'ok' END AS verdict
FROM judged
UNION ALL
SELECT b.production_batch_id, NULL, NULL, NULL, 'no_recipe' FROM {{production_batches}} AS b
WHERE b.status_code IN ('planned', 'in_progress')
  AND NOT EXISTS (SELECT 1 FROM {{recipe_items}} AS r WHERE r.tech_card_id = b.tech_card_id)""",
    decimals="required_qty available_qty",
)(
    lambda t: fefo.production_feasibility(
        _open_batches(t), t["recipe_items"], t["raw_material_stock"], t["quality_checks"]
    )
)

_FEFO = f"""
WITH RECURSIVE demand AS ({_DEMAND}), lots AS ({_GATED}),
supply AS (SELECT material_id, sum(gated) AS cap FROM lots GROUP BY material_id),
skipped AS (
  SELECT d.material_id, d.day, sum(l.gated) AS e FROM (SELECT DISTINCT material_id, day FROM demand) AS d
  JOIN lots AS l ON l.material_id = d.material_id AND l.expiry_date < d.day GROUP BY d.material_id, d.day),
{_admission_sql('''
  SELECT d.production_batch_id AS request_id, d.material_id AS resource_id, d.day, d.quantity AS q,
         coalesce(k.e, 0) AS e, coalesce(s.cap, 0) AS cap
  FROM demand AS d LEFT JOIN supply AS s ON s.material_id = d.material_id
  LEFT JOIN skipped AS k ON k.material_id = d.material_id AND k.day = d.day WHERE d.quantity > 0''')},
taken AS (
  SELECT *, c + max(e - c + q) OVER w AS end_at FROM (
    SELECT *, sum(q) OVER w AS c FROM decided WHERE status = 'yes'
    WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)) AS y
  WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)),
shelves AS (
  SELECT *, CAST(sum(gated) OVER (PARTITION BY material_id ORDER BY expiry_date, stock_id) AS DECIMAL(38,10)) AS end_at
  FROM lots WHERE gated > 0)"""

query(
    "m1_fefo_allocate",
    f"""{_FEFO}
SELECT t.request_id AS production_batch_id, t.resource_id AS material_id, s.stock_id,
       least(t.end_at, s.end_at) - greatest(t.end_at - t.q, s.end_at - s.gated) AS take_qty
FROM taken AS t JOIN shelves AS s ON s.material_id = t.resource_id
 AND s.end_at > t.end_at - t.q AND s.end_at - s.gated < t.end_at""",
    decimals="take_qty",
)(
    lambda t: fefo.fefo_allocate(
        fefo.batch_demand(fefo.recipe_requirement(_open_batches(t), t["recipe_items"])),
        fefo.gated_lots(t["raw_material_stock"], t["quality_checks"]),
    )[0]
)

query(
    "m1_fefo_rejects",
    f"""{_FEFO}
SELECT DISTINCT request_id AS production_batch_id FROM decided WHERE status = 'no'""",
)(
    lambda t: fefo.fefo_allocate(
        fefo.batch_demand(fefo.recipe_requirement(_open_batches(t), t["recipe_items"])),
        fefo.gated_lots(t["raw_material_stock"], t["quality_checks"]),
    )[1]
)


def _lot_requests(t):
    return t["shipment_line_requests"].select("finished_stock_id", F.col("quantity").alias("take_qty"))


_ASKED = """
FROM {finished_goods_stock} AS f
LEFT JOIN (SELECT finished_stock_id, sum(quantity) AS take_qty FROM {shipment_line_requests} GROUP BY finished_stock_id) AS a
       ON a.finished_stock_id = f.finished_stock_id"""

query(
    "m4_apply_consumption",
    f"""
SELECT f.finished_stock_id, f.product_id,
       CASE WHEN f.quantity_current >= a.take_qty THEN f.quantity_current - a.take_qty ELSE f.quantity_current END AS quantity_current,
       CASE WHEN f.quantity_current >= a.take_qty THEN TIMESTAMP '1998-01-15 12:00:00' ELSE f.updated_at END AS updated_at
{_ASKED}""",
    decimals="quantity_current",
)(
    lambda t: movements.apply_consumption(t["finished_goods_stock"], _lot_requests(t), "finished_stock_id", NOW)[0].select(
        "finished_stock_id", "product_id", "quantity_current", F.col("updated_at").cast("timestamp_ntz").alias("updated_at")
    )
)

query(
    "m4_consumption_rejects",
    f"SELECT f.finished_stock_id, f.quantity_current, a.take_qty {_ASKED} WHERE f.quantity_current < a.take_qty",
    decimals="quantity_current take_qty",
)(lambda t: movements.apply_consumption(t["finished_goods_stock"], _lot_requests(t), "finished_stock_id", NOW)[1])

_FINISHING = "b.status_code IN ('in_progress', 'completed')"


def _finishing(t):
    return t["production_batches"].filter(F.col("status_code").isin("in_progress", "completed"))


query(
    "m5_finalize_batches",
    f"""
SELECT b.product_id, b.production_batch_id, b.batch_number, b.quantity_produced - b.quantity_defective AS quantity_current,
       CAST(b.production_date AS DATE) AS production_date, CAST(b.production_date AS DATE) + p.shelf_life_days AS expiry_date
FROM {{production_batches}} AS b JOIN {{products}} AS p ON p.product_id = b.product_id
WHERE {_FINISHING} AND b.quantity_produced > b.quantity_defective
  AND NOT EXISTS (SELECT 1 FROM {{finished_goods_stock}} AS f WHERE f.production_batch_id = b.production_batch_id)""",
    decimals="quantity_current",
)(lambda t: movements.finalize_batches(_finishing(t), t["finished_goods_stock"], t["products"])[0])

query(
    "m5_finalize_rejects",
    f"""
SELECT b.production_batch_id, 'already_stocked' AS reject_reason FROM {{production_batches}} AS b
WHERE {_FINISHING} AND EXISTS (SELECT 1 FROM {{finished_goods_stock}} AS f WHERE f.production_batch_id = b.production_batch_id)""",
)(lambda t: movements.finalize_batches(_finishing(t), t["finished_goods_stock"], t["products"])[1])

query(
    "m6_delivery_to_stock",
    """
SELECT i.material_id, i.delivery_item_id, i.batch_number, i.quantity AS quantity_current, i.expiry_date
FROM {delivery_items} AS i
JOIN {raw_material_deliveries} AS d ON d.delivery_id = i.delivery_id
LEFT JOIN {raw_material_stock} AS s ON s.delivery_item_id = i.delivery_item_id
WHERE d.status_code IN ('received', 'accepted') AND s.stock_id IS NULL""",
    decimals="quantity_current",
)(
    lambda t: movements.delivery_to_stock(t["raw_material_deliveries"], t["delivery_items"], t["raw_material_stock"])[0]
)

query(
    "m6_delivery_rejects",
    """
SELECT d.delivery_id, CASE WHEN d.status_code NOT IN ('received', 'accepted') THEN 'status_not_stockable' ELSE 'no_items' END
       AS reject_reason
FROM {raw_material_deliveries} AS d
WHERE d.status_code NOT IN ('received', 'accepted')
   OR NOT EXISTS (SELECT 1 FROM {delivery_items} AS i WHERE i.delivery_id = d.delivery_id)""",
)(
    lambda t: movements.delivery_to_stock(t["raw_material_deliveries"], t["delivery_items"], t["raw_material_stock"])[1]
)

query(
    "m7_delivery_totals",
    """
SELECT d.delivery_id, d.delivery_number, d.status_code,
       round(coalesce((SELECT sum(i.quantity * i.unit_price) FROM {delivery_items} AS i
                       WHERE i.delivery_id = d.delivery_id), 0), 2) AS total_amount
FROM {raw_material_deliveries} AS d""",
    decimals="total_amount",
)(
    lambda t: movements.delivery_totals(t["raw_material_deliveries"], t["delivery_items"]).select(
        "delivery_id", "delivery_number", "status_code", "total_amount"
    )
)

query(
    "m8_price_delivery_lines",
    """
SELECT r.request_id, r.delivery_id, r.material_id, r.quantity, p.purchase_price AS unit_price, r.batch_number, r.expiry_date,
       CASE WHEN d.delivery_id IS NULL THEN 'delivery_missing'
            WHEN d.status_code <> 'planned' THEN 'delivery_closed'
            WHEN r.quantity <= 0 THEN 'quantity_not_positive'
            WHEN r.expiry_date <= d.delivery_date THEN 'expiry_before_delivery'
            WHEN p.supplier_id IS NULL THEN 'material_not_assigned'
            WHEN p.purchase_price IS NULL THEN 'price_missing' END AS reject_reason
FROM {delivery_line_requests} AS r
LEFT JOIN {raw_material_deliveries} AS d ON d.delivery_id = r.delivery_id
LEFT JOIN {supplier_materials} AS p ON p.supplier_id = d.supplier_id AND p.material_id = r.material_id AND p.is_active""",
    decimals="quantity unit_price",
)(
    lambda t: movements.price_delivery_lines(
        t["delivery_line_requests"], t["raw_material_deliveries"], t["supplier_materials"]
    )
)

_NUMBER = """CASE WHEN {0} < 10000 THEN lpad(CAST({0} AS VARCHAR), 4, '0') ELSE CAST({0} AS VARCHAR) END"""

query(
    "m9_create_supplier_invoices",
    f"""
WITH fresh AS (
  SELECT d.delivery_id, d.supplier_id, d.document_ref, d.delivery_number, sum(i.quantity * i.unit_price) AS amount,
         (SELECT max(supplier_invoice_id) FROM {{supplier_invoices}}) + row_number() OVER (ORDER BY d.delivery_id) AS new_id
  FROM {{raw_material_deliveries}} AS d JOIN {{delivery_items}} AS i ON i.delivery_id = d.delivery_id
  WHERE d.status_code = 'accepted'
    AND NOT EXISTS (SELECT 1 FROM {{supplier_invoices}} AS s WHERE s.delivery_id = d.delivery_id)
  GROUP BY d.delivery_id, d.supplier_id, d.document_ref, d.delivery_number
  HAVING sum(i.quantity * i.unit_price) > 0)
SELECT CAST(new_id AS BIGINT) AS supplier_invoice_id, 'SINV-WEB-' || {_NUMBER.format('new_id')} AS supplier_invoice_number,
       delivery_id, supplier_id, DATE '1998-01-15' AS issue_date, DATE '1998-01-22' AS due_date, round(amount, 2) AS amount,
       'issued' AS status_code, nullif(trim(document_ref), '') AS document_ref,
       'Счёт создан автоматически по поставке ' || delivery_number || '.' AS note
FROM fresh""",
    decimals="amount",
)(
    lambda t: movements.create_supplier_invoices(
        t["raw_material_deliveries"], t["delivery_items"], t["supplier_invoices"], AS_OF
    )[0]
)

query(
    "m9_supplier_invoice_rejects",
    """
SELECT d.delivery_id,
       CASE WHEN d.status_code IN ('rejected', 'cancelled') THEN 'delivery_refused'
            WHEN d.status_code <> 'accepted' THEN 'delivery_not_accepted' ELSE 'no_items' END AS reject_reason
FROM {raw_material_deliveries} AS d
LEFT JOIN (SELECT delivery_id, sum(quantity * unit_price) AS amount FROM {delivery_items} GROUP BY delivery_id) AS i
       ON i.delivery_id = d.delivery_id
WHERE NOT EXISTS (SELECT 1 FROM {supplier_invoices} AS s WHERE s.delivery_id = d.delivery_id)
  AND (d.status_code <> 'accepted' OR coalesce(i.amount, 0) <= 0)""",
)(
    lambda t: movements.create_supplier_invoices(
        t["raw_material_deliveries"], t["delivery_items"], t["supplier_invoices"], AS_OF
    )[1]
)

query(
    "m10_create_customer_invoices",
    f"""
WITH fresh AS (
  SELECT o.order_id, sum(i.line_amount) AS amount,
         (SELECT max(invoice_id) FROM {{invoices}}) + row_number() OVER (ORDER BY o.order_id) AS new_id
  FROM {{customer_orders}} AS o JOIN {{order_items}} AS i ON i.order_id = o.order_id
  WHERE o.status_code IN ('confirmed', 'in_production', 'ready', 'shipped', 'completed')
    AND NOT EXISTS (SELECT 1 FROM {{invoices}} AS v WHERE v.order_id = o.order_id
                    AND v.status_code IN ('issued', 'overdue', 'paid'))
  GROUP BY o.order_id HAVING sum(i.line_amount) > 0)
SELECT CAST(new_id AS BIGINT) AS invoice_id, 'INV-WEB-' || {_NUMBER.format('new_id')} AS invoice_number, order_id,
       DATE '1998-01-15' AS issue_date, DATE '1998-02-01' AS due_date, amount, 'issued' AS status_code
FROM fresh""",
    decimals="amount",
)(
    lambda t: movements.create_customer_invoices(
        t["customer_orders"], t["order_items"], t["invoices"], AS_OF, date(1998, 2, 1)
    )[0]
)

query(
    "m10_customer_invoice_rejects",
    """
SELECT o.order_id,
       CASE WHEN o.status_code IN ('draft', 'cancelled') THEN 'order_not_invoiceable'
            WHEN i.n IS NULL THEN 'no_items' WHEN i.amount <= 0 THEN 'amount_not_positive' ELSE 'already_invoiced' END AS reject_reason
FROM {customer_orders} AS o
LEFT JOIN (SELECT order_id, count(*) AS n, sum(line_amount) AS amount FROM {order_items} GROUP BY order_id) AS i
       ON i.order_id = o.order_id
WHERE o.status_code IN ('draft', 'cancelled') OR i.n IS NULL OR i.amount <= 0
   OR EXISTS (SELECT 1 FROM {invoices} AS v WHERE v.order_id = o.order_id AND v.status_code IN ('issued', 'overdue', 'paid'))""",
)(
    lambda t: movements.create_customer_invoices(
        t["customer_orders"], t["order_items"], t["invoices"], AS_OF, date(1998, 2, 1)
    )[1]
)

_PAYMENT = """(SELECT order_id, count(*) AS n, count(*) FILTER (WHERE status_code = 'paid') AS paid FROM {invoices} GROUP BY order_id)"""

_SHIPMENT_REASON = f"""
SELECT r.order_id, r.shipped_at, r.delivery_address,
       CASE WHEN o.status_code <> 'ready' THEN 'order_not_ready'
            WHEN coalesce(p.n, 0) = 0 THEN 'no_invoice' WHEN p.paid = 0 THEN 'invoice_not_paid'
            WHEN CAST(r.shipped_at AS DATE) < CAST(o.order_date AS DATE) THEN 'shipped_before_order' END AS reject_reason
FROM {{shipment_requests}} AS r
JOIN {{customer_orders}} AS o ON o.order_id = r.order_id
LEFT JOIN {_PAYMENT} AS p ON p.order_id = r.order_id"""


def _created_shipments(t):
    return movements.create_shipments(t["shipment_requests"], t["customer_orders"], t["invoices"], t["shipments"])


query(
    "m11_create_shipments",
    f"""
WITH fresh AS (
  SELECT *, (SELECT max(shipment_id) FROM {{shipments}}) + row_number() OVER (ORDER BY order_id) AS new_id
  FROM ({_SHIPMENT_REASON}) AS j WHERE reject_reason IS NULL)
SELECT CAST(new_id AS BIGINT) AS shipment_id, 'SHP-WEB-' || {_NUMBER.format('new_id')} AS shipment_number, order_id, shipped_at,
       'planned' AS status_code, delivery_address
FROM fresh""",
)(lambda t: _created_shipments(t)[0])

query(
    "m11_shipment_rejects",
    f"SELECT order_id, reject_reason FROM ({_SHIPMENT_REASON}) AS j WHERE reject_reason IS NOT NULL",
)(lambda t: _created_shipments(t)[1])

_SHIP_JUDGED = f"""
SELECT r.request_id, r.shipment_id, r.order_item_id, i.product_id, r.finished_stock_id, r.quantity,
       f.quantity_current AS lot_quantity, i.quantity - coalesce(z.shipped, 0) AS line_remaining,
       CASE WHEN s.shipment_id IS NULL THEN 'shipment_missing'
            WHEN s.status_code <> 'planned' THEN 'shipment_closed'
            WHEN r.quantity <= 0 THEN 'quantity_not_positive'
            WHEN coalesce(p.n, 0) = 0 THEN 'no_invoice' WHEN p.paid = 0 THEN 'invoice_not_paid'
            WHEN i.order_id IS NULL OR i.order_id <> s.order_id THEN 'line_of_other_order'
            WHEN f.finished_stock_id IS NULL THEN 'lot_missing'
            WHEN f.product_id <> i.product_id THEN 'lot_of_other_product'
            WHEN f.expiry_date < DATE '1995-06-01' THEN 'lot_expired'
            WHEN f.quantity_current < r.quantity THEN 'lot_too_small'
            WHEN coalesce(c.ok, 0) = 0 OR c.bad > 0 THEN 'lot_not_approved'
            WHEN coalesce(z.shipped, 0) + r.quantity > i.quantity THEN 'exceeds_order' END AS reject_reason
FROM {{shipment_line_requests}} AS r
LEFT JOIN {{shipments}} AS s ON s.shipment_id = r.shipment_id
LEFT JOIN {_PAYMENT} AS p ON p.order_id = s.order_id
LEFT JOIN {{order_items}} AS i ON i.order_item_id = r.order_item_id
LEFT JOIN {{finished_goods_stock}} AS f ON f.finished_stock_id = r.finished_stock_id
LEFT JOIN (SELECT production_batch_id, count(*) FILTER (WHERE result_code = 'passed') AS ok,
                  count(*) FILTER (WHERE result_code = 'failed') AS bad
           FROM {{quality_checks}} WHERE check_type = 'finished_product' GROUP BY production_batch_id) AS c
       ON c.production_batch_id = f.production_batch_id
LEFT JOIN (SELECT order_item_id, sum(quantity) AS shipped FROM {{shipment_items}} GROUP BY order_item_id) AS z
       ON z.order_item_id = r.order_item_id"""

#: Payments of planned shipments, so that the later guards are reached too.
_PAID_PLANNED = """
SELECT order_id, order_id AS invoice_id, 'paid' AS status_code FROM {shipments}"""


def _ship_judged(t, as_of=date(1995, 6, 1), in_steps=False):
    return movements.judge_ship_lines(
        t["shipment_line_requests"],
        t["shipments"],
        t["invoices"],
        t["customer_orders"],
        t["order_items"],
        t["finished_goods_stock"],
        t["quality_checks"],
        t["shipment_items"],
        as_of,
        in_steps,
    )


query("m12_judge_ship_lines", _SHIP_JUDGED, decimals="quantity lot_quantity line_remaining")(
    lambda t: _ship_judged(t, in_steps=True)
)


def _with_payments(t):
    """The tables with every invoice paid, as after a payment run."""
    return t.replaced(invoices=t["invoices"].withColumn("status_code", F.lit("paid")))


_PAID_JUDGED = _SHIP_JUDGED.replace("WHERE status_code = 'paid'", "WHERE TRUE")

_SHIP_ADMISSION = f"""
WITH RECURSIVE judged AS ({_PAID_JUDGED}),
{_admission_sql('''
  SELECT request_id, 'lot:' || CAST(finished_stock_id AS VARCHAR) AS resource_id, 0 AS day, quantity AS q, 0 AS e, lot_quantity AS cap
  FROM judged WHERE reject_reason IS NULL
  UNION ALL SELECT request_id, 'line:' || order_item_id, 0, quantity, 0, line_remaining FROM judged WHERE reject_reason IS NULL''')}"""

query(
    "m12_ship_lines",
    f"""{_SHIP_ADMISSION}
SELECT request_id, shipment_id, order_item_id, product_id, finished_stock_id, quantity FROM judged
WHERE request_id IN (SELECT request_id FROM decided WHERE status = 'yes')""",
    decimals="quantity",
)(lambda t: movements.ship_lines(_ship_judged(_with_payments(t), in_steps=True))[0])

query(
    "m12_ship_rejects",
    f"""{_SHIP_ADMISSION}
SELECT request_id, coalesce(reject_reason, 'taken_by_earlier_request') AS reject_reason FROM judged
WHERE reject_reason IS NOT NULL OR request_id IN (SELECT request_id FROM decided WHERE status = 'no')""",
)(lambda t: movements.ship_lines(_ship_judged(_with_payments(t), in_steps=True))[1])

query(
    "m13_number_documents",
    f"""
WITH fresh AS (
  SELECT order_id AS source_id, (SELECT max(order_id) FROM {{customer_orders}}) + row_number() OVER (ORDER BY order_id) AS new_id
  FROM {{customer_orders}} WHERE status_code = 'draft')
SELECT source_id, CAST(new_id AS BIGINT) AS order_id, 'ORD-WEB-' || {_NUMBER.format('new_id')} AS order_number FROM fresh""",
)(
    lambda t: movements.number_documents(
        t["customer_orders"].filter(F.col("status_code") == "draft").select(F.col("order_id").alias("source_id")),
        t["customer_orders"],
        "order_id",
        "order_number",
        "ORD-WEB-",
        "source_id",
    )
)

_ORDER_JUDGED = """
SELECT r.request_id, r.order_id, r.product_id, r.quantity, a.price, x.present_quantity,
       a.quantity_available - coalesce(x.present_quantity, 0) AS room,
       CASE WHEN o.order_id IS NULL THEN 'order_missing' WHEN o.status_code <> 'draft' THEN 'order_not_draft'
            WHEN r.quantity <= 0 THEN 'quantity_not_positive' WHEN a.price IS NULL THEN 'product_unavailable'
            WHEN a.quantity_available <= 0 THEN 'out_of_stock'
            WHEN coalesce(x.present_quantity, 0) + r.quantity > a.quantity_available THEN 'insufficient_stock' END AS reject_reason
FROM {order_line_requests} AS r
LEFT JOIN {customer_orders} AS o ON o.order_id = r.order_id
LEFT JOIN (
  SELECT p.product_id, p.price, coalesce(sum(f.quantity_current), 0) AS quantity_available
  FROM {products} AS p
  LEFT JOIN (SELECT f.* FROM {finished_goods_stock} AS f
             WHERE f.quantity_current > 0 AND f.expiry_date >= DATE '1995-06-01'
               AND EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.production_batch_id = f.production_batch_id
                           AND q.check_type = 'finished_product' AND q.result_code = 'passed')
               AND NOT EXISTS (SELECT 1 FROM {quality_checks} AS q WHERE q.production_batch_id = f.production_batch_id
                               AND q.check_type = 'finished_product' AND q.result_code = 'failed')) AS f
         ON f.product_id = p.product_id
  WHERE p.is_active GROUP BY p.product_id, p.price) AS a ON a.product_id = r.product_id
LEFT JOIN (SELECT order_id, product_id, sum(quantity) AS present_quantity FROM {order_items} GROUP BY order_id, product_id) AS x
       ON x.order_id = r.order_id AND x.product_id = r.product_id"""

_ORDER_ADMISSION = f"""
WITH RECURSIVE judged AS ({_ORDER_JUDGED}),
{_admission_sql('''
  SELECT request_id, CAST(order_id AS VARCHAR) || '/' || CAST(product_id AS VARCHAR) AS resource_id, 0 AS day, quantity AS q, 0 AS e, room AS cap
  FROM judged WHERE reject_reason IS NULL''')}"""


def _order_judged(t):
    return movements.judge_order_lines(
        t["order_line_requests"],
        t["customer_orders"],
        t["order_items"],
        t["products"],
        t["finished_goods_stock"],
        t["quality_checks"],
        date(1995, 6, 1),
    )


query(
    "g10_order_line_admission",
    f"""{_ORDER_ADMISSION}
SELECT order_id, product_id, sum(quantity) + coalesce(max(present_quantity), 0) AS quantity, max(price) AS unit_price,
       count(*) AS request_count, bool_or(present_quantity IS NOT NULL) AS was_present,
       round((sum(quantity) + coalesce(max(present_quantity), 0)) * max(price), 2) AS line_amount
FROM judged WHERE request_id IN (SELECT request_id FROM decided WHERE status = 'yes')
GROUP BY order_id, product_id""",
    decimals="quantity unit_price line_amount",
)(lambda t: movements.order_line_admission(_order_judged(t))[0])

query(
    "g10_order_line_rejects",
    f"""{_ORDER_ADMISSION}
SELECT request_id, coalesce(reject_reason, 'insufficient_stock') AS reject_reason FROM judged
WHERE reject_reason IS NOT NULL OR request_id IN (SELECT request_id FROM decided WHERE status = 'no')""",
)(lambda t: movements.order_line_admission(_order_judged(t))[1])

# -- keyed writes -----------------------------------------------------------------

query(
    "w1_upsert_by_key",
    """
WITH changes AS (
  SELECT l_suppkey AS supplier_id, (l_partkey + l_linenumber) AS material_id,
         max_by(CAST(l_extendedprice AS DECIMAL(12,2)), CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
                || '-' || CAST(l_partkey AS VARCHAR)) AS purchase_price
  FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT s.supplier_material_id, coalesce(s.supplier_id, c.supplier_id) AS supplier_id,
       coalesce(s.material_id, c.material_id) AS material_id,
       CASE WHEN c.supplier_id IS NOT NULL THEN c.purchase_price ELSE s.purchase_price END AS purchase_price,
       s.lead_time_days, s.is_active,
       CASE WHEN s.supplier_id IS NULL THEN 'inserted' WHEN c.supplier_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS write_kind
FROM {supplier_materials} AS s FULL JOIN changes AS c ON c.supplier_id = s.supplier_id AND c.material_id = s.material_id""",
    decimals="purchase_price",
)(
    lambda t: writes.upsert_by_key(
        t["supplier_materials"],
        t["lineitem"]
        .filter(F.col("l_returnflag") == "R")
        .select(
            F.col("l_suppkey").alias("supplier_id"),
            (F.col("l_partkey") + F.col("l_linenumber")).alias("material_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("purchase_price"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("sent"),
        ),
        ["supplier_id", "material_id"],
        "sent",
    )
)

query(
    "w1_upsert_recipe",
    """
WITH changes AS (
  SELECT tech_card_id, material_id, '' AS stage, quantity + 1 AS quantity FROM {recipe_items} WHERE coalesce(stage, '') = ''
  UNION ALL
  SELECT tech_card_id, material_id, 'baking', quantity FROM {recipe_items} WHERE stage = 'mixing')
SELECT r.recipe_item_id, coalesce(r.tech_card_id, c.tech_card_id) AS tech_card_id,
       coalesce(r.material_id, c.material_id) AS material_id,
       CASE WHEN c.tech_card_id IS NOT NULL THEN c.quantity ELSE r.quantity END AS quantity,
       CASE WHEN r.recipe_item_id IS NOT NULL THEN r.stage ELSE nullif(c.stage, '') END AS stage,
       CASE WHEN r.recipe_item_id IS NULL THEN 'inserted' WHEN c.tech_card_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS write_kind
FROM {recipe_items} AS r FULL JOIN changes AS c
  ON c.tech_card_id = r.tech_card_id AND c.material_id = r.material_id AND coalesce(c.stage, '') = coalesce(r.stage, '')""",
    decimals="quantity",
)(
    lambda t: writes.upsert_by_key(
        t["recipe_items"].select("recipe_item_id", "tech_card_id", "material_id", "quantity", "stage"),
        t["recipe_items"]
        .filter(F.coalesce("stage", F.lit("")) == "")
        .select("tech_card_id", "material_id", "stage", (F.col("quantity") + 1).alias("quantity"), F.lit(1).alias("sent"))
        .unionByName(
            t["recipe_items"]
            .filter(F.col("stage") == "mixing")
            .select("tech_card_id", "material_id", F.lit("baking").alias("stage"), "quantity", F.lit(2).alias("sent"))
        ),
        ["tech_card_id", "material_id", "stage"],
        "sent",
        blank_as_null=("stage",),
    )
)

_MOVED = """
WITH changes AS (
  SELECT supplier_material_id, supplier_id, CASE WHEN lead_time_days = 7 THEN material_id + 1 ELSE material_id END AS material_id,
         5 AS lead_time_days
  FROM {supplier_materials} WHERE lead_time_days >= 6),
clash AS (
  SELECT c.supplier_material_id FROM changes AS c
  WHERE EXISTS (SELECT 1 FROM {supplier_materials} AS o WHERE o.supplier_id = c.supplier_id AND o.material_id = c.material_id
                AND o.supplier_material_id <> c.supplier_material_id))"""


def _offer_changes(t):
    offers = t["supplier_materials"].filter(F.col("lead_time_days") >= 6)
    moved = F.when(F.col("lead_time_days") == 7, F.col("material_id") + 1).otherwise(F.col("material_id"))
    return offers.select("supplier_material_id", "supplier_id", moved.alias("material_id"), F.lit(5).alias("lead_time_days"))


query(
    "w2_update_by_key",
    f"""{_MOVED}
SELECT s.supplier_material_id, s.supplier_id, coalesce(c.material_id, s.material_id) AS material_id, s.purchase_price,
       coalesce(c.lead_time_days, s.lead_time_days) AS lead_time_days, s.is_active
FROM {{supplier_materials}} AS s
LEFT JOIN (SELECT * FROM changes WHERE supplier_material_id NOT IN (SELECT supplier_material_id FROM clash)) AS c
       ON c.supplier_material_id = s.supplier_material_id""",
    decimals="purchase_price",
)(
    lambda t: writes.update_by_key(
        t["supplier_materials"], _offer_changes(t), "supplier_material_id", ["supplier_id", "material_id"]
    )[0]
)

query(
    "w2_update_rejects",
    f"{_MOVED} SELECT supplier_material_id, 'taken_by_other_row' AS reject_reason FROM clash",
)(
    lambda t: writes.update_by_key(
        t["supplier_materials"], _offer_changes(t), "supplier_material_id", ["supplier_id", "material_id"]
    )[1]
)

query(
    "w3_deactivate",
    """
SELECT supplier_id, company_name,
       is_active AND NOT EXISTS (SELECT 1 FROM {supplier_invoices} AS i WHERE i.supplier_id = s.supplier_id
                                 AND i.status_code = 'overdue') AS is_active
FROM {suppliers} AS s""",
)(
    lambda t: writes.deactivate(
        t["suppliers"].select("supplier_id", "company_name", "is_active"),
        t["supplier_invoices"].filter(F.col("status_code") == "overdue"),
        "supplier_id",
    )
)

# The same writes on stored tables, which replace only files with changed keys; the rows of the latest version.


def _stored(t, rows, by):
    """A new stored table of the rows."""
    folder = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    stored.create(rows, folder, by)
    return folder


@query(
    "w1_stored_upsert",
    """
WITH changes AS (
  SELECT l_suppkey AS supplier_id, l_partkey + l_linenumber AS material_id,
         max(CAST(l_extendedprice AS DECIMAL(12,2))) AS purchase_price
  FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT s.supplier_material_id, coalesce(s.supplier_id, c.supplier_id) AS supplier_id,
       coalesce(s.material_id, c.material_id) AS material_id, coalesce(c.purchase_price, s.purchase_price) AS purchase_price,
       s.lead_time_days, s.is_active
FROM {supplier_materials} AS s FULL JOIN changes AS c ON c.supplier_id = s.supplier_id AND c.material_id = s.material_id""",
    decimals="purchase_price",
)
def upsert_stored_offers(t):
    keys = ["supplier_id", "material_id"]
    folder = _stored(t, t["supplier_materials"], keys)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    changes = (
        t["lineitem"]
        .filter(F.col("l_returnflag") == "A")
        .select(
            F.col("l_suppkey").alias("supplier_id"),
            (F.col("l_partkey") + F.col("l_linenumber")).alias("material_id"),
            price.alias("purchase_price"),
            price.alias("rank"),
        )
    )
    stored_writes.upsert_stored(folder, changes, keys, "rank")
    return stored.read(changes.sparkSession, folder)


@query(
    "w2_stored_update",
    f"""{_MOVED}
SELECT s.supplier_material_id, s.supplier_id, coalesce(c.material_id, s.material_id) AS material_id, s.purchase_price,
       coalesce(c.lead_time_days, s.lead_time_days) AS lead_time_days, s.is_active
FROM {{supplier_materials}} AS s
LEFT JOIN (SELECT * FROM changes WHERE supplier_material_id NOT IN (SELECT supplier_material_id FROM clash)) AS c
       ON c.supplier_material_id = s.supplier_material_id""",
    decimals="purchase_price",
)
def update_stored_offers(t):
    key = "supplier_material_id"
    folder = _stored(t, t["supplier_materials"], [key])
    stored_writes.update_stored(folder, _offer_changes(t), key, ["supplier_id", "material_id"])
    return stored.read(t["lineitem"].sparkSession, folder)


@query(
    "w3_stored_deactivate",
    """
SELECT supplier_id, company_name,
       is_active AND NOT EXISTS (SELECT 1 FROM {supplier_invoices} AS i WHERE i.supplier_id = s.supplier_id
                                 AND i.status_code = 'overdue') AS is_active
FROM {suppliers} AS s""",
)
def deactivate_stored_suppliers(t):
    folder = _stored(t, t["suppliers"].select("supplier_id", "company_name", "is_active"), ["supplier_id"])
    stored_writes.deactivate_stored(folder, t["supplier_invoices"].filter(F.col("status_code") == "overdue"), "supplier_id")
    return stored.read(t["lineitem"].sparkSession, folder)


_PAYABLE = "i.status_code IN ('issued', 'overdue') AND o.customer_id = r.customer_id"


def _judged_payments(t):
    return transitions.invoice_payments(t["invoices"], t["invoice_payments"], t["customer_orders"]).withColumn(
        "new_status", F.lit("paid")
    )


query(
    "w4_set_paid",
    f"""
SELECT i.invoice_id, i.order_id, CASE WHEN {_PAYABLE} THEN 'paid' ELSE i.status_code END AS status_code,
       CASE WHEN {_PAYABLE} THEN TIMESTAMP '1998-01-15 12:00:00' ELSE i.paid_at END AS paid_at
FROM {{invoices}} AS i
LEFT JOIN {{invoice_payments}} AS r ON r.invoice_id = i.invoice_id
LEFT JOIN {{customer_orders}} AS o ON o.order_id = i.order_id""",
)(
    lambda t: transitions.apply_invoice_status(t["invoices"], _judged_payments(t), "invoice_id", NOW).select(
        "invoice_id", "order_id", "status_code", "paid_at"
    )
)

query(
    "w4_set_received",
    """
SELECT d.delivery_id,
       CASE WHEN (d.status_code, r.new_status) IN (('planned', 'received'), ('planned', 'cancelled'), ('received', 'accepted'), ('received', 'rejected'))
                 AND (r.new_status NOT IN ('received', 'accepted') OR i.n > 0) AND (r.new_status <> 'accepted' OR i.amount > 0)
            THEN r.new_status ELSE d.status_code END AS status_code,
       CASE WHEN (d.status_code, r.new_status) IN (('planned', 'received'), ('received', 'accepted')) AND i.n > 0
                 AND (r.new_status <> 'accepted' OR i.amount > 0)
            THEN r.user_id ELSE d.received_by_user_id END AS received_by_user_id
FROM {raw_material_deliveries} AS d
JOIN {delivery_status_requests} AS r ON r.delivery_id = d.delivery_id
LEFT JOIN (SELECT delivery_id, count(*) AS n, sum(quantity * unit_price) AS amount FROM {delivery_items} GROUP BY delivery_id) AS i
       ON i.delivery_id = d.delivery_id""",
)(
    lambda t: transitions.apply_delivery_status(
        t["raw_material_deliveries"],
        transitions.delivery_transitions(
            t["raw_material_deliveries"], t["delivery_status_requests"], t["delivery_items"]
        ),
    ).select("delivery_id", "status_code", "received_by_user_id")
)

# -- transitions --------------------------------------------------------------------

_SHIPMENT_EDGES = "(('planned', 'shipped'), ('planned', 'cancelled'), ('shipped', 'delivered'))"

query(
    "t1_validate_transitions",
    f"""
SELECT r.shipment_id, r.new_status, s.status_code AS current_status,
       CASE WHEN s.shipment_id IS NULL THEN 'document_missing'
            WHEN (s.status_code, r.new_status) NOT IN {_SHIPMENT_EDGES} THEN 'transition_not_allowed' END AS reject_reason
FROM {{shipment_status_requests}} AS r LEFT JOIN {{shipments}} AS s ON s.shipment_id = r.shipment_id""",
)(
    lambda t: transitions.validate_transitions(
        t["shipments"], t["shipment_status_requests"], "shipment_id", "shipment"
    )
)

_ORDER_ALLOWED = """((r.role_code = 'admin' AND (o.status_code, r.new_status) IN (
       ('draft', 'confirmed'), ('draft', 'cancelled'), ('confirmed', 'in_production'), ('confirmed', 'cancelled'),
       ('in_production', 'ready'), ('ready', 'shipped'), ('shipped', 'completed')))
    OR (r.role_code = 'technologist' AND o.status_code = 'confirmed' AND r.new_status = 'in_production'))"""

query(
    "t2_order_edges_by_role",
    f"""
SELECT r.order_id, r.role_code, o.status_code AS current_status, r.new_status, {_ORDER_ALLOWED} AS is_allowed
FROM {{order_status_requests}} AS r JOIN {{customer_orders}} AS o ON o.order_id = r.order_id""",
)(
    lambda t: t["order_status_requests"]
    .join(t["customer_orders"].select("order_id", F.col("status_code").alias("current_status")), "order_id")
    .select(
        "order_id",
        "role_code",
        "current_status",
        "new_status",
        transitions.is_order_edge_for_role(F.col("role_code"), F.col("current_status"), F.col("new_status")).alias(
            "is_allowed"
        ),
    )
)

query(
    "t3_order_guards",
    f"""
SELECT r.order_id, r.role_code, o.status_code AS current_status, r.new_status,
       CASE WHEN o.order_id IS NULL THEN 'document_missing'
            WHEN NOT {_ORDER_ALLOWED} THEN 'transition_not_allowed'
            WHEN r.new_status = 'shipped' AND coalesce(p.n, 0) = 0 THEN 'no_invoice'
            WHEN r.new_status = 'shipped' AND p.paid = 0 THEN 'invoice_not_paid'
            WHEN r.new_status = 'shipped' AND NOT coalesce(c.is_covered, FALSE) THEN 'not_covered_by_shipments'
            WHEN r.new_status = 'completed' AND NOT EXISTS (SELECT 1 FROM {{shipments}} AS s WHERE s.order_id = o.order_id
                 AND s.status_code = 'delivered') THEN 'no_delivered_shipment' END AS reject_reason
FROM {{order_status_requests}} AS r
LEFT JOIN {{customer_orders}} AS o ON o.order_id = r.order_id
LEFT JOIN {_PAYMENT} AS p ON p.order_id = r.order_id
LEFT JOIN (
  SELECT order_id, bool_and(shipped >= quantity) AS is_covered FROM (
    SELECT i.order_id, i.order_item_id, i.quantity,
           coalesce(sum(CASE WHEN s.shipment_id IS NOT NULL THEN si.quantity ELSE 0 END), 0) AS shipped
    FROM {{order_items}} AS i
    LEFT JOIN {{shipment_items}} AS si ON si.order_item_id = i.order_item_id
    LEFT JOIN {{shipments}} AS s ON s.shipment_id = si.shipment_id AND s.status_code IN ('shipped', 'delivered')
    GROUP BY i.order_id, i.order_item_id, i.quantity) AS l
  GROUP BY order_id) AS c ON c.order_id = r.order_id""",
)(
    lambda t: transitions.order_transitions(
        t["customer_orders"],
        t["order_status_requests"],
        t["invoices"],
        t["order_items"],
        t["shipment_items"],
        t["shipments"],
    )
)

_SHIPMENT_JUDGED = f"""
SELECT r.shipment_id, s.status_code AS current_status, r.new_status,
       CASE WHEN s.shipment_id IS NULL THEN 'document_missing'
            WHEN (s.status_code, r.new_status) NOT IN {_SHIPMENT_EDGES} THEN 'transition_not_allowed'
            WHEN r.new_status = 'shipped' AND coalesce(p.n, 0) = 0 THEN 'no_invoice'
            WHEN r.new_status = 'shipped' AND p.paid = 0 THEN 'invoice_not_paid'
            WHEN r.new_status IN ('shipped', 'delivered') AND NOT EXISTS (
                 SELECT 1 FROM {{shipment_items}} AS i WHERE i.shipment_id = r.shipment_id) THEN 'no_items' END AS reject_reason
FROM {{shipment_status_requests}} AS r
LEFT JOIN {{shipments}} AS s ON s.shipment_id = r.shipment_id
LEFT JOIN {_PAYMENT} AS p ON p.order_id = s.order_id"""


def _judged_shipments(t):
    return transitions.shipment_transitions(
        t["shipments"], t["shipment_status_requests"], t["customer_orders"], t["invoices"], t["shipment_items"]
    )


query("t4_shipment_guards", _SHIPMENT_JUDGED)(_judged_shipments)

query(
    "w4_set_shipped",
    f"""
SELECT s.shipment_id, CASE WHEN j.shipment_id IS NOT NULL THEN j.new_status ELSE s.status_code END AS status_code,
       CASE WHEN j.new_status = 'shipped' THEN coalesce(s.shipped_at, TIMESTAMP '1998-01-15 12:00:00') ELSE s.shipped_at END AS shipped_at
FROM {{shipments}} AS s
LEFT JOIN (SELECT * FROM ({_SHIPMENT_JUDGED}) AS x WHERE reject_reason IS NULL) AS j ON j.shipment_id = s.shipment_id""",
)(
    lambda t: transitions.apply_shipment_status(t["shipments"], _judged_shipments(t), NOW).select(
        "shipment_id", "status_code", "shipped_at"
    )
)

_DELIVERY_JUDGED = """
SELECT r.delivery_id, r.new_status, r.user_id, d.status_code AS current_status,
       CASE WHEN d.delivery_id IS NULL THEN 'document_missing'
            WHEN (d.status_code, r.new_status) NOT IN (('planned', 'received'), ('planned', 'cancelled'), ('received', 'accepted'),
                                                       ('received', 'rejected')) THEN 'transition_not_allowed'
            WHEN r.new_status IN ('received', 'accepted') AND i.n IS NULL THEN 'no_items'
            WHEN r.new_status = 'accepted' AND i.amount <= 0 THEN 'no_items' END AS reject_reason
FROM {delivery_status_requests} AS r
LEFT JOIN {raw_material_deliveries} AS d ON d.delivery_id = r.delivery_id
LEFT JOIN (SELECT delivery_id, count(*) AS n, sum(quantity * unit_price) AS amount FROM {delivery_items} GROUP BY delivery_id) AS i
       ON i.delivery_id = r.delivery_id"""

query("t5_delivery_guards", _DELIVERY_JUDGED)(
    lambda t: transitions.delivery_transitions(
        t["raw_material_deliveries"], t["delivery_status_requests"], t["delivery_items"]
    )
)

query(
    "t5_delivery_wave_lots",
    f"""
SELECT i.material_id, i.delivery_item_id, i.batch_number, i.quantity AS quantity_current, i.expiry_date
FROM ({_DELIVERY_JUDGED}) AS j JOIN {{delivery_items}} AS i ON i.delivery_id = j.delivery_id
WHERE j.reject_reason IS NULL AND j.new_status IN ('received', 'accepted')
  AND NOT EXISTS (SELECT 1 FROM {{raw_material_stock}} AS s WHERE s.delivery_item_id = i.delivery_item_id)""",
    decimals="quantity_current",
)(lambda t: run_delivery_wave(t, t["delivery_status_requests"], AS_OF).new_lots)

query(
    "t5_delivery_wave_invoices",
    f"""
WITH fresh AS (
  SELECT j.delivery_id, sum(i.quantity * i.unit_price) AS amount,
         (SELECT max(supplier_invoice_id) FROM {{supplier_invoices}}) + row_number() OVER (ORDER BY j.delivery_id) AS new_id
  FROM ({_DELIVERY_JUDGED}) AS j JOIN {{delivery_items}} AS i ON i.delivery_id = j.delivery_id
  WHERE j.reject_reason IS NULL AND j.new_status = 'accepted'
    AND NOT EXISTS (SELECT 1 FROM {{supplier_invoices}} AS s WHERE s.delivery_id = j.delivery_id)
  GROUP BY j.delivery_id)
SELECT CAST(new_id AS BIGINT) AS supplier_invoice_id, delivery_id, round(amount, 2) AS amount FROM fresh""",
    decimals="amount",
)(
    lambda t: run_delivery_wave(t, t["delivery_status_requests"], AS_OF).new_invoices.select(
        "supplier_invoice_id", "delivery_id", "amount"
    )
)

_T6_PARTS = f"""
demand AS (
  SELECT x.production_batch_id, x.day, x.material_id, sum(x.required_qty) AS quantity
  FROM ({_REQUIREMENT}) AS x GROUP BY x.production_batch_id, x.day, x.material_id),
lots AS ({_GATED}),
judged AS (
  SELECT d.production_batch_id, d.material_id, d.quantity, coalesce(sum(l.gated), 0) AS gated, coalesce(sum(l.ungated), 0) AS ungated
  FROM demand AS d LEFT JOIN lots AS l ON l.material_id = d.material_id AND l.expiry_date >= d.day
  GROUP BY d.production_batch_id, d.material_id, d.quantity),
verdicts AS (
  SELECT production_batch_id,
         min_by(CASE WHEN ungated > 0 AND gated = 0 THEN 'not_quality_approved' ELSE 'insufficient' END, material_id) AS verdict
  FROM judged WHERE gated < quantity OR (ungated > 0 AND gated = 0) GROUP BY production_batch_id),
guarded AS (
  SELECT r.production_batch_id, b.status_code AS current_status, r.new_status,
    CASE WHEN b.production_batch_id IS NULL THEN 'document_missing'
         WHEN (b.status_code, r.new_status) NOT IN (('planned', 'in_progress'), ('planned', 'cancelled'),
              ('in_progress', 'completed'), ('in_progress', 'cancelled')) THEN 'transition_not_allowed'
         WHEN b.responsible_user_id IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM {{users}} AS u JOIN {{user_roles}} AS ur ON ur.user_id = u.user_id JOIN {{roles}} AS ro ON ro.role_id = ur.role_id
              WHERE u.user_id = b.responsible_user_id AND u.status_code = 'active' AND ro.role_code = 'technologist')
              THEN 'responsible_not_technologist'
         WHEN tc.status_code <> 'active' THEN 'card_not_active'
         WHEN tc.effective_from > CAST(b.production_date AS DATE) THEN 'card_not_yet_effective'
         WHEN tc.effective_to < CAST(b.production_date AS DATE) THEN 'card_expired'
         WHEN r.new_status = 'in_progress' THEN v.verdict
         WHEN r.new_status = 'completed' AND EXISTS (SELECT 1 FROM {{finished_goods_stock}} AS f
              WHERE f.production_batch_id = b.production_batch_id) THEN 'already_stocked'
         WHEN r.new_status NOT IN (SELECT status_code FROM {{production_statuses}}) THEN 'status_unknown' END AS reject_reason
  FROM {{production_status_requests}} AS r
  LEFT JOIN {{production_batches}} AS b ON b.production_batch_id = r.production_batch_id
  LEFT JOIN {{tech_cards}} AS tc ON tc.tech_card_id = b.tech_card_id
  LEFT JOIN verdicts AS v ON v.production_batch_id = r.production_batch_id)"""

query("t6_production_guards", f"WITH {_T6_PARTS.strip()} SELECT * FROM guarded")(
    lambda t: judge_production_requests(t, t["production_status_requests"])
)

_T6_WAVE = f"""
WITH RECURSIVE {_T6_PARTS.strip()},
supply AS (SELECT material_id, sum(gated) AS cap FROM lots GROUP BY material_id),
asked AS (
  SELECT d.* FROM demand AS d JOIN guarded AS g ON g.production_batch_id = d.production_batch_id
  WHERE g.reject_reason IS NULL AND g.new_status = 'completed' AND d.quantity > 0),
skipped AS (
  SELECT d.material_id, d.day, sum(l.gated) AS e FROM (SELECT DISTINCT material_id, day FROM asked) AS d
  JOIN lots AS l ON l.material_id = d.material_id AND l.expiry_date < d.day GROUP BY d.material_id, d.day),
{_admission_sql('''
  SELECT d.production_batch_id AS request_id, d.material_id AS resource_id, d.day, d.quantity AS q,
         coalesce(k.e, 0) AS e, coalesce(s.cap, 0) AS cap
  FROM asked AS d LEFT JOIN supply AS s ON s.material_id = d.material_id
  LEFT JOIN skipped AS k ON k.material_id = d.material_id AND k.day = d.day''')},
outcome AS (
  SELECT production_batch_id, current_status, new_status,
         coalesce(reject_reason, CASE WHEN production_batch_id IN (SELECT request_id FROM decided WHERE status = 'no')
                                      THEN 'insufficient' END) AS reject_reason
  FROM guarded)"""

query("t6_production_wave", f"{_T6_WAVE} SELECT * FROM outcome")(
    lambda t: run_production_wave(t, t["production_status_requests"], NOW).judged
)

query(
    "t6_production_wave_lots",
    f"""{_T6_WAVE}
SELECT b.product_id, b.production_batch_id, b.batch_number, b.quantity_produced - b.quantity_defective AS quantity_current,
       CAST(b.production_date AS DATE) AS production_date, CAST(b.production_date AS DATE) + p.shelf_life_days AS expiry_date
FROM outcome AS o
JOIN {{production_batches}} AS b ON b.production_batch_id = o.production_batch_id
JOIN {{products}} AS p ON p.product_id = b.product_id
WHERE o.reject_reason IS NULL AND o.new_status = 'completed' AND b.quantity_produced > b.quantity_defective""",
    decimals="quantity_current",
)(lambda t: run_production_wave(t, t["production_status_requests"], NOW).new_lots)

query(
    "t6_production_wave_stock",
    f"""{_T6_WAVE},
taken AS (
  SELECT *, c + max(e - c + q) OVER w AS end_at FROM (
    SELECT *, sum(q) OVER w AS c FROM decided WHERE status = 'yes'
    WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)) AS y
  WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)),
shelves AS (
  SELECT *, CAST(sum(gated) OVER (PARTITION BY material_id ORDER BY expiry_date, stock_id) AS DECIMAL(38,10)) AS end_at
  FROM lots WHERE gated > 0),
used AS (
  SELECT s.stock_id, sum(least(t.end_at, s.end_at) - greatest(t.end_at - t.q, s.end_at - s.gated)) AS qty
  FROM taken AS t JOIN shelves AS s ON s.material_id = t.resource_id
   AND s.end_at > t.end_at - t.q AND s.end_at - s.gated < t.end_at
  GROUP BY s.stock_id)
SELECT r.stock_id, r.material_id, round(r.quantity_current - coalesce(u.qty, 0), 3) AS quantity_current
FROM {{raw_material_stock}} AS r LEFT JOIN used AS u ON u.stock_id = r.stock_id""",
    decimals="quantity_current",
)(
    lambda t: run_production_wave(t, t["production_status_requests"], NOW).material_stock.select(
        "stock_id", "material_id", "quantity_current"
    )
)

_PRODUCTION_TABLES = (
    "production_statuses raw_materials products roles users user_roles raw_material_stock tech_cards recipe_items "
    "production_batches finished_goods_stock quality_checks"
).split()


def _set_of(t, names):
    """A new set of stored tables with an empty audit log; returns its folder."""
    spark = t["lineitem"].sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], layout("audit_log"))
    stored_set.create_set({**{n: t[n] for n in names}, "audit_log": empty}, folder)
    return spark, folder


@query(
    "t6_committed_wave",
    f"""{_T6_WAVE},
moved AS (SELECT * FROM outcome WHERE reject_reason IS NULL),
taken AS (
  SELECT *, c + max(e - c + q) OVER w AS end_at FROM (
    SELECT *, sum(q) OVER w AS c FROM decided WHERE status = 'yes'
    WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)) AS y
  WINDOW w AS (PARTITION BY resource_id ORDER BY day, request_id)),
shelves AS (
  SELECT *, CAST(sum(gated) OVER (PARTITION BY material_id ORDER BY expiry_date, stock_id) AS DECIMAL(38,10)) AS end_at
  FROM lots WHERE gated > 0),
used AS (
  SELECT s.stock_id, sum(least(t.end_at, s.end_at) - greatest(t.end_at - t.q, s.end_at - s.gated)) AS qty
  FROM taken AS t JOIN shelves AS s ON s.material_id = t.resource_id
   AND s.end_at > t.end_at - t.q AND s.end_at - s.gated < t.end_at
  GROUP BY s.stock_id)
SELECT 'production_batches' AS table_name, CAST(b.production_batch_id AS VARCHAR) AS row_id,
       coalesce(m.new_status, b.status_code) AS status, CAST(NULL AS DECIMAL(12,3)) AS quantity
FROM {{production_batches}} AS b LEFT JOIN moved AS m ON m.production_batch_id = b.production_batch_id
UNION ALL
SELECT 'raw_material_stock', r.stock_id, NULL, round(r.quantity_current - coalesce(u.qty, 0), 3)
FROM {{raw_material_stock}} AS r LEFT JOIN used AS u ON u.stock_id = r.stock_id
UNION ALL
SELECT 'finished_goods_stock', CAST(finished_stock_id AS VARCHAR), NULL, quantity_current FROM {{finished_goods_stock}}
UNION ALL
SELECT 'finished_goods_stock', CAST((SELECT max(finished_stock_id) FROM {{finished_goods_stock}})
                                    + row_number() OVER (ORDER BY b.production_batch_id) AS VARCHAR), NULL,
       b.quantity_produced - b.quantity_defective
FROM moved AS m JOIN {{production_batches}} AS b ON b.production_batch_id = m.production_batch_id
WHERE m.new_status = 'completed' AND b.quantity_produced > b.quantity_defective
UNION ALL
SELECT 'audit_log', 'production_batch_id=' || CAST(production_batch_id AS VARCHAR), 'UPDATE', NULL FROM moved""",
    decimals="quantity",
)
def committed_production_wave(t):
    spark, folder = _set_of(t, _PRODUCTION_TABLES)
    version, _ = stored_waves.commit_production_wave(spark, folder, t["production_status_requests"], NOW)
    after = stored_set.read_set(spark, folder, version)
    none = F.lit(None).cast("decimal(12,3)")

    def shown(name, row_id, status, quantity):
        return after[name].select(
            F.lit(name).alias("table_name"),
            F.col(row_id).cast("string").alias("row_id"),
            status.alias("status"),
            quantity.alias("quantity"),
        )

    status, quantity = F.lit(None).cast("string"), F.col("quantity_current")
    return (
        shown("production_batches", "production_batch_id", F.col("status_code"), none)
        .unionByName(shown("raw_material_stock", "stock_id", status, quantity))
        .unionByName(shown("finished_goods_stock", "finished_stock_id", status, quantity))
        .unionByName(shown("audit_log", "record_id", F.col("action_type"), none))
    )


query(
    "t7_invoice_payments",
    """
SELECT r.invoice_id, r.customer_id, i.status_code AS current_status,
       CASE WHEN i.invoice_id IS NULL THEN 'invoice_missing'
            WHEN o.customer_id IS DISTINCT FROM r.customer_id THEN 'invoice_of_other_customer'
            WHEN i.status_code = 'paid' THEN 'already_paid'
            WHEN i.status_code NOT IN ('issued', 'overdue') THEN 'not_payable' END AS reject_reason
FROM {invoice_payments} AS r
LEFT JOIN {invoices} AS i ON i.invoice_id = r.invoice_id
LEFT JOIN {customer_orders} AS o ON o.order_id = i.order_id""",
)(lambda t: transitions.invoice_payments(t["invoices"], t["invoice_payments"], t["customer_orders"]))

query(
    "t8_tech_card_guards",
    """
WITH judged AS (
  SELECT r.tech_card_id, tc.product_id, tc.status_code AS current_status, r.new_status,
         CASE WHEN tc.tech_card_id IS NULL THEN 'document_missing'
              WHEN (tc.status_code, r.new_status) NOT IN (('draft', 'active'), ('draft', 'archived'), ('active', 'archived'))
                   THEN 'transition_not_allowed'
              WHEN r.new_status = 'active' AND tc.approved_by_user_id IS NULL THEN 'approver_missing' END AS reason
  FROM {tech_card_status_requests} AS r LEFT JOIN {tech_cards} AS tc ON tc.tech_card_id = r.tech_card_id)
SELECT tech_card_id, current_status, new_status,
       CASE WHEN reason IS NULL AND new_status = 'active'
             AND (EXISTS (SELECT 1 FROM {tech_cards} AS c WHERE c.product_id = j.product_id AND c.status_code = 'active')
                  OR EXISTS (SELECT 1 FROM judged AS k WHERE k.product_id = j.product_id AND k.reason IS NULL
                             AND k.new_status = 'active' AND k.tech_card_id < j.tech_card_id))
            THEN 'product_has_active_card' ELSE reason END AS reject_reason
FROM judged AS j""",
)(lambda t: transitions.tech_card_transitions(t["tech_cards"], t["tech_card_status_requests"]))

query(
    "t9_next_statuses",
    """
SELECT b.production_batch_id, b.status_code, e.new_status, s.name AS new_name
FROM {production_batches} AS b
JOIN (VALUES ('planned', 'in_progress'), ('planned', 'cancelled'), ('in_progress', 'completed'), ('in_progress', 'cancelled'))
     AS e(status_code, new_status) ON e.status_code = b.status_code
JOIN {production_statuses} AS s ON s.status_code = e.new_status""",
)(
    lambda t: transitions.next_statuses(
        t["production_batches"], "production_batch_id", "production", t["production_statuses"]
    )
)
