"""The business tables bound to the supplied star-schema Parquet files.

Each binding is one SELECT in the SQL both Spark and DuckDB read the same way,
with ``{name}`` for a table it reads: a supplied file or another binding. Spark
builds the DataFrames from it; the check SQL puts the same text in WITH clauses.

A line has no key of its own, so its id is the text of the five columns that
identify it. No id is made with a window over a whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stockweave.schemas import STATUSES
from stockweave.sources.tables import Tables

FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
    " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INTEGER) AS STRING)"
)
_QTY = "CAST(l_quantity AS DECIMAL(12,3))"
_UNIT_PRICE = "CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(12,2))"
_PART_NAME = "p_name || ' #' || CAST(p_partkey AS STRING)"


def _values(rows: list[tuple[str, str]]) -> str:
    body = ", ".join(f"('{code}', '{name}')" for code, name in rows)
    return f"SELECT status_code, name, CAST(NULL AS STRING) AS description FROM (VALUES {body}) AS v(status_code, name)"


BINDINGS: dict[str, str] = {name: _values(rows) for name, rows in STATUSES.items()}

BINDINGS["customers"] = """
SELECT c_custkey AS customer_id,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'individual' ELSE 'company' END AS customer_type,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_name END AS full_name,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_acctbal < 9900 THEN c_name END AS company_name,
       CASE WHEN c_acctbal >= -950 THEN '+7-900-' || CAST(c_custkey AS STRING) END AS phone,
       CASE WHEN c_custkey % 3 <> 0 THEN lower(c_name) || '@Example.com' END AS email,
       CASE WHEN c_acctbal < -900 THEN '  '
            ELSE 'Nation ' || CAST(c_nationkey AS STRING) || ', house ' || CAST(c_custkey AS STRING)
       END AS delivery_address,
       c_acctbal >= 0 AS is_active
FROM {customer}"""

BINDINGS["suppliers"] = """
SELECT s_suppkey AS supplier_id,
       s_name AS company_name,
       CASE WHEN s_acctbal >= 0 THEN 'Contact ' || s_name END AS contact_person,
       '+7-901-' || CAST(s_suppkey AS STRING) AS phone,
       CASE WHEN s_suppkey % 4 <> 0 THEN 'sales' || CAST(s_suppkey AS STRING) || '@example.com' END AS email,
       'Nation ' || CAST(s_nationkey AS STRING) AS address,
       s_acctbal >= 0 AS is_active
FROM {supplier}"""

BINDINGS["raw_materials"] = f"""
SELECT p_partkey AS material_id,
       {_PART_NAME} AS name,
       'kg' AS unit,
       CAST(p_size * 20 AS DECIMAL(12,3)) AS min_stock_qty,
       p_size AS shelf_life_days,
       p_brand AS storage_conditions,
       p_size % 10 <> 0 AS is_active
FROM {{part}}"""

BINDINGS["products"] = f"""
SELECT p_partkey AS product_id,
       {_PART_NAME} AS name,
       p_type AS category,
       'piece' AS unit,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price,
       p_size AS shelf_life_days,
       p_size % 10 <> 0 AS is_active
FROM {{part}}"""

# The role codes and names, and the grants per role and object.
BINDINGS["roles"] = """
SELECT CAST(role_id AS BIGINT) AS role_id, role_code, role_name
FROM (VALUES (1, 'admin', 'Administrator'), (2, 'technologist', 'Technologist'),
             (3, 'warehouse_worker', 'Warehouse Worker'), (4, 'quality_control', 'Quality Control'),
             (5, 'client', 'Client')) AS v(role_id, role_code, role_name)"""

# The grants of each role.
BINDINGS["role_permissions"] = """
SELECT CAST(permission_id AS BIGINT) AS permission_id, CAST(role_id AS BIGINT) AS role_id, object_name,
       can_select, can_insert, can_update, can_delete
FROM (VALUES (1, 1, 'users', TRUE, TRUE, TRUE, TRUE),
             (2, 1, 'audit_log', TRUE, FALSE, FALSE, FALSE),
             (3, 2, 'tech_cards', TRUE, TRUE, TRUE, FALSE),
             (4, 2, 'recipe_items', TRUE, TRUE, TRUE, FALSE),
             (5, 2, 'production_batches', TRUE, TRUE, TRUE, FALSE),
             (6, 3, 'raw_material_deliveries', TRUE, TRUE, TRUE, FALSE),
             (7, 3, 'raw_material_stock', TRUE, TRUE, TRUE, FALSE),
             (8, 3, 'shipments', TRUE, TRUE, TRUE, FALSE),
             (9, 4, 'quality_checks', TRUE, TRUE, TRUE, FALSE),
             (10, 5, 'customer_orders', TRUE, FALSE, FALSE, FALSE),
             (11, 5, 'invoices', TRUE, FALSE, FALSE, FALSE),
             (12, 5, 'shipments', TRUE, FALSE, FALSE, FALSE))
     AS v(permission_id, role_id, object_name, can_select, can_insert, can_update, can_delete)"""

BINDINGS["users"] = """
SELECT user_id,
       'User' || CAST(user_id AS STRING) AS username,
       'hash' AS password_hash,
       'Person ' || CAST(user_id AS STRING) AS full_name,
       'user' || CAST(user_id AS STRING) || '@example.com' AS email,
       CAST(NULL AS STRING) AS phone,
       CASE WHEN user_id % 11 = 0 THEN 'blocked' WHEN user_id % 13 = 0 THEN 'disabled' ELSE 'active' END AS status_code,
       CASE WHEN user_id % 3 = 0 THEN user_id END AS customer_id,
       min(ts) AS created_at,
       max(CASE WHEN event_type = 'view' THEN ts END) AS last_login_at
FROM {events}
GROUP BY user_id"""

# An event of high value makes its user a holder of the role tied to the event type.
BINDINGS["user_roles"] = """
SELECT user_id, role_id, min(ts) AS assigned_at, CAST(NULL AS BIGINT) AS assigned_by_user_id
FROM (SELECT user_id, ts,
             CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3
                                  WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS role_id
      FROM {events} WHERE value >= 190) AS e
GROUP BY user_id, role_id"""

BINDINGS["audit_log"] = """
SELECT event_id AS audit_id,
       CASE WHEN value >= 3 THEN user_id END AS user_id,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'
                       WHEN 'view' THEN 'LOGIN' ELSE 'LOGOUT' END AS action_type,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'users'
            WHEN value < 20 THEN 'customer_orders'
            WHEN value < 60 THEN 'invoices'
            ELSE 'shipments' END AS table_name,
       'user_id=' || CAST(user_id AS STRING) AS record_id,
       ts AS changed_at,
       CAST(NULL AS STRING) AS old_data,
       props AS new_data,
       '10.0.0.' || CAST(user_id % 250 AS STRING) AS ip_address,
       value >= 5 AS success
FROM {events}"""

BINDINGS["supplier_materials"] = f"""
SELECT CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING) AS supplier_material_id,
       l_suppkey AS supplier_id,
       l_partkey AS material_id,
       CASE WHEN min(l_discount) < 0.09 THEN min({_UNIT_PRICE}) END AS purchase_price,
       min(l_linenumber) AS lead_time_days,
       max(l_tax) >= 0.02 AS is_active
FROM {{lineitem}}
GROUP BY l_suppkey, l_partkey"""

BINDINGS["raw_material_deliveries"] = """
SELECT o_orderkey AS delivery_id,
       coalesce(l.supplier_id, 0) AS supplier_id,
       'DN-' || CAST(o_orderkey AS STRING) AS delivery_number,
       CAST(o_orderdate AS DATE) AS delivery_date,
       CASE WHEN o_orderstatus = 'F' THEN 'accepted'
            WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'rejected'
            WHEN o_orderstatus = 'P' THEN 'received'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled'
            ELSE 'planned' END AS status_code,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 200 END AS received_by_user_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN ' ' ELSE 'REF-' || CAST(o_orderkey AS STRING) END AS document_ref,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CAST(NULL AS STRING) AS note
FROM {orders}
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supplier_id FROM {lineitem} GROUP BY l_orderkey) AS l
       ON l.l_orderkey = o_orderkey"""

BINDINGS["delivery_items"] = f"""
SELECT {_LINE_ID} AS delivery_item_id,
       l_orderkey AS delivery_id,
       l_partkey AS material_id,
       {_QTY} AS quantity,
       {_UNIT_PRICE} AS unit_price,
       CASE WHEN l_linenumber < 6 THEN 'B' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
       END AS batch_number,
       CAST(l_shipdate AS DATE) AS expiry_date
FROM {{lineitem}}"""

BINDINGS["raw_material_stock"] = f"""
SELECT {_LINE_ID} AS stock_id,
       l_partkey AS material_id,
       {_LINE_ID} AS delivery_item_id,
       CASE WHEN l_linenumber < 6 THEN 'B' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
       END AS batch_number,
       CAST(CASE WHEN l_discount = 0 THEN 0 ELSE {_QTY} END AS DECIMAL(12,3)) AS quantity_current,
       CAST(l_shipdate AS DATE) AS expiry_date,
       l_shipdate AS updated_at
FROM {{lineitem}}
WHERE l_linestatus = 'O'"""

BINDINGS["tech_cards"] = """
SELECT p_partkey AS tech_card_id,
       p_partkey AS product_id,
       'TC-' || CAST(p_partkey AS STRING) AS card_number,
       1 + p_size % 3 AS version,
       CASE WHEN p_size % 6 = 0 THEN 'draft' WHEN p_size % 6 = 1 THEN 'archived' ELSE 'active' END AS status_code,
       DATE '1994-06-01' + p_size * 10 AS effective_from,
       CASE WHEN p_size % 4 = 0 THEN DATE '1999-06-01' + p_size * 10 END AS effective_to,
       p_size + 20 AS baking_time_min,
       CAST(200 + p_size AS DECIMAL(5,2)) AS baking_temperature_c,
       'Mix, proof and bake' AS process_description,
       CASE WHEN p_size % 7 <> 0 THEN p_partkey % 150 END AS approved_by_user_id
FROM {part}"""

# Three materials per card; the third has an empty or absent stage.
BINDINGS["recipe_items"] = """
SELECT p_partkey * 3 + slot AS recipe_item_id,
       p_partkey AS tech_card_id,
       (p_partkey + step) % (SELECT count(*) FROM {part}) AS material_id,
       CAST((p_size % 7 + slot + 1) * 0.010 AS DECIMAL(12,3)) AS quantity,
       'kg' AS unit,
       CASE WHEN slot = 0 THEN 'mixing' WHEN slot = 1 THEN 'filling' WHEN p_size > 25 THEN '' END AS stage,
       CASE WHEN p_size % 9 <> 0 THEN CAST(p_size % 4 * 0.50 AS DECIMAL(5,2)) END AS waste_percent,
       CAST(NULL AS STRING) AS note
FROM (SELECT p_partkey, p_size, 0 AS slot, 1 AS step FROM {part}
      UNION ALL SELECT p_partkey, p_size, 1 AS slot, 7 AS step FROM {part}
      UNION ALL SELECT p_partkey, p_size, 2 AS slot, 13 AS step FROM {part}) AS s"""

BINDINGS["customer_orders"] = """
SELECT o_orderkey AS order_id,
       'ORD-' || CAST(o_orderkey AS STRING) AS order_number,
       o_custkey AS customer_id,
       o_orderdate AS order_date,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) + 2
            WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_orderdate AS DATE) + 14 END AS planned_shipment_date,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'shipped'
            WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'in_production'
            WHEN o_orderstatus = 'P' THEN 'ready'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'draft'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'cancelled'
            ELSE 'confirmed' END AS status_code,
       o_custkey % 200 AS created_by_user_id,
       CAST(NULL AS STRING) AS comment
FROM {orders}"""

BINDINGS["order_items"] = f"""
SELECT {_LINE_ID} AS order_item_id,
       l_orderkey AS order_id,
       l_partkey AS product_id,
       {_QTY} AS quantity,
       {_UNIT_PRICE} AS unit_price,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS line_amount
FROM {{lineitem}}"""

BINDINGS["production_batches"] = f"""
SELECT o_orderkey AS production_batch_id,
       'PB-' || CAST(o_orderkey AS STRING) AS batch_number,
       l.product_id,
       l.product_id AS tech_card_id,
       o_orderdate AS production_date,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'night' WHEN o_orderpriority <> '5-LOW' THEN 'morning' END AS shift,
       l.quantity AS quantity_produced,
       CAST(l.quantity % 7 AS DECIMAL(12,3)) AS quantity_defective,
       o_custkey % 200 AS responsible_user_id,
       CASE WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'in_progress'
            WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled'
            WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'rejected'
            ELSE 'planned' END AS status_code,
       CAST(NULL AS STRING) AS note
FROM {{orders}}
JOIN (SELECT l_orderkey, min(l_partkey) AS product_id, CAST(sum({_QTY}) AS DECIMAL(12,3)) AS quantity
      FROM {{lineitem}} GROUP BY l_orderkey) AS l ON l.l_orderkey = o_orderkey"""

BINDINGS["finished_goods_stock"] = """
SELECT b.production_batch_id AS finished_stock_id,
       b.product_id,
       b.production_batch_id,
       b.batch_number,
       CASE WHEN b.shift = 'night' THEN CAST(0 AS DECIMAL(12,3))
            ELSE CAST(b.quantity_produced - b.quantity_defective AS DECIMAL(12,3)) END AS quantity_current,
       CAST(b.production_date AS DATE) AS production_date,
       CAST(b.production_date AS DATE) + p.shelf_life_days AS expiry_date,
       b.production_date AS updated_at
FROM {production_batches} AS b
JOIN {products} AS p ON p.product_id = b.product_id
WHERE b.status_code = 'completed' AND b.quantity_produced > b.quantity_defective"""

BINDINGS["quality_checks"] = f"""
SELECT 'L' || line_id AS quality_check_id, 'raw_material' AS check_type, line_id AS delivery_item_id,
       CAST(NULL AS BIGINT) AS production_batch_id, l_shipdate AS checked_at, l_suppkey % 150 AS inspector_user_id,
       CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'conditional' END AS result_code,
       'QC-L' || line_id AS document_number
FROM (SELECT {_LINE_ID} AS line_id, * FROM {{lineitem}}) AS a
UNION ALL
SELECT 'B' || line_id, 'finished_product', CAST(NULL AS STRING),
       l_orderkey, l_shipdate, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey % 150 END,
       CASE WHEN l_returnflag = 'A' THEN 'passed' WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 'failed'
            ELSE 'conditional' END,
       CASE WHEN l_linenumber < 6 THEN 'QC-B' || line_id END
FROM (SELECT {_LINE_ID} AS line_id, * FROM {{lineitem}}) AS b
UNION ALL
SELECT 'R' || line_id, 'raw_material', line_id,
       CASE WHEN l_tax = 0 AND l_discount = 0 THEN l_orderkey END, l_shipdate, l_suppkey % 150,
       CASE WHEN l_tax >= 0.02 THEN 'passed' ELSE 'failed' END,
       CAST(NULL AS STRING)
FROM (SELECT {_LINE_ID} AS line_id, * FROM {{lineitem}}) AS c
WHERE l_returnflag = 'N'"""

# A cancelled invoice of a finished order has a paid replacement.
BINDINGS["invoices"] = """
SELECT o_orderkey * 2 AS invoice_id,
       'INV-' || CAST(o_orderkey * 2 AS STRING) AS invoice_number,
       o_orderkey AS order_id,
       CAST(o_orderdate AS DATE) AS issue_date,
       CAST(o_orderdate AS DATE) + 14 AS due_date,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 480000 THEN o_orderdate + INTERVAL '3' DAY END AS paid_at,
       CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'paid' WHEN '2-HIGH' THEN 'cancelled'
                            WHEN '5-LOW' THEN 'overdue' ELSE 'issued' END AS status_code
FROM {orders}
WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT o_orderkey * 2 + 1, 'INV-' || CAST(o_orderkey * 2 + 1 AS STRING), o_orderkey,
       CAST(o_orderdate AS DATE) + 1, CAST(NULL AS DATE), o_orderdate + INTERVAL '5' DAY,
       CAST(o_totalprice AS DECIMAL(12,2)), 'paid'
FROM {orders}
WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'"""

BINDINGS["supplier_invoices"] = """
SELECT delivery_id AS supplier_invoice_id,
       'SINV-' || CAST(delivery_id AS STRING) AS supplier_invoice_number,
       delivery_id,
       supplier_id,
       delivery_date AS issue_date,
       CASE WHEN supplier_id % 3 <> 0 THEN delivery_date + 7 END AS due_date,
       CASE WHEN supplier_id % 2 = 0 THEN CAST(delivery_date + 3 AS TIMESTAMP_NTZ) END AS paid_at,
       total_amount AS amount,
       CASE WHEN supplier_id % 2 = 0 THEN 'paid' WHEN supplier_id % 5 = 0 THEN 'overdue' ELSE 'issued' END AS status_code
FROM {raw_material_deliveries}
WHERE status_code = 'accepted' AND document_ref <> ' '"""

BINDINGS["shipments"] = """
SELECT o_orderkey AS shipment_id,
       'SHP-' || CAST(o_orderkey AS STRING) AS shipment_number,
       o_orderkey AS order_id,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN l.shipped_at END AS shipped_at,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'planned'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled'
            WHEN l.open_lines > 0 THEN 'shipped' ELSE 'delivered' END AS status_code,
       'Customer ' || CAST(o_custkey AS STRING) AS delivery_address,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'WB-' || CAST(o_orderkey AS STRING) END AS waybill_number,
       o_custkey % 200 AS created_by_user_id,
       CAST(NULL AS STRING) AS note
FROM {orders}
JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped_at, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines
      FROM {lineitem} GROUP BY l_orderkey) AS l ON l.l_orderkey = o_orderkey"""

BINDINGS["shipment_items"] = f"""
SELECT 'S' || {_LINE_ID} AS shipment_item_id,
       l_orderkey AS shipment_id,
       {_LINE_ID} AS order_item_id,
       l_partkey AS product_id,
       CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS finished_stock_id,
       CASE WHEN l_tax >= 0.07 AND l_quantity > 1 THEN CAST({_QTY} - 1 AS DECIMAL(12,3)) ELSE {_QTY} END AS quantity
FROM {{lineitem}}
WHERE l_linestatus = 'F'"""

# --------------------------------------------------------------------------
# Requests: batches of user input, derived from the same files.
# --------------------------------------------------------------------------

BINDINGS["order_status_requests"] = """
SELECT o_orderkey AS order_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'shipped' WHEN '2-HIGH' THEN 'completed'
                            WHEN '3-MEDIUM' THEN 'in_production' WHEN '4-NOT SPECIFIED' THEN 'confirmed'
                            ELSE 'ready' END AS new_status,
       CASE WHEN o_custkey % 3 = 0 THEN 'technologist' WHEN o_custkey % 7 = 0 THEN 'client' ELSE 'admin' END AS role_code
FROM {orders}"""

BINDINGS["shipment_status_requests"] = """
SELECT o_orderkey AS shipment_id,
       CASE o_orderstatus WHEN 'O' THEN 'delivered' WHEN 'P' THEN 'shipped' ELSE 'cancelled' END AS new_status
FROM {orders}"""

BINDINGS["delivery_status_requests"] = """
SELECT o_orderkey AS delivery_id,
       CASE WHEN o_custkey % 4 = 0 THEN 'received' WHEN o_custkey % 4 = 1 THEN 'cancelled' ELSE 'accepted' END AS new_status,
       o_custkey % 200 AS user_id
FROM {orders}"""

BINDINGS["production_status_requests"] = """
SELECT o_orderkey AS production_batch_id,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 5 <> 0 THEN 'completed'
            WHEN o_custkey % 5 = 0 THEN 'cancelled' ELSE 'in_progress' END AS new_status
FROM {orders}"""

BINDINGS["invoice_payments"] = """
SELECT invoice_id, CASE WHEN o.customer_id % 6 = 0 THEN o.customer_id + 1 ELSE o.customer_id END AS customer_id
FROM {invoices} AS i JOIN {customer_orders} AS o ON o.order_id = i.order_id"""

BINDINGS["tech_card_status_requests"] = """
SELECT p_partkey AS tech_card_id, CASE WHEN p_size % 5 = 0 THEN 'archived' ELSE 'active' END AS new_status
FROM {part}"""

BINDINGS["delivery_line_requests"] = f"""
SELECT {_LINE_ID} AS request_id,
       l_orderkey AS delivery_id,
       l_partkey AS material_id,
       CAST(CASE WHEN l_discount = 0.1 THEN 0 ELSE {_QTY} END AS DECIMAL(12,3)) AS quantity,
       CAST(NULL AS STRING) AS batch_number,
       CAST(l_shipdate AS DATE) AS expiry_date
FROM {{lineitem}}"""

BINDINGS["order_line_requests"] = f"""
SELECT {_LINE_ID} AS request_id, l_orderkey AS order_id, l_partkey AS product_id, {_QTY} AS quantity
FROM {{lineitem}}"""

BINDINGS["shipment_requests"] = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_custkey % 4 = 0 THEN o_orderdate - INTERVAL '1' DAY
            WHEN o_custkey % 4 <> 1 THEN o_orderdate + INTERVAL '2' DAY END AS shipped_at,
       'Customer ' || CAST(o_custkey AS STRING) AS delivery_address
FROM {orders}"""

BINDINGS["shipment_line_requests"] = f"""
SELECT {_LINE_ID} AS request_id,
       l_orderkey AS shipment_id,
       {_LINE_ID} AS order_item_id,
       f.finished_stock_id,
       {_QTY} AS quantity
FROM {{lineitem}}
LEFT JOIN (SELECT product_id, max(finished_stock_id) AS finished_stock_id FROM {{finished_goods_stock}}
           GROUP BY product_id) AS f ON f.product_id = l_partkey"""

# Text as a form would send it: padded, empty, or not a number or date at all.
BINDINGS["raw_forms"] = f"""
SELECT {_LINE_ID} AS form_id,
       CASE WHEN l_linenumber = 1 THEN '  ' WHEN l_linenumber = 2 THEN 'n/a'
            ELSE ' ' || CAST(l_partkey AS STRING) || ' ' END AS product_id,
       CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN '1,5'
            ELSE CAST({_QTY} AS STRING) END AS quantity,
       CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN '31.12.1999' WHEN l_linenumber = 4 THEN ''
            ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS expiry_date,
       CASE WHEN l_linenumber = 5 THEN 'soon' WHEN l_linenumber = 6 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) || ' 08:30'
            ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T16:05' END AS checked_at,
       CASE WHEN l_tax >= 0.04 THEN 'On' ELSE 'off' END AS is_active
FROM {{lineitem}}"""

_NAME = re.compile(r"\{(\w+)\}")


def driver_tables(spark: SparkSession, folder: str) -> Tables:
    """The bindings over the Parquet files in ``folder``."""

    def file_reader(name: str):
        return lambda: spark.read.parquet(f"{folder}/{name}.parquet")

    def bound(name: str):
        def build() -> DataFrame:
            sql = BINDINGS[name]
            return spark.sql(sql, **{used: tables[used] for used in sorted(set(_NAME.findall(sql)))})

        return build

    tables = Tables({**{n: file_reader(n) for n in FILES}, **{n: bound(n) for n in BINDINGS}})
    return tables


def check_sql(body: str) -> str:
    """``body`` with a WITH clause for every binding it reads, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in BINDINGS and name not in needed:
                visit(BINDINGS[name])
                needed.append(name)

    visit(body)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text).replace("TIMESTAMP_NTZ", "TIMESTAMP").strip()

    if not needed:
        return plain(body)
    clauses = ",\n".join(f"{name} AS (\n{plain(BINDINGS[name])}\n)" for name in needed)
    text = plain(body)
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {clauses},\n{text[len('WITH RECURSIVE'):].strip()}"
    if text.upper().startswith("WITH "):
        return f"WITH {clauses},\n{text[len('WITH '):].strip()}"
    return f"WITH {clauses}\n{text}"
