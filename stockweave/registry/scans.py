"""Reading, writing, projections, filters, sorts and plain aggregates."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from stockweave.functions.inet import parse_inet
from stockweave.functions.labels import display_flag, translate_code
from stockweave.functions.ordering import asc, desc
from stockweave.functions.parsing import FormField, parse_form_batch
from stockweave.functions.scalars import (
    customer_label,
    days_left,
    display_name,
    document_number,
    expiry_class,
    in_days,
    label,
    line_amount,
    markup,
    same_text,
)
from stockweave.operators.reports import low_stock
from stockweave.registry.base import AS_OF, NOW, query
from stockweave.schemas import LOAD_ORDER
from stockweave.session import shared_folder
from stockweave.sources.driver import BINDINGS
from stockweave.sources.sinks import append, insert_ignore, load_in_order, with_defaults
from stockweave.sources.tables import (
    Tables,
    publish_snapshot,
    read_snapshot,
    read_tables,
    row_counts,
    scan_by_key,
    scan_table,
    snapshot_check,
)


def _fresh_folder(t: Tables) -> str:
    return f"{shared_folder(t['lineitem'].sparkSession)}/{uuid.uuid4().hex}"


@query("s1_scan_table", "SELECT supplier_id, company_name, contact_person, phone, email, is_active FROM {suppliers}")
def scan_suppliers(t):
    return scan_table(
        t, "suppliers", ["supplier_id", "company_name", "contact_person", "phone", "email", "is_active"]
    )


@query("s2_scan_by_key", "SELECT * FROM {customer_orders} WHERE order_id = 42")
def scan_one_order(t):
    return scan_by_key(t, "customer_orders", order_id=42)


#: All tables that the supplied files are bound to.
BOUND = [name for name in LOAD_ORDER if name in BINDINGS]


@query(
    "s4_load_order",
    "\nUNION ALL\n".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {{{n}}}" for n in BOUND),
)
def load_all_tables(t):
    folder = _fresh_folder(t)
    load_in_order({n: t[n] for n in BOUND}, folder)
    return row_counts(read_tables(t["lineitem"].sparkSession, folder, BOUND, declared=False), BOUND)


@query(
    "s5_sink_append",
    """
SELECT product_id, name, unit, price, shelf_life_days, TRUE AS is_active, TIMESTAMP '1998-01-15 12:00:00' AS created_at
FROM {products}""",
    decimals="price",
)
def append_products(t):
    new = t["products"].select("product_id", "name", "unit", "price", "shelf_life_days")
    folder = _fresh_folder(t)
    append(with_defaults(new, "products", AS_OF, NOW), folder, "products")
    stored = t["lineitem"].sparkSession.read.parquet(f"{folder}/products")
    return stored.select(
        "product_id",
        "name",
        "unit",
        "price",
        "shelf_life_days",
        "is_active",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "s6_sink_insert_ignore",
    """
SELECT supplier_id, material_id, min(purchase_price) AS purchase_price
FROM {supplier_materials} AS n
WHERE NOT EXISTS (SELECT 1 FROM {delivery_items} AS i JOIN {raw_material_deliveries} AS d ON d.delivery_id = i.delivery_id
                  WHERE d.supplier_id = n.supplier_id AND i.material_id = n.material_id)
GROUP BY supplier_id, material_id""",
    decimals="purchase_price",
)
def insert_missing_offers(t):
    known = (
        t["delivery_items"]
        .select("delivery_id", "material_id")
        .join(t["raw_material_deliveries"].select("delivery_id", "supplier_id"), "delivery_id")
    )
    new = t["supplier_materials"].select("supplier_id", "material_id", "purchase_price")
    return insert_ignore(new, known, ["supplier_id", "material_id"])


@query("s7_table_snapshot", "SELECT * FROM {invoices}", decimals="amount")
def snapshot_and_restore(t):
    folder = _fresh_folder(t)
    publish_snapshot({n: t[n] for n in BOUND}, folder)
    return read_snapshot(t["lineitem"].sparkSession, folder)["invoices"]


@query(
    "s8_snapshot_check",
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, count(*) AS source_rows, count(*) AS restored_rows, TRUE AS matches FROM {{{n}}}"
        for n in BOUND
    ),
)
def check_snapshot(t):
    folder = _fresh_folder(t)
    publish_snapshot({n: t[n] for n in BOUND}, folder)
    return snapshot_check(t, read_snapshot(t["lineitem"].sparkSession, folder), BOUND)


@query(
    "p1_project_const",
    """
SELECT 'Позиция заказа' AS object_type, order_item_id, quantity, unit_price,
       quantity * unit_price AS calculated_line_amount, 'RUB' AS currency_code
FROM {order_items}""",
    decimals="quantity unit_price calculated_line_amount",
)
def order_lines_with_constants(t):
    return t["order_items"].select(
        F.lit("Позиция заказа").alias("object_type"),
        "order_item_id",
        "quantity",
        "unit_price",
        (F.col("quantity") * F.col("unit_price")).alias("calculated_line_amount"),
        F.lit("RUB").alias("currency_code"),
    )


@query(
    "p2_line_amount",
    """
SELECT order_item_id, CAST(round(quantity * unit_price, 2) AS DECIMAL(12,2)) AS stored_amount
FROM {order_items}""",
    decimals="stored_amount",
)
def stored_line_amounts(t):
    return t["order_items"].select(
        "order_item_id", line_amount(F.col("quantity"), F.col("unit_price")).alias("stored_amount")
    )


@query(
    "p3_price_markup",
    """
SELECT product_id, name, price, round(price * 1.10, 2) AS price_with_markup, price * 1.10 AS price_unrounded
FROM {products}""",
    decimals="price price_with_markup price_unrounded",
)
def product_markup(t):
    return t["products"].select(
        "product_id",
        "name",
        "price",
        F.round(markup(F.col("price")), 2).alias("price_with_markup"),
        markup(F.col("price")).alias("price_unrounded"),
    )


@query(
    "p4_vat_estimate",
    "SELECT invoice_id, invoice_number, amount, amount * 0.20 AS vat_estimate, 'RUB' AS currency_code FROM {invoices}",
    decimals="amount vat_estimate",
)
def invoice_vat(t):
    return t["invoices"].select(
        "invoice_id",
        "invoice_number",
        "amount",
        markup(F.col("amount"), "0.20").alias("vat_estimate"),
        F.lit("RUB").alias("currency_code"),
    )


@query("p5_display_name", "SELECT customer_id, coalesce(company_name, full_name) AS display_name FROM {customers}")
def customer_display_names(t):
    return t["customers"].select("customer_id", display_name().alias("display_name"))


@query(
    "p6_doc_label",
    """
SELECT stock_id,
       m.name || ' / ' || s.batch_number || ' / ' || CAST(s.expiry_date AS VARCHAR) AS lot_label,
       m.name || ' / ' || coalesce(s.batch_number, 'без партии') AS short_label
FROM {raw_material_stock} AS s JOIN {raw_materials} AS m ON m.material_id = s.material_id""",
)
def lot_labels(t):
    materials = t["raw_materials"].select("material_id", "name")
    batch = F.col("batch_number")
    return t["raw_material_stock"].join(materials, "material_id").select(
        "stock_id",
        label(F.col("name"), batch, F.col("expiry_date")).alias("lot_label"),
        label(F.col("name"), F.coalesce(batch, F.lit("без партии"))).alias("short_label"),
    )


@query(
    "p7_customer_label",
    """
SELECT customer_id,
       concat(upper(coalesce(company_name, full_name)), ' / ', lower(coalesce(email, 'no-email'))) AS customer_label,
       length(coalesce(delivery_address, '')) AS address_length,
       DATE '1998-01-15' AS check_date
FROM {customers}""",
)
def customer_labels(t):
    return t["customers"].select(
        "customer_id",
        customer_label().alias("customer_label"),
        F.length(F.coalesce("delivery_address", F.lit(""))).alias("address_length"),
        F.lit(AS_OF).alias("check_date"),
    )


@query(
    "o1_mixed_sort",
    "SELECT product_id, name, category, price FROM {products} ORDER BY category ASC, price DESC, name ASC",
    decimals="price",
)
def products_sorted(t):
    return t["products"].select("product_id", "name", "category", "price").orderBy(
        asc("category"), desc("price"), asc("name")
    )


@query(
    "o2_nulls_last",
    "SELECT shipment_id, shipment_number, shipped_at, status_code FROM {shipments} ORDER BY shipped_at NULLS LAST, shipment_number",
)
def shipments_sorted(t):
    return t["shipments"].select("shipment_id", "shipment_number", "shipped_at", "status_code").orderBy(
        asc("shipped_at"), asc("shipment_number")
    )


@query("a1_count_active", "SELECT count(*) AS active_customers_count FROM {customers} WHERE is_active")
def active_customer_count(t):
    return t["customers"].filter("is_active").agg(F.count("*").alias("active_customers_count"))


@query("a12_distinct_categories", "SELECT DISTINCT category FROM {products} WHERE category IS NOT NULL")
def categories(t):
    return t["products"].filter(F.col("category").isNotNull()).select("category").distinct()


@query(
    "a12_distinct_pairs",
    "SELECT DISTINCT supplier_id, material_id FROM {supplier_materials} WHERE is_active",
)
def active_offers(t):
    return t["supplier_materials"].filter("is_active").select("supplier_id", "material_id").distinct()


@query(
    "a14_low_stock_count",
    """
SELECT count(*) AS low_stock_material_count
FROM (SELECT m.material_id FROM {raw_materials} AS m
      LEFT JOIN {raw_material_stock} AS s ON s.material_id = m.material_id
      GROUP BY m.material_id, m.min_stock_qty
      HAVING coalesce(sum(s.quantity_current), 0) < m.min_stock_qty) AS low""",
)
def low_stock_count(t):
    return low_stock(t).agg(F.count("*").alias("low_stock_material_count"))


@query(
    "a16_max_ids",
    """
SELECT 'customers' AS table_name, max(customer_id) AS last_id FROM {customers}
UNION ALL SELECT 'customer_orders', max(order_id) FROM {customer_orders}
UNION ALL SELECT 'invoices', max(invoice_id) FROM {invoices}
UNION ALL SELECT 'audit_log', max(audit_id) FROM {audit_log}""",
)
def last_ids(t):
    keys = {"customers": "customer_id", "customer_orders": "order_id", "invoices": "invoice_id", "audit_log": "audit_id"}
    parts = [t[n].agg(F.max(k).alias("last_id")).select(F.lit(n).alias("table_name"), "last_id") for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "f3_orders_of_period",
    "SELECT order_id, order_date FROM {customer_orders} WHERE CAST(order_date AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'",
)
def january_orders(t):
    return t["customer_orders"].filter(in_days(F.col("order_date"), date(1998, 1, 1), date(1998, 1, 31))).select(
        "order_id", "order_date"
    )


@query(
    "f8_same_stage",
    """
SELECT recipe_item_id, stage FROM {recipe_items} WHERE coalesce(stage, '') = coalesce(NULL, '')""",
)
def recipe_lines_without_stage(t):
    return t["recipe_items"].filter(same_text(F.col("stage"), F.lit(None))).select("recipe_item_id", "stage")


@query(
    "x1_scalar_functions",
    """
SELECT order_item_id,
       nullif(trim(' ' || order_item_id || ' '), '') AS trimmed,
       'ORD-WEB-' || CASE WHEN order_id < 10000 THEN lpad(CAST(order_id AS VARCHAR), 4, '0')
                          ELSE CAST(order_id AS VARCHAR) END AS document_number,
       round(quantity / 3, 3) AS third
FROM {order_items}""",
    decimals="third",
)
def scalar_functions(t):
    return t["order_items"].select(
        "order_item_id",
        F.nullif(F.btrim(F.concat(F.lit(" "), "order_item_id", F.lit(" "))), F.lit("")).alias("trimmed"),
        document_number("ORD-WEB-", F.col("order_id")).alias("document_number"),
        F.round(F.col("quantity").cast("double") / 3, 3).alias("third"),
    )


@query(
    "x2_expiry_class",
    """
SELECT stock_id, date_diff('day', DATE '1998-01-15', expiry_date) AS days_left,
       CASE WHEN expiry_date < DATE '1998-01-15' THEN 'expired'
            WHEN expiry_date <= DATE '1998-01-22' THEN 'expiring' ELSE 'ok' END AS expiry_class
FROM {raw_material_stock}""",
)
def expiry_classes(t):
    return t["raw_material_stock"].select(
        "stock_id",
        days_left(F.col("expiry_date"), AS_OF).cast("bigint").alias("days_left"),
        expiry_class(F.col("expiry_date"), AS_OF).alias("expiry_class"),
    )


@query(
    "x3_inet_parse",
    """
WITH a AS (
  SELECT changed_at, user_id, ip_address, string_split(ip_address, '.') AS p FROM {audit_log}
), f AS (
  SELECT unnest([1, 2, 3, 4]) AS form
), v AS (
  SELECT *, '00000000000000000000ffff' || printf('%02x%02x%02x%02x', CAST(p[1] AS INT), CAST(p[2] AS INT), CAST(p[3] AS INT),
                                                 CAST(p[4] AS INT)) AS x FROM a CROSS JOIN f
)
SELECT changed_at, user_id,
       CASE form WHEN 1 THEN ip_address WHEN 2 THEN '::FFFF:' || ip_address WHEN 3 THEN ip_address || '/24' ELSE ip_address || '/x' END AS address,
       CASE form WHEN 2 THEN 6 WHEN 4 THEN NULL ELSE 4 END AS family, CASE WHEN form < 4 THEN x END AS value,
       CASE form WHEN 1 THEN 32 WHEN 2 THEN 128 WHEN 3 THEN 24 END AS prefix,
       CASE WHEN form = 4 THEN 'prefix_out_of_range' END AS reason
FROM v""",
)
def inet_values(t):
    ip = F.col("ip_address")
    forms = F.array(ip, F.concat(F.lit("::FFFF:"), ip), F.concat(ip, F.lit("/24")), F.concat(ip, F.lit("/x")))
    texts = t["audit_log"].select("changed_at", "user_id", F.explode(forms).alias("address"))
    return texts.select("*", parse_inet(F.col("address")).alias("parsed")).select(
        "changed_at", "user_id", "address", "parsed.*"
    )


@query(
    "c1_parse_form_batch",
    r"""
WITH cleaned AS (
  SELECT form_id, nullif(trim(product_id), '') AS p, nullif(trim(quantity), '') AS q,
         nullif(trim(expiry_date), '') AS e, nullif(trim(checked_at), '') AS c, lower(is_active) AS a
  FROM {raw_forms}),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(p, '[+-]?[0-9]+') THEN CAST(p AS BIGINT) END AS pv,
         TRY_CAST(q AS DECIMAL(38,10)) AS qv,
         CAST(try_strptime(e, '%Y-%m-%d') AS DATE) AS ev,
         coalesce(try_strptime(c, '%Y-%m-%dT%H:%M'), try_strptime(c, '%Y-%m-%d %H:%M')) AS cv
  FROM cleaned)
SELECT form_id, pv AS product_id, qv AS quantity, ev AS expiry_date, cv AS checked_at,
       coalesce(a IN ('on', 'true', '1', 'yes'), FALSE) AS is_active,
       concat_ws(', ',
         CASE WHEN p IS NULL THEN 'product_id:required' WHEN pv IS NULL THEN 'product_id:not_an_integer' END,
         CASE WHEN q IS NULL THEN 'quantity:required' WHEN qv IS NULL THEN 'quantity:not_a_number' END,
         CASE WHEN e IS NOT NULL AND ev IS NULL THEN 'expiry_date:not_a_date' END,
         CASE WHEN c IS NULL THEN 'checked_at:required' WHEN cv IS NULL THEN 'checked_at:not_a_datetime' END) AS errors
FROM parsed""",
    decimals="quantity",
)
def parse_forms(t):
    fields = [
        FormField("product_id", "int", required=True),
        FormField("quantity", "decimal", required=True),
        FormField("expiry_date", "date"),
        FormField("checked_at", "datetime", required=True),
        FormField("is_active", "bool"),
    ]
    return parse_form_batch(t["raw_forms"], fields).withColumn("errors", F.array_join("errors", ", "))


_STATUS_LABEL = """CASE status_code WHEN 'draft' THEN 'Черновик' WHEN 'confirmed' THEN 'Подтверждён'
       WHEN 'in_production' THEN 'В производстве' WHEN 'ready' THEN 'Готов' WHEN 'shipped' THEN 'Отгружен'
       WHEN 'completed' THEN 'Завершён' WHEN 'cancelled' THEN 'Отменён' END"""


@query(
    "c2_translate_codes",
    f"""
SELECT order_id, {_STATUS_LABEL} AS status_label,
       {_STATUS_LABEL} || ', Да будет' AS list_label,
       coalesce(CAST(planned_shipment_date AS VARCHAR), '—') AS planned_label,
       CASE WHEN created_by_user_id = 0 THEN 'Да' ELSE 'Нет' END AS flag_label
FROM {{customer_orders}}""",
)
def translate_order_codes(t):
    return t["customer_orders"].select(
        "order_id",
        translate_code(F.col("status_code")).alias("status_label"),
        translate_code(F.concat("status_code", F.lit(", Да будет"))).alias("list_label"),
        translate_code(F.col("planned_shipment_date").cast("string")).alias("planned_label"),
        display_flag(F.col("created_by_user_id") == 0).alias("flag_label"),
    )
