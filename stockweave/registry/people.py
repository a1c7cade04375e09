"""Row policies, roles and the audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockweave.operators import audit, security
from stockweave.plans import stored_writes
from stockweave.registry.base import NOW, query
from stockweave.session import shared_folder
from stockweave.sources import stored

_ROLE_OF = """(SELECT DISTINCT ur.user_id, r.role_code FROM {user_roles} AS ur JOIN {roles} AS r ON r.role_id = ur.role_id)"""

_OWN_ORDERS = "SELECT o.order_id FROM {customer_orders} AS o JOIN {users} AS u ON u.customer_id = o.customer_id AND u.user_id = 12"

query("rs1_row_policy", "SELECT * FROM {customer_orders} WHERE order_id IN (" + _OWN_ORDERS + ")")(
    lambda t: security.row_policy(t, "customer_orders", "client", 12)
)

query(
    "rs1_row_policy_invoices",
    "SELECT * FROM {invoices} WHERE order_id IN (" + _OWN_ORDERS + ")",
    decimals="amount",
)(lambda t: security.row_policy(t, "invoices", "client", 12))

query(
    "rs1_row_policy_shipment_items",
    "SELECT * FROM {shipment_items} WHERE shipment_id IN (SELECT shipment_id FROM {shipments} WHERE order_id IN ("
    + _OWN_ORDERS
    + "))",
    decimals="quantity",
)(lambda t: security.row_policy(t, "shipment_items", "client", 12))

query("rs1_row_policy_staff", "SELECT * FROM {shipments}")(
    lambda t: security.row_policy(t, "shipments", "warehouse_worker", 3)
)

query("rs1_row_policy_denied", "SELECT * FROM {invoices} WHERE FALSE", decimals="amount")(
    lambda t: security.row_policy(t, "invoices", "technologist", 3)
)

query(
    "rs1_visible_rows",
    """
SELECT u.user_id, count(*) AS visible_items
FROM {users} AS u
JOIN {customer_orders} AS o ON o.customer_id = u.customer_id
JOIN {order_items} AS i ON i.order_id = o.order_id
GROUP BY u.user_id""",
)(
    lambda t: security.visible_rows(t, "order_items", t["users"])
    .groupBy("user_id")
    .agg(F.count("*").alias("visible_items"))
)

query("rs2_own_rows_filter", "SELECT * FROM {customer_orders} WHERE customer_id = 7")(
    lambda t: security.own_rows(t["customer_orders"], 7)
)


def _grant_values() -> str:
    """The granted (role, table, privileges) rows as SQL values."""
    from stockweave.operators.security import READ_GRANTS, WRITE_GRANTS
    from stockweave.schemas import LAYOUTS

    rows = [f"('admin', '{n}', TRUE, TRUE, TRUE, TRUE)" for n in LAYOUTS]
    for role, readable in READ_GRANTS.items():
        writable = WRITE_GRANTS.get(role, ())
        for n in sorted({*readable, *writable}):
            r, w = str(n in readable).upper(), str(n in writable).upper()
            rows.append(f"('{role}', '{n}', {r}, {w}, {w}, FALSE)")
    return ",\n".join(rows)


query(
    "u1_grants_matrix",
    f"""
SELECT coalesce(g.role_code, s.role_code) AS role_code, coalesce(g.object_name, s.object_name) AS object_name,
       g.can_select AS granted_select, g.can_insert AS granted_insert, g.can_update AS granted_update, g.can_delete AS granted_delete,
       s.can_select AS stored_select, s.can_insert AS stored_insert, s.can_update AS stored_update, s.can_delete AS stored_delete,
       g.can_select IS NOT DISTINCT FROM s.can_select AND g.can_insert IS NOT DISTINCT FROM s.can_insert
         AND g.can_update IS NOT DISTINCT FROM s.can_update AND g.can_delete IS NOT DISTINCT FROM s.can_delete AS agrees,
       (SELECT count(*) FROM {_ROLE_OF} AS h WHERE h.role_code = coalesce(g.role_code, s.role_code)) AS user_count
FROM (VALUES {_grant_values()}) AS g(role_code, object_name, can_select, can_insert, can_update, can_delete)
FULL JOIN (SELECT r.role_code, p.* FROM {{role_permissions}} AS p JOIN {{roles}} AS r ON r.role_id = p.role_id) AS s
  ON s.role_code = g.role_code AND s.object_name = g.object_name""",
)(security.grants_matrix)

_PRIORITY = """CASE role_code WHEN 'admin' THEN 0 WHEN 'technologist' THEN 1 WHEN 'warehouse_worker' THEN 2
               WHEN 'quality_control' THEN 3 ELSE 4 END"""

query(
    "u2_primary_role",
    f"""
SELECT u.user_id, u.username,
       (SELECT role_code FROM {_ROLE_OF} AS h WHERE h.user_id = u.user_id ORDER BY {_PRIORITY} LIMIT 1) AS primary_role
FROM {{users}} AS u""",
)(security.primary_role)


def _rule_values(rules) -> str:
    return ", ".join(f"('{rule}', '{role}')" for rule, roles in rules.items() for role in roles)


query(
    "u3_can_access",
    f"""
WITH rules(section, role_code) AS (VALUES {_rule_values(security.SECTION_ROLES)})
SELECT DISTINCT h.user_id, r.section FROM {_ROLE_OF} AS h JOIN rules AS r ON r.role_code = h.role_code OR h.role_code = 'admin'""",
)(security.can_access)

query(
    "u3_has_action",
    f"""
WITH rules(action, role_code) AS (VALUES {_rule_values(security.ACTION_ROLES)})
SELECT DISTINCT h.user_id, r.action FROM {_ROLE_OF} AS h JOIN rules AS r ON r.role_code = h.role_code OR h.role_code = 'admin'""",
)(security.has_action)

query(
    "u4_load_user",
    f"""
SELECT u.*, coalesce((SELECT string_agg(role_code, ',' ORDER BY role_code) FROM {_ROLE_OF} AS h
                      WHERE h.user_id = u.user_id), '') AS roles,
       (SELECT role_code FROM {_ROLE_OF} AS h WHERE h.user_id = u.user_id ORDER BY {_PRIORITY} LIMIT 1) AS primary_role
FROM {{users}} AS u""",
)(lambda t: security.load_users(t).withColumn("roles", F.array_join("roles", ",")))


def _changed_orders(t):
    """Orders after a day's work: late ones dropped, urgent ones moved on, and new ones added."""
    orders = t["customer_orders"]
    kept = orders.filter(F.col("order_date") < F.lit("2001-06-01").cast("timestamp_ntz")).withColumn(
        "status_code", F.when(F.col("status_code") == "draft", F.lit("confirmed")).otherwise(F.col("status_code"))
    )
    added = orders.filter(F.col("status_code") == "ready").withColumn("order_id", -F.col("order_id") - 1)
    return kept.unionByName(added)


query(
    "au1_audit_diff",
    """
WITH new_orders AS (
  SELECT order_id, CASE WHEN status_code = 'draft' THEN 'confirmed' ELSE status_code END AS status_code
  FROM {customer_orders} WHERE order_date < TIMESTAMP '2001-06-01'
  UNION ALL SELECT -order_id - 1, status_code FROM {customer_orders} WHERE status_code = 'ready')
SELECT CASE WHEN o.order_id IS NULL THEN 'INSERT' WHEN n.order_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action_type,
       'customer_orders' AS table_name, 'order_id=' || CAST(coalesce(n.order_id, o.order_id) AS VARCHAR) AS record_id,
       o.status_code AS old_status, n.status_code AS new_status, TIMESTAMP '1998-01-15 12:00:00' AS changed_at,
       CAST(1 AS BIGINT) AS user_id, '10.0.0.1' AS ip_address, TRUE AS success
FROM {customer_orders} AS o FULL JOIN new_orders AS n ON n.order_id = o.order_id
WHERE o.order_id IS NULL OR n.order_id IS NULL OR o.status_code <> n.status_code""",
)(
    lambda t: audit.audit_diff(
        t["customer_orders"], _changed_orders(t), ["order_id"], "customer_orders", NOW, 1, "10.0.0.1"
    ).select(
        "action_type",
        "table_name",
        "record_id",
        F.get_json_object("old_data", "$.status_code").alias("old_status"),
        F.get_json_object("new_data", "$.status_code").alias("new_status"),
        F.col("changed_at").cast("timestamp_ntz").alias("changed_at"),
        "user_id",
        "ip_address",
        "success",
    )
)


@query(
    "au1_audit_versions",
    """
SELECT CASE n WHEN 1 THEN 'UPDATE' ELSE 'INSERT' END AS action_type, 'customer_orders' AS table_name,
       'order_id=' || CAST(CASE n WHEN 1 THEN order_id ELSE -order_id - 1 END AS VARCHAR) AS record_id,
       CASE n WHEN 1 THEN status_code END AS old_status, CASE n WHEN 1 THEN 'confirmed' ELSE status_code END AS new_status,
       TIMESTAMP '1998-01-15 12:00:00' AS changed_at
FROM {customer_orders} CROSS JOIN (SELECT unnest([1, 2]) AS n) AS kinds
WHERE CASE n WHEN 1 THEN status_code = 'draft' ELSE status_code = 'ready' END""",
)
def audit_stored_orders(t):
    orders = t["customer_orders"]
    spark = orders.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    old = stored.create(orders, folder, ["order_id"])
    confirmed = orders.filter(F.col("status_code") == "draft").withColumn("status_code", F.lit("confirmed"))
    copied = orders.filter(F.col("status_code") == "ready").withColumn("order_id", -F.col("order_id") - 1)
    changes = confirmed.unionByName(copied).withColumn("sent", F.lit(1))
    new = stored_writes.upsert_stored(folder, changes, ["order_id"], "sent")
    return stored_writes.audit_versions(spark, folder, old, new, ["order_id"], "customer_orders", NOW).select(
        "action_type",
        "table_name",
        "record_id",
        F.get_json_object("old_data", "$.status_code").alias("old_status"),
        F.get_json_object("new_data", "$.status_code").alias("new_status"),
        F.col("changed_at").cast("timestamp_ntz").alias("changed_at"),
    )


_SIGN_INS = ["user_id", "action_type", "changed_at", "ip_address", "success"]

query(
    "au2_auth_events",
    """
SELECT user_id, action_type, 'users' AS table_name, 'user_id=' || CAST(user_id AS VARCHAR) AS record_id, changed_at,
       CAST(NULL AS VARCHAR) AS old_data, CAST(NULL AS VARCHAR) AS new_data, ip_address, success
FROM {audit_log} WHERE action_type IN ('LOGIN', 'LOGOUT')""",
)(lambda t: audit.auth_events(t["audit_log"].select(*_SIGN_INS))[0])

query(
    "au2_auth_rejects",
    """
SELECT user_id, action_type, changed_at, 'unsupported_action' AS reject_reason
FROM {audit_log} WHERE action_type NOT IN ('LOGIN', 'LOGOUT')""",
)(lambda t: audit.auth_events(t["audit_log"].select(*_SIGN_INS))[1])

query("au3_audit_filter_values", "SELECT DISTINCT table_name FROM {audit_log}")(
    lambda t: audit.audited_table_names(t["audit_log"])
)

query("au3_audit_users", "SELECT user_id, username FROM {users}")(lambda t: audit.audit_user_names(t["users"]))
