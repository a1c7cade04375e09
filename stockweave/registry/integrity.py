"""Integrity rules over the bound tables."""

from __future__ import annotations

from stockweave.integrity import RULES
from stockweave.operators import rules
from stockweave.registry.base import query
from stockweave.schemas import PRIMARY_KEYS, STATUSES
from stockweave.sources.driver import BINDINGS

_TABLES = [n for n in RULES if n in BINDINGS and n not in STATUSES]


def _key_text(columns, alias: str = "x") -> str:
    return " || ', ' || ".join(f"'{c}=' || coalesce(CAST({alias}.{c} AS VARCHAR), 'null')" for c in columns)


def _row_rule_sql(predicates_of) -> str:
    parts = [
        f"SELECT '{n}' AS table_name, '{rule}' AS rule, {_key_text(PRIMARY_KEYS[n])} AS record_id "
        f"FROM {{{n}}} AS x WHERE NOT coalesce(({sql}), TRUE)"
        for n in _TABLES
        for rule, sql in predicates_of(n).items()
    ]
    return "\nUNION ALL\n".join(parts)


query("v1_check_rules", _row_rule_sql(lambda n: RULES[n].row_checks()))(lambda t: rules.check_rules(t, _TABLES))

query(
    "v2_not_null_rules",
    _row_rule_sql(lambda n: {f"{c}_required": f"{c} IS NOT NULL" for c in RULES[n].required}),
)(lambda t: rules.not_null_rules(t, _TABLES))

query("v6_conditional_rules", _row_rule_sql(lambda n: RULES[n].conditional))(
    lambda t: rules.conditional_rules(t, _TABLES)
)

query(
    "v7_exclusive_reference",
    """
SELECT 'quality_checks' AS table_name, 'one_checked_object' AS rule, 'quality_check_id=' || quality_check_id AS record_id
FROM {quality_checks}
WHERE NOT ((check_type = 'raw_material' AND delivery_item_id IS NOT NULL AND production_batch_id IS NULL)
        OR (check_type = 'finished_product' AND production_batch_id IS NOT NULL AND delivery_item_id IS NULL))""",
)(lambda t: rules.conditional_rules(t, ["quality_checks"]))


def _unique_sql() -> str:
    parts = []
    for n in _TABLES:
        for rule in RULES[n].unique:
            conditions = [f"({rule.where})"] if rule.where else []
            if not rule.nulls_equal:
                conditions += [f"{c} IS NOT NULL" for c in rule.columns]
            where = f"WHERE {' AND '.join(conditions)} " if conditions else ""
            parts.append(
                f"SELECT '{n}' AS table_name, '{rule.name}' AS rule, {_key_text(rule.columns)} AS key_values, "
                f"count(*) AS row_count FROM {{{n}}} AS x {where}"
                f"GROUP BY {', '.join(f'x.{c}' for c in rule.columns)} HAVING count(*) > 1"
            )
    return "\nUNION ALL\n".join(parts)


query("v3_unique_rules", _unique_sql())(lambda t: rules.unique_rules(t, _TABLES))


def _reference_sql() -> str:
    parts = []
    for n in _TABLES:
        for rule in RULES[n].references:
            present = " AND ".join(f"x.{c} IS NOT NULL" for c in rule.columns)
            match = " AND ".join(f"p.{p} = x.{c}" for c, p in zip(rule.columns, rule.parent_columns))
            parts.append(
                f"SELECT '{n}' AS table_name, '{rule.name}' AS rule, {_key_text(PRIMARY_KEYS[n])} AS record_id "
                f"FROM {{{n}}} AS x WHERE {present} AND NOT EXISTS (SELECT 1 FROM {{{rule.parent}}} AS p WHERE {match})"
            )
    return "\nUNION ALL\n".join(parts)


query("v4_fk_rules", _reference_sql())(lambda t: rules.fk_rules(t, _TABLES))


def _restrict_sql(parent: str) -> str:
    parts = []
    for n in BINDINGS:
        if n not in RULES:
            continue
        for rule in RULES[n].references:
            if rule.parent == parent:
                match = " AND ".join(f"c.{c} = x.{p}" for c, p in zip(rule.columns, rule.parent_columns))
                parts.append(
                    f"SELECT '{parent}' AS table_name, {_key_text(PRIMARY_KEYS[parent])} AS record_id, "
                    f"'{n}.{rule.name}' AS held_by FROM {{{parent}}} AS x "
                    f"WHERE EXISTS (SELECT 1 FROM {{{n}}} AS c WHERE {match})"
                )
    return "\nUNION ALL\n".join(parts)


query("v5_delete_restrict", _restrict_sql("customer_orders"))(lambda t: rules.delete_restrict(t, "customer_orders"))

query("v5_delete_restrict_users", _restrict_sql("users"))(lambda t: rules.delete_restrict(t, "users"))

query(
    "v8_delivery_expiry",
    """
SELECT i.delivery_item_id, i.delivery_id, d.delivery_date, i.expiry_date,
       CASE WHEN d.delivery_date IS NULL THEN 'delivery_missing' ELSE 'expiry_not_after_delivery' END AS rule
FROM {delivery_items} AS i LEFT JOIN {raw_material_deliveries} AS d ON d.delivery_id = i.delivery_id
WHERE d.delivery_date IS NULL OR i.expiry_date <= d.delivery_date""",
)(rules.delivery_expiry)

query(
    "v9_shipment_dates",
    """
SELECT s.shipment_id, s.order_id, o.order_date, s.shipped_at,
       CASE WHEN o.order_date IS NULL THEN 'order_missing' ELSE 'shipped_before_order' END AS rule
FROM {shipments} AS s LEFT JOIN {customer_orders} AS o ON o.order_id = s.order_id
WHERE s.shipped_at IS NOT NULL AND (o.order_date IS NULL OR s.shipped_at < o.order_date)""",
)(rules.shipment_dates)


def _holder_sql(table: str, column: str, roles: str, required: bool) -> str:
    named = "TRUE" if required else f"x.{column} IS NOT NULL"
    return f"""
SELECT '{table}' AS table_name, {_key_text(PRIMARY_KEYS[table])} AS record_id, '{column}' AS user_column, x.{column} AS user_id
FROM {{{table}}} AS x
WHERE {named} AND NOT EXISTS (
  SELECT 1 FROM {{users}} AS u JOIN {{user_roles}} AS ur ON ur.user_id = u.user_id JOIN {{roles}} AS r ON r.role_id = ur.role_id
  WHERE u.user_id = x.{column} AND u.status_code = 'active' AND r.role_code IN ({roles}))"""


query(
    "v10_role_holder_check",
    _holder_sql("production_batches", "responsible_user_id", "'technologist'", False),
)(lambda t: rules.role_holder_check(t, "production_batches", "responsible_user_id", ("technologist",)))

query(
    "v10_inspectors",
    _holder_sql("quality_checks", "inspector_user_id", "'quality_control'", True),
)(lambda t: rules.role_holder_check(t, "quality_checks", "inspector_user_id", ("quality_control",), required=True))

query(
    "v10_approvers",
    _holder_sql("tech_cards", "approved_by_user_id", "'admin', 'technologist'", False),
)(lambda t: rules.role_holder_check(t, "tech_cards", "approved_by_user_id", ("admin", "technologist")))
