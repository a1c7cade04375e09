"""Golden facts of the demonstration data, worked out by hand."""

from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockweave.integrity import RULES
from stockweave.operators import fefo, gates, listings, movements, reports, rules, security
from stockweave.operators.audit import audit_diff
from stockweave.plans.report_page import report_page
from stockweave.sources.seed import seed_tables

AS_OF = date(2026, 4, 20)


@pytest.fixture(scope="module")
def t(spark):
    return seed_tables(spark, AS_OF)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_only_yeast_is_low(t):
    assert pairs(reports.low_stock_report(t), "material_name", "quantity_on_hand") == [("Yeast", D("35.000"))]


def test_shortage(t):
    assert dict(pairs(reports.stock_shortage(t), "name", "shortage_qty")) == {
        "Flour": D("-360.000"),
        "Yeast": D("15.000"),
        "Salt": D("-95.000"),
        "Sugar": D("-160.000"),
        "Poppy Seeds": D("-30.000"),
        "Butter": D("-30.000"),
    }


def test_sales_in_order(t):
    rows = pairs(reports.sales_by_product(t, AS_OF - timedelta(days=30), AS_OF), "product_name", "total_quantity", "total_amount")
    assert rows == [
        ("Borodinsky Bread", D("90.000"), D("7650.00")),
        ("Moscow Bread", D("80.000"), D("6240.00")),
        ("Poppy Seed Roll", D("22.000"), D("3080.00")),
    ]


def test_supplier_summary(t):
    df = reports.supplier_invoice_summary(t, AS_OF - timedelta(days=30), AS_OF)
    assert pairs(df, "outstanding_amount", "paid_amount") == [(D("122050.00"), D("22950.00"))]


def test_category_prices_dearest_first(t):
    rows = pairs(reports.category_price_stats(t), "category", "products_count", "average_price")
    assert rows == [("Pastry", 1, D("140.0000")), ("Bread", 2, D("81.5000"))]


def test_order_totals_equal_invoices(t):
    totals = dict(pairs(reports.order_totals(t), "order_id", "order_amount"))
    assert totals == {1: D("4800.00"), 2: D("10490.00"), 3: D("1680.00")}
    assert totals == dict(pairs(t["invoices"], "order_id", "amount"))


def test_gated_and_ungated_availability(t):
    gated = gates.available_quantity(t["products"], t["finished_goods_stock"], t["quality_checks"], AS_OF)
    assert dict(pairs(gated, "product_id", "quantity_available")) == {1: D("28.000"), 2: D("0.000"), 3: D("30.000")}
    open_ = gates.ungated_availability(t["products"], t["finished_goods_stock"], AS_OF)
    assert dict(pairs(open_, "product_id", "quantity_available")) == {1: D("28.000"), 2: D("20.000"), 3: D("30.000")}
    orderable = gates.orderable_products(t["products"], t["finished_goods_stock"], t["quality_checks"], AS_OF)
    assert sorted(r.product_id for r in orderable.collect()) == [1, 3]


def test_coverage_and_payment(t):
    covered = gates.shipment_coverage(t["order_items"], t["shipment_items"], t["shipments"])
    assert dict(pairs(covered, "order_id", "is_covered")) == {1: True, 2: False, 3: False}
    paid = gates.payment_status(t["customer_orders"], t["invoices"])
    assert dict(pairs(paid, "order_id", "payment_state")) == {1: "paid", 2: "unpaid", 3: "unpaid"}


def test_recipe_requirement_of_first_batch(t):
    need = fefo.recipe_requirement(t["production_batches"].filter("production_batch_id = 1"), t["recipe_items"])
    assert dict(pairs(need, "material_id", "required_qty")) == {
        1: D("85.2600000000"),
        2: D("2.4000000000"),
        3: D("1.8000000000"),
        4: D("3.6000000000"),
    }


def test_no_batch_is_feasible(t):
    verdicts = fefo.production_feasibility(
        t["production_batches"], t["recipe_items"], t["raw_material_stock"], t["quality_checks"]
    )
    by_material = {(r.production_batch_id, r.material_id): r.verdict for r in verdicts.collect()}
    assert by_material[(1, 1)] == "ok"
    assert {v for (_, m), v in by_material.items() if m != 1} == {"not_quality_approved"}


def test_batch_without_recipe(t):
    verdicts = fefo.production_feasibility(
        t["production_batches"], t["recipe_items"].filter("tech_card_id <> 2"), t["raw_material_stock"], t["quality_checks"]
    )
    assert [r.verdict for r in verdicts.filter("production_batch_id = 2").collect()] == ["no_recipe"]


def test_delivery_totals_equal_stored(t):
    new = movements.delivery_totals(t["raw_material_deliveries"], t["delivery_items"])
    assert dict(pairs(new, "delivery_id", "total_amount")) == dict(
        pairs(t["raw_material_deliveries"], "delivery_id", "total_amount")
    )


def test_delivery_to_stock_is_idempotent(t):
    lots, rejects = movements.delivery_to_stock(t["raw_material_deliveries"], t["delivery_items"], t["raw_material_stock"])
    assert lots.count() == 0 and rejects.count() == 0
    some = t["raw_material_stock"].filter("stock_id > 2")
    lots, _ = movements.delivery_to_stock(t["raw_material_deliveries"], t["delivery_items"], some)
    assert sorted(r.delivery_item_id for r in lots.collect()) == [1, 2]


def test_lot_ledger(t):
    lots, rejects = movements.finalize_batches(t["production_batches"], t["finished_goods_stock"].limit(0), t["products"])
    shipped = {1: 90, 2: 79, 3: 10}
    left = {r.production_batch_id: int(r.quantity_current) - shipped[r.production_batch_id] for r in lots.collect()}
    assert left == {1: 28, 2: 20, 3: 30}
    assert rejects.count() == 0
    again, rejects = movements.finalize_batches(t["production_batches"], t["finished_goods_stock"], t["products"])
    assert again.count() == 0 and rejects.count() == 3


def test_client_sees_own_rows_only(t):
    def ids(table, key):
        return sorted(r[0] for r in security.row_policy(t, table, "client", 5).select(key).collect())

    assert ids("customer_orders", "order_id") == [1]
    assert ids("order_items", "order_item_id") == [1, 2]
    assert ids("invoices", "invoice_id") == [1]
    assert ids("shipments", "shipment_id") == [1]
    assert ids("shipment_items", "shipment_item_id") == [1, 2]


def test_row_policy_denies_by_default(t):
    assert security.row_policy(t, "invoices", "technologist", 2).count() == 0
    assert security.row_policy(t, "customer_orders", "client", None).count() == 0
    assert security.row_policy(t, "customer_orders", "client", 2).count() == 0
    assert security.row_policy(t, "customer_orders", "nobody", 5).count() == 0
    assert security.row_policy(t, "customer_orders", "quality_control", 4).count() == 3


def test_seed_breaks_no_rule(t):
    names = list(RULES)
    assert rules.check_rules(t, names).count() == 0
    assert rules.not_null_rules(t, names).count() == 0
    assert rules.unique_rules(t, names).count() == 0
    assert rules.delivery_expiry(t).count() == 0
    assert rules.shipment_dates(t).count() == 0
    assert rules.role_holder_check(t, "production_batches", "responsible_user_id", ("technologist",)).count() == 0


def test_seed_references_hold(t):
    assert rules.fk_rules(t, list(RULES)).count() == 0


def test_audit_of_the_load(t):
    """Inserts into the audited tables, the two later sign-in updates and three sign-in events: 76 rows."""
    from stockweave.schemas import AUDITED_TABLES, PRIMARY_KEYS

    now = datetime(2026, 4, 20)
    inserts = 0
    for name in AUDITED_TABLES:
        diff = audit_diff(t[name].limit(0), t[name], list(PRIMARY_KEYS[name]), name, now)
        inserts += diff.count()
    before = t["users"].withColumn("last_login_at", F.lit(None).cast("timestamp"))
    updates = audit_diff(before, t["users"], ["user_id"], "users", now)
    assert {r.action_type for r in updates.collect()} == {"UPDATE"}
    assert (inserts, updates.count(), t["audit_log"].count()) == (71, 2, 3)


def test_users_with_roles(t):
    rows = pairs(listings.users_with_roles(t), "username", "roles")
    assert ("quality", "Quality Control") in rows and len(rows) == 5


def test_report_page_by_role(t):
    assert set(report_page(t, "quality_control", AS_OF)) == {"quality"}
    assert set(report_page(t, "technologist", AS_OF)) == {"orders", "production"}
    assert len(report_page(t, "admin", AS_OF)) == 10
    assert report_page(t, "client", AS_OF) == {}
    assert report_page(t, "admin", AS_OF)["quality"].count() == 4
