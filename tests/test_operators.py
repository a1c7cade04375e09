"""Branches the supplied data does not reach: writes, rules, transitions, audit."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockweave.operators import rules, security, transitions, writes
from stockweave.operators.audit import audit_diff, auth_events
from stockweave.operators.gates import approved_keys, valid_tech_cards
from stockweave.plans.delivery_wave import run_delivery_wave
from stockweave.plans.production_wave import run_production_wave
from stockweave.sources.seed import seed_tables
from stockweave.sources.sinks import insert_ignore, with_defaults
from stockweave.sources.tables import read_tables, snapshot_check, write_snapshot

AS_OF = date(2026, 4, 20)
NOW = datetime(2026, 4, 20, 12)


@pytest.fixture(scope="module")
def t(spark):
    return seed_tables(spark, AS_OF)


def test_unique_rules_and_nulls(spark):
    stock = spark.createDataFrame(
        [(1, 1, None), (2, 1, None), (3, 1, "a"), (4, 2, "a")], "stock_id int, material_id int, batch_number string"
    )
    people = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "customer_id int, email string")
    got = rules.unique_rules({"raw_material_stock": stock, "customers": people}, ["raw_material_stock", "customers"])
    assert {(r.rule, r.key_values, r.row_count) for r in got.collect()} == {
        ("unique_material_id_batch_number", "material_id=1, batch_number=null", 2),
        ("unique_email", "email=x", 2),
    }


def test_one_active_card_rule(spark, t):
    cards = t["tech_cards"].unionByName(
        t["tech_cards"].filter("tech_card_id = 1").withColumns(
            {"tech_card_id": F.lit(9).cast("bigint"), "version": F.lit(2), "card_number": F.lit("TC-9")}
        )
    )
    got = rules.unique_rules({"tech_cards": cards}, ["tech_cards"]).collect()
    assert [(r.rule, r.key_values) for r in got] == [("unique_product_id_where", "product_id=1")]


def test_checks_pass_on_null(spark):
    lines = spark.createDataFrame(
        [(1, D("0"), D("1"), None), (2, D("2"), None, D("-1"))],
        "order_item_id int, quantity decimal(12,3), unit_price decimal(12,2), line_amount decimal(12,2)",
    )
    got = rules.check_rules({"order_items": lines}, ["order_items"]).collect()
    assert {(r.rule, r.record_id) for r in got} == {
        ("quantity_positive", "order_item_id=1"),
        ("line_amount_not_negative", "order_item_id=2"),
    }


def test_composite_reference(t):
    stock = t["raw_material_stock"].withColumn(
        "material_id", F.when(F.col("stock_id") == 1, F.lit(3)).otherwise(F.col("material_id")).cast("bigint")
    )
    got = rules.fk_rules(t.replaced(raw_material_stock=stock), ["raw_material_stock"]).collect()
    assert [(r.rule, r.record_id) for r in got] == [("fk_delivery_item_id_material_id", "stock_id=1")]


def test_delete_restrict(t):
    held = rules.delete_restrict(t, "raw_materials").groupBy("held_by").count().collect()
    assert {(r.held_by, r["count"]) for r in held} == {
        ("supplier_materials.fk_material_id", 6),
        ("delivery_items.fk_material_id", 6),
        ("raw_material_stock.fk_material_id", 6),
        ("recipe_items.fk_material_id", 6),
    }


def test_failed_check_overrules_passed(spark):
    checks = spark.createDataFrame(
        [("raw_material", 1, "passed"), ("raw_material", 1, "failed"), ("raw_material", 2, "passed"),
         ("raw_material", 3, "conditional"), ("finished_product", 4, "passed"), ("raw_material", None, "passed")],
        "check_type string, delivery_item_id int, result_code string",
    )
    assert [r[0] for r in approved_keys(checks, "delivery_item_id", "raw_material").collect()] == [2]


def test_tech_card_reasons(spark, t):
    uses = spark.createDataFrame(
        [(1, 1, 1, AS_OF), (2, 2, 1, AS_OF), (3, 1, 77, AS_OF), (4, 3, 3, date(2020, 1, 1))],
        "production_batch_id bigint, product_id bigint, tech_card_id bigint, day date",
    )
    got = {r.production_batch_id: r.reject_reason for r in valid_tech_cards(uses, t["tech_cards"], t["products"]).collect()}
    assert got == {1: None, 2: "card_of_other_product", 3: "card_missing", 4: "card_not_yet_effective"}


def test_upsert_last_change_wins_and_blank_stage_matches_null(spark):
    old = spark.createDataFrame([(1, 1, None, 5), (2, 1, "mix", 6)], "id int, card int, stage string, qty int")
    new = spark.createDataFrame(
        [(1, "", 7, 1), (1, None, 8, 2), (1, "bake", 9, 3)], "card int, stage string, qty int, sent int"
    )
    got = writes.upsert_by_key(old, new, ["card", "stage"], "sent", blank_as_null=("stage",)).collect()
    assert {(r.id, r.stage, r.qty, r.write_kind) for r in got} == {
        (1, None, 8, "updated"),
        (2, "mix", 6, "kept"),
        (None, "bake", 9, "inserted"),
    }


def test_update_rejects_clash_and_unknown(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, code int, name string")
    new = spark.createDataFrame([(1, 20, "x"), (2, 25, "y"), (9, 90, "z")], "id int, code int, name string")
    rows, rejects = writes.update_by_key(old, new, "id", ["code"])
    assert {tuple(r) for r in rows.collect()} == {(1, 10, "a"), (2, 25, "y")}
    assert {tuple(r) for r in rejects.collect()} == {(1, "taken_by_other_row"), (9, "row_missing")}


def test_insert_ignore_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([("a", 1)], "code string, v int")
    new = spark.createDataFrame([("a", 5), ("b", 9), ("b", 3)], "code string, v int")
    assert {tuple(r) for r in insert_ignore(new, old, ["code"]).collect()} == {("b", 3)}


def test_defaults_fill_only_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, D("3.000"))], "production_batch_id bigint, quantity_defective decimal(12,3)")
    got = {r.production_batch_id: r for r in with_defaults(rows, "production_batches", AS_OF, NOW).collect()}
    assert (got[1].quantity_defective, got[2].quantity_defective) == (D("0.000"), D("3.000"))
    assert got[1].production_date == NOW and got[1].batch_number is None


def test_snapshot_round_trip(spark, t, tmp_path):
    folder = str(tmp_path / "snapshot")
    names = write_snapshot(t, folder)
    restored = read_tables(spark, folder)
    check = snapshot_check(t, restored, names).collect()
    assert len(check) == 32 and all(r.matches for r in check)
    assert restored["products"].exceptAll(t["products"]).count() == 0


def test_audit_replay_gives_the_new_table(spark, t):
    old = t["products"]
    new = (
        old.filter("product_id <> 2")
        .withColumn("price", F.when(F.col("product_id") == 1, D("90.00")).otherwise(F.col("price")).cast("decimal(12,2)"))
        .unionByName(old.filter("product_id = 3").withColumn("product_id", F.lit(4).cast("bigint")))
    )
    log = audit_diff(old, new, ["product_id"], "products", NOW, 1, "10.0.0.1")
    assert {(r.action_type, r.record_id) for r in log.collect()} == {
        ("UPDATE", "product_id=1"),
        ("DELETE", "product_id=2"),
        ("INSERT", "product_id=4"),
    }
    touched = log.select(F.regexp_extract("record_id", r"=(\d+)", 1).cast("bigint").alias("product_id"))
    images = log.filter("new_data IS NOT NULL").select(F.from_json("new_data", old.schema).alias("x")).select("x.*")
    replayed = old.join(touched, "product_id", "left_anti").unionByName(images)
    assert replayed.exceptAll(new).count() == 0 and new.exceptAll(replayed).count() == 0


def test_sign_in_events(spark):
    events = spark.createDataFrame(
        [(1, "LOGIN", True), (None, "LOGIN", False), (1, "DELETE", True)], "user_id bigint, action_type string, success boolean"
    ).withColumns({"changed_at": F.lit(NOW), "ip_address": F.lit("10.0.0.1")})
    rows, rejects = auth_events(events)
    assert {(r.user_id, r.record_id, r.success) for r in rows.collect()} == {(1, "user_id=1", True), (None, None, False)}
    assert [r.action_type for r in rejects.collect()] == ["DELETE"]


def test_order_guards_on_seed(spark, t):
    requests = spark.createDataFrame(
        [(1, "completed", "admin"), (2, "completed", "admin"), (3, "in_production", "technologist"), (9, "ready", "admin")],
        "order_id bigint, new_status string, role_code string",
    )
    judged = transitions.order_transitions(
        t["customer_orders"], requests, t["invoices"], t["order_items"], t["shipment_items"], t["shipments"]
    )
    assert {r.order_id: r.reject_reason for r in judged.collect()} == {
        1: "transition_not_allowed",
        2: "no_delivered_shipment",
        3: None,
        9: "document_missing",
    }


def test_shipping_an_unpaid_order_is_refused(spark, t):
    ready = t["customer_orders"].withColumn("status_code", F.lit("ready"))
    requests = t["customer_orders"].select("order_id", F.lit("shipped").alias("new_status"), F.lit("admin").alias("role_code"))
    judged = transitions.order_transitions(
        ready, requests, t["invoices"], t["order_items"], t["shipment_items"], t["shipments"]
    )
    assert {r.order_id: r.reject_reason for r in judged.collect()} == {1: None, 2: "invoice_not_paid", 3: "invoice_not_paid"}


def test_paying_stamps_and_reissuing_clears(spark, t):
    judged = spark.createDataFrame(
        [(1, "overdue", None), (2, "paid", None), (3, "paid", "not_payable")],
        "invoice_id bigint, new_status string, reject_reason string",
    )
    got = {r.invoice_id: r for r in transitions.apply_invoice_status(t["invoices"], judged, "invoice_id", NOW).collect()}
    assert (got[1].status_code, got[1].paid_at) == ("overdue", None)
    assert (got[2].status_code, got[2].paid_at) == ("paid", NOW)
    assert (got[3].status_code, got[3].paid_at) == ("overdue", None)


def test_only_first_of_two_activations_wins(spark, t):
    drafts = t["tech_cards"].withColumns({"status_code": F.lit("draft"), "product_id": F.lit(1).cast("bigint")})
    requests = drafts.select("tech_card_id", F.lit("active").alias("new_status"))
    judged = transitions.tech_card_transitions(drafts, requests)
    assert {r.tech_card_id: r.reject_reason for r in judged.collect()} == {
        1: None,
        2: "product_has_active_card",
        3: "product_has_active_card",
    }


def test_primary_role_and_access(spark, t):
    both = t["user_roles"].unionByName(
        spark.createDataFrame([(5, 3, NOW, 1)], t["user_roles"].schema)
    ).filter("user_id <> 4")
    tables = t.replaced(user_roles=both)
    roles = {r.username: r.primary_role for r in security.primary_role(tables).collect()}
    assert roles == {
        "admin": "admin",
        "technologist": "technologist",
        "warehouse": "warehouse_worker",
        "quality": None,
        "client": "warehouse_worker",
    }
    loaded = {r.user_id: r.roles for r in security.load_users(tables).collect()}
    assert loaded[4] == [] and loaded[5] == ["client", "warehouse_worker"]
    access = {(r.user_id, r.section) for r in security.can_access(tables).collect()}
    assert (1, "audit") in access and (5, "deliveries") in access and (2, "audit") not in access
    assert not {s for u, s in access if u == 4}


def test_delivery_wave(spark, t):
    deliveries = t["raw_material_deliveries"].withColumn(
        "status_code", F.when(F.col("delivery_id") == 1, "received").otherwise("planned")
    )
    tables = t.replaced(
        raw_material_deliveries=deliveries,
        raw_material_stock=t["raw_material_stock"].filter("stock_id > 2"),
        supplier_invoices=t["supplier_invoices"].filter("delivery_id <> 1"),
        delivery_items=t["delivery_items"].filter("delivery_id <> 3"),
    )
    requests = spark.createDataFrame(
        [(1, "accepted", 3), (2, "accepted", 3), (3, "received", 3)], "delivery_id bigint, new_status string, user_id bigint"
    )
    wave = run_delivery_wave(tables, requests, AS_OF)
    assert {r.delivery_id: r.reject_reason for r in wave.judged.collect()} == {
        1: None,
        2: "transition_not_allowed",
        3: "no_items",
    }
    assert sorted(r.delivery_item_id for r in wave.new_lots.collect()) == [1, 2]
    invoice = wave.new_invoices.collect()
    assert [(r.supplier_invoice_id, r.supplier_invoice_number, r.amount) for r in invoice] == [
        (4, "SINV-WEB-0004", D("22950.00"))
    ]
    assert {r.delivery_id: r.status_code for r in wave.deliveries.collect()} == {1: "accepted", 2: "planned", 3: "planned"}


def test_production_wave(spark, t):
    """One batch completes, the next finds the flour gone, the third has a cancelled target the dictionary lacks."""
    batches = t["production_batches"].withColumn("status_code", F.lit("in_progress")).withColumn(
        "product_id", F.lit(1).cast("bigint")
    ).withColumn("tech_card_id", F.lit(1).cast("bigint"))
    passed = t["raw_material_stock"].select(
        (F.col("stock_id") + 100).alias("quality_check_id"), "delivery_item_id",
        F.lit("raw_material").alias("check_type"), F.lit("passed").alias("result_code"),
    )
    stock = t["raw_material_stock"].withColumn(
        "quantity_current", F.when(F.col("material_id") == 1, D("100.000")).otherwise(F.col("quantity_current")).cast("decimal(12,3)")
    )
    tables = t.replaced(
        production_batches=batches,
        raw_material_stock=stock,
        quality_checks=t["quality_checks"].unionByName(passed, allowMissingColumns=True),
        finished_goods_stock=t["finished_goods_stock"].limit(0),
    )
    requests = spark.createDataFrame(
        [(1, "completed"), (2, "completed"), (3, "cancelled")], "production_batch_id bigint, new_status string"
    )
    wave = run_production_wave(tables, requests, NOW)
    assert {r.production_batch_id: r.reject_reason for r in wave.judged.collect()} == {
        1: None,
        2: "insufficient",
        3: "status_unknown",
    }
    assert [(r.production_batch_id, r.quantity_current) for r in wave.new_lots.collect()] == [(1, D("118.000"))]
    left = {r.material_id: r.quantity_current for r in wave.material_stock.collect()}
    assert left[1] == D("14.740") and left[2] == D("32.600") and left[6] == D("90.000")


def test_integrity_rules_read_each_table_once(spark):
    """One scan and one exchange for all unique keys of a table; hot keys and NULLs in the references."""
    from stockweave.integrity import RULES
    from stockweave.operators import rules

    items = [(i, i % 3, i % 2, None if i % 5 == 0 else f"b{i % 4}") for i in range(40)]
    rows = spark.createDataFrame(items, "delivery_item_id bigint, delivery_id bigint, material_id bigint, batch_number string")
    found = rules.unique_rules({"delivery_items": rows}, ["delivery_items"])
    want = []
    for rule in RULES["delivery_items"].unique:
        counts = {}
        for row in items:
            key = tuple(dict(zip(rows.columns, row))[c] for c in rule.columns)
            if rule.nulls_equal or None not in key:
                counts[key] = counts.get(key, 0) + 1
        for key, n in counts.items():
            if n > 1:
                text = ", ".join(f"{c}={'null' if v is None else v}" for c, v in zip(rule.columns, key))
                want.append(("delivery_items", rule.name, text, n))
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1


def test_references_share_one_pass(spark):
    """Children of one parent: the keys without a parent and their rows, and the parents that are held, with copies."""
    from stockweave.operators import rules

    orders = spark.createDataFrame([(1, 1), (2, 1), (2, 9), (3, None)], "order_id bigint, customer_id bigint")
    t = {
        "customers": spark.createDataFrame([(1,), (5,)], "customer_id bigint"),
        "customer_orders": orders.selectExpr("*", "'new' AS status_code", "1L AS created_by_user_id"),
        "order_items": spark.createDataFrame([(10, 1, 7), (11, 2, 7), (12, 99, 7), (13, None, 7)], "order_item_id bigint, order_id bigint, product_id bigint"),
    }
    lost = {tuple(r) for r in rules.fk_rules(t, ["customer_orders", "order_items"]).collect()}
    assert lost == {
        ("customer_orders", "fk_customer_id", "order_id=2"),
        ("order_items", "fk_order_id", "order_item_id=12"),
    }
    held = sorted(tuple(r)[1:] for r in rules.delete_restrict(t, "customer_orders").collect())
    assert held == [("order_id=1", "order_items.fk_order_id")] + [("order_id=2", "order_items.fk_order_id")] * 2


def test_snapshots_are_published_whole(spark, small, tmp_path):
    """A write that ends early leaves the snapshot before it; versions stay readable."""
    from stockweave.sources.tables import publish_snapshot, read_snapshot

    folder = str(tmp_path)
    t = {n: small[n] for n in ("customers", "products", "invoices")}
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, folder)
    assert publish_snapshot(t, folder) == 1

    class Killed(dict):
        def __getitem__(self, name):
            if name == "invoices":
                raise KeyboardInterrupt
            return super().__getitem__(name).limit(1)

    with pytest.raises(KeyboardInterrupt):
        publish_snapshot(Killed(t), folder)
    again = read_snapshot(spark, folder)
    assert sorted(again) == sorted(t)
    assert all(r.matches for r in snapshot_check(t, again, list(t)).collect())
    assert publish_snapshot({**t, "products": t["products"].limit(3)}, folder) == 2
    assert read_snapshot(spark, folder)["products"].count() == 3
    assert read_snapshot(spark, folder, 1)["products"].count() == t["products"].count()


def test_snapshot_check_sees_one_changed_cell(spark, small):
    rows = small["invoices"]
    key = rows.agg(F.min("invoice_id")).first()[0]
    one = F.col("invoice_id") == key
    changed = rows.withColumn("amount", F.when(one, F.col("amount") + 1).otherwise(F.col("amount")).cast(rows.schema["amount"].dataType))
    emptied = rows.withColumn("invoice_number", F.when(~one, F.col("invoice_number")))
    for other, same in ((changed, False), (emptied, False), (rows.select(*reversed(rows.columns)).repartition(3), True)):
        found = snapshot_check({"invoices": rows}, {"invoices": other}, ["invoices"]).first()
        assert found.source_rows == found.restored_rows and found.matches is same
    a = spark.createDataFrame([(None, "x"), ("y", None)], "a string, b string")
    b = spark.createDataFrame([("x", None), (None, "y")], "a string, b string")
    assert not snapshot_check({"t": a}, {"t": b}, ["t"]).first().matches


def test_a_repeated_batch_adds_nothing(spark, small, tmp_path):
    from stockweave.sources.sinks import append_batch

    rows = small["customer_orders"].select("order_id", "order_date", "status_code")
    old, new = rows.filter("order_id % 2 = 0"), rows.filter("order_id % 2 = 1")
    for batch, part in (("b1", old), ("b2", new), ("b2", new)):
        append_batch(part, str(tmp_path), "customer_orders", batch, day="order_date")
    stored = spark.read.parquet(f"{tmp_path}/customer_orders")
    assert sorted(stored.select(*rows.columns).collect()) == sorted(rows.collect())
    month = stored.filter("month = '1996-02'")
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert month.count() == rows.filter("date_format(order_date, 'yyyy-MM') = '1996-02'").count() > 0


def test_wave_compares_only_open_requests_with_the_stock(small, monkeypatch):
    """Requests that an earlier check refuses ask for no lots, and the lots are looked up once."""
    from stockweave.plans import production_wave as plan

    asked, looked = [], []
    keep, keep_lots = plan.feasibility_of_lots, plan.lots_for
    monkeypatch.setattr(plan, "feasibility_of_lots", lambda b, *rest: asked.append(b) or keep(b, *rest))
    monkeypatch.setattr(plan, "lots_for", lambda *a: looked.append(1) or keep_lots(*a))
    wave = plan.run_production_wave(small, small["production_status_requests"], datetime(1998, 1, 15, 12, 0))
    refused = wave.judged.filter(F.col("reject_reason").isin("transition_not_allowed", "responsible_not_technologist"))
    assert refused.count() > 0 and len(looked) == 1
    assert asked[0].join(refused, "production_batch_id", "left_semi").count() == 0


def test_unique_rules_read_again_only_keys_with_repeated_hashes(spark, monkeypatch):
    read, keep = [], rules._repeated_keys
    monkeypatch.setattr(rules, "_repeated_keys", lambda df, table, some, *rest: read.append((table, len(some))) or keep(df, table, some, *rest))
    layout = "tech_card_id bigint, product_id bigint, card_number string, version int, status_code string"
    single = spark.createDataFrame([(i, i, f"TC-{i}", 1, "draft") for i in range(50)], layout)
    assert rules.unique_rules({"tech_cards": single}, ["tech_cards"]).count() == 0 and not read
    twice = single.unionByName(spark.createDataFrame([(90, 90, "TC-7", 1, "draft")], layout))
    got = rules.unique_rules({"tech_cards": twice}, ["tech_cards"]).collect()
    assert [(r.key_values, r.row_count) for r in got] == [("card_number=TC-7", 2)] and read == [("tech_cards", 1)]


def test_reference_keys_of_digits_move_in_half_the_bytes(spark):
    from stockweave.integrity import RULES

    lots = [(1, "31521-6-9346-437-12"), (2, "31521-6-9346-437-1"), (3, "315A2"), (4, "315-2"), (5, "C7"), (6, "7"), (7, None)]
    checks = [(n, i, None, None, None) for n, i in [*lots, (8, "31521-6-9346-437-123"), (9, "315B2"), (10, "0315-2"), (11, "CC7"), (12, "")]]
    t = {
        "delivery_items": spark.createDataFrame(lots, "row bigint, delivery_item_id string"),
        "quality_checks": spark.createDataFrame(checks, "quality_check_id bigint, delivery_item_id string, production_batch_id bigint, inspector_user_id bigint, result_code string"),
    }
    lost = {r.record_id for r in rules.fk_rules(t, ["quality_checks"]).collect()}
    assert lost == {f"quality_check_id={n}" for n in (8, 9, 10, 11, 12)}
    rule = next(x for x in RULES["quality_checks"].references if x.parent == "delivery_items")
    keys = rules.reference_keys(t, [("quality_checks", rule)]).select("text").collect()
    assert len({bytes(r.text) for r in keys}) == len(keys) == 11
    assert max(len(r.text) for r in keys) == 11


def test_update_rejects_in_parts_are_the_same(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3), ("d", None)], "id string, place int")
    changes = spark.createDataFrame([("a", 2), ("b", 9), ("d", 3), ("x", 1), (None, 1), ("y", None)], "id string, place int")
    for parts in (None, 7):
        found = writes.update_rejects(rows, changes, "id", ["place"], parts)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(
            [("a", "taken_by_other_row"), ("x", "row_missing"), ("y", "row_missing"), (None, "row_missing")],
            key=str,
        )
