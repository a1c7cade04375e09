"""What moves, is held by the driver or is read again; results are compared in the other tests."""

import time
from datetime import date
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockweave.operators import gates, movements, rules
from stockweave.registry.documents import _ship_judged
from stockweave.session import cut_lineage
from stockweave.sources import sinks, stored, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cards_in_force_broadcast_nothing_and_meet_few_and_many_cards_alike(spark):
    first, later, last = date(2020, 1, 1), date(2020, 6, 1), date(2020, 12, 31)
    few, many = gates.FEW_CARDS, gates.FEW_CARDS + 1
    ends = [None, last, first]
    rows = [(p * 100 + i, p, "active", [first, later][i % 2], ends[i % 3]) for p, n in ((1, few), (2, many)) for i in range(n)]
    rows += [(900, 1, "draft", first, None), (901, None, "active", first, None), (902, 2, "active", None, None)]
    cards = spark.createDataFrame(rows, "tech_card_id long, product_id long, status_code string, effective_from date, effective_to date")
    days = [first, date(2020, 5, 31), later, last, date(2021, 1, 1), None]
    used = [(i, p, day) for i, (p, day) in enumerate((p, day) for p in (1, 2, 3, None) for day in days + days[:1])]
    uses = spark.createDataFrame(used, "production_batch_id long, product_id long, day date")
    found = gates.cards_in_force(uses, cards)
    assert "Broadcast" not in _plan(found)
    want = [
        (batch, card)
        for batch, product, day in used
        for card, of, status, start, end in rows
        if day and start and of is not None and of == product and status == "active" and start <= day and (end is None or day <= end)
    ]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def _read_from(df, folder):
    return [f for f in df.inputFiles() if str(folder) in f]


@pytest.mark.parametrize("serve", [movements.order_line_admission, movements.ship_lines])
def test_judged_requests_are_judged_once(spark, tmp_path, serve):
    rows = [
        ("a", 1, 7, D(2), D(5), None, D(3), None, 1, "i", 4, D(3), D(3)),
        ("b", 1, 7, D(2), D(5), None, D(3), None, 1, "i", 4, D(3), D(3)),
        ("c", 1, 7, D(9), D(5), None, D(3), "insufficient_stock", 1, "i", 4, D(3), D(3)),
    ]
    kinds = (
        "request_id string, order_id long, product_id long, quantity decimal(12,3), price decimal(12,2), "
        "present_quantity decimal(22,3), room decimal(23,3), reject_reason string, shipment_id long, "
        "order_item_id string, finished_stock_id long, lot_quantity decimal(12,3), line_remaining decimal(23,3)"
    )
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/judged")
    judged = spark.read.parquet(f"{tmp_path}/judged")
    assert _read_from(judged, tmp_path)
    served, rejects = serve(judged)
    assert not _read_from(served, tmp_path) and not _read_from(rejects, tmp_path)
    assert served.count() == 1 and sorted(r.request_id for r in rejects.collect()) == ["b", "c"]


def test_shipping_requests_move_once_for_each_of_their_keys(spark, small):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = _plan(_ship_judged(small))
    finally:
        spark.conf.set(setting, before)
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert not [m for m in moves if "hashpartitioning(shipment_order" in m]
    assert len([m for m in moves if "hashpartitioning(shipment_id" in m]) == 1
    # The requests, the order lines, and the sums of what was shipped.
    assert len([m for m in moves if "hashpartitioning(order_item_id" in m]) == 3


def test_short_keys_become_their_texts_again(spark):
    texts = [None, "", "1", "12", "-", "1-2-3", "C", "CC", "CC1", "abc", "0", "00", "\0a", "\1", "1\0012", ". :", "1996-01-02 10:00", "é", "1\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("k", rules.short_key(F.col("t")))
    found = {r.i: (r.back, r.size) for r in rows.select("i", rules.key_text(F.col("k")).alias("back"), F.octet_length("k").alias("size")).collect()}
    assert [found[i][0] for i in range(len(texts))] == texts
    assert found[texts.index("1996-01-02 10:00")][1] == 9


def _ship_inputs(spark):
    """Requests with what is to become of them, and the tables that they are judged against."""
    day, old = date(2030, 1, 1), date(2020, 1, 1)
    requests = [
        ("1-1", 1, "1-2", 100, 3, None),
        ("é", 1, "1-a", 100, 10, None),
        (None, 1, "1-2", 100, 7, "exceeds_order"),
        ("1-4", 9, "1-2", 100, 1, "shipment_missing"),
        ("1-5", None, "1-2", 100, 1, "shipment_missing"),
        ("1-6", 2, "1-2", 100, 0, "shipment_closed"),
        ("1-7", 4, "1-2", 100, 0, "quantity_not_positive"),
        ("1-8", 3, "1-2", 100, 1, "no_invoice"),
        ("1-9", 4, "9-9", None, 1, "invoice_not_paid"),
        ("1-10", 1, "9-9", None, 1, "line_of_other_order"),
        ("1-11", 1, None, 100, 1, "line_of_other_order"),
        ("1-12", 1, "1-2", None, 1, "lot_missing"),
        ("1-13", 1, "1-2", 101, 1, "lot_of_other_product"),
        ("1-14", 1, "1-2", 102, 99, "lot_expired"),
        ("1-15", 1, "1-2", 103, 2, "lot_too_small"),
        ("1-16", 1, "1-2", 104, 9, "lot_not_approved"),
        ("1-1", 1, "1-2", 100, 3, None),
    ]
    lots = [(100, 7, 50, day, 1), (101, 8, 50, old, 1), (102, 7, 50, old, 1), (103, 7, 1, day, 2), (104, 7, 50, day, 2)]
    of = spark.createDataFrame
    return requests, (
        of([(*r[:4], D(r[4])) for r in requests], "request_id string, shipment_id long, order_item_id string, finished_stock_id long, quantity decimal(12,3)"),
        of([(1, 10, "planned"), (2, 10, "shipped"), (3, 11, "planned"), (4, 12, "planned")], "shipment_id long, order_id long, status_code string"),
        of([(10, "paid"), (12, "issued")], "order_id long, status_code string"),
        of([(10,), (11,), (12,)], "order_id long"),
        of([(i, o, 7, D(10)) for i, o in (("1-2", 10), ("1-a", 10), ("9-9", 99), (None, 10))], "order_item_id string, order_id long, product_id long, quantity decimal(12,3)"),
        of([(*x[:2], D(x[2]), *x[3:]) for x in lots], "finished_stock_id long, product_id long, quantity_current decimal(12,3), expiry_date date, production_batch_id long"),
        of([(1, "finished_product", "passed")], "production_batch_id long, check_type string, result_code string"),
        of([("1-2", D(4)), (None, D(1))], "order_item_id string, quantity decimal(12,3)"),
        date(2025, 1, 1),
    )


def test_shipping_requests_are_refused_for_the_first_reason_in_one_step_or_two(spark):
    requests, tables = _ship_inputs(spark)
    want = sorted((r[0], r[1], r[2], r[3], D(r[4]), r[5]) for r in [tuple(x if x is not None else "" for x in r) for r in requests])
    columns = "request_id", "shipment_id", "order_item_id", "finished_stock_id", "quantity", "reject_reason"
    for in_steps in (False, True):
        judged = movements.judge_ship_lines(*tables, in_steps=in_steps)
        found = [tuple("" if x is None else x for x in r) for r in judged.select(*columns).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
        lines = {(r.request_id, r.product_id, r.lot_quantity, r.line_remaining) for r in judged.collect()}
        assert ("1-1", 7, D(50), D(6)) in lines and ("1-6", 7, D(50), D(6)) in lines and ("1-11", None, D(50), None) in lines


def test_requests_judged_in_steps_do_not_hold_the_shuffles_of_the_first(spark, small):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = _plan(_ship_judged(small, in_steps=True))
    finally:
        spark.conf.set(setting, before)
    assert plan.count("Exchange hashpartitioning(") == 3 == plan.count("Exchange hashpartitioning(order_item_id")


def test_tables_in_the_shared_folder_leave_no_shuffle_files(spark):
    places = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f.name for place in places for f in Path(place).rglob("shuffle_*")}

    rows = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    table = cut_lineage(rows)
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 7


def test_stored_tables_are_packed(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "'text ' || id AS text")
    folder = f"file://{tmp_path}"
    sinks.append(rows, f"{folder}/sink", "rows")
    stored.create(rows, f"{folder}/stored", ["id"])
    tables.publish_snapshot({"customers": rows}, f"{folder}/snapshot")
    found = [f for place in ("sink", "stored/data", "snapshot/data") for f in Path(tmp_path, place).rglob("part-*.parquet")]
    assert len(found) >= 3 and all(f.name.endswith(".zstd.parquet") for f in found)
    assert all(f.endswith(".zstd.parquet") for f in cut_lineage(rows).inputFiles())
