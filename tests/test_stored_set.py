"""Sets of stored tables: waves become visible at once or not at all, and layouts let readers skip files."""

from datetime import date, datetime, timedelta, timezone
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockweave.plans import stored_waves
from stockweave.plans.delivery_wave import run_delivery_wave
from stockweave.plans.production_wave import run_production_wave
from stockweave.sources import stored, stored_set
from stockweave.sources.seed import seed_tables
from stockweave.sources.tables import publish_snapshot, read_snapshot, versions

AS_OF = date(2026, 4, 20)
NOW = datetime(2026, 4, 20, 12)


@pytest.fixture(scope="module")
def t(spark):
    seeded = seed_tables(spark, AS_OF)
    batches = seeded["production_batches"].withColumn("status_code", F.lit("in_progress"))
    passed = seeded["raw_material_stock"].select(
        F.lit("raw_material").alias("check_type"), "delivery_item_id", F.lit("passed").alias("result_code")
    )
    stock = seeded["raw_material_stock"].withColumn(
        "quantity_current",
        F.when(F.col("material_id") == 1, D("100.000")).otherwise(F.col("quantity_current")).cast("decimal(12,3)"),
    )
    deliveries = seeded["raw_material_deliveries"].withColumn(
        "status_code", F.when(F.col("delivery_id") == 1, "received").otherwise("planned")
    )
    return seeded.replaced(
        production_batches=batches,
        raw_material_stock=stock,
        raw_material_deliveries=deliveries,
        supplier_invoices=seeded["supplier_invoices"].filter("delivery_id <> 1"),
        quality_checks=seeded["quality_checks"].unionByName(passed, allowMissingColumns=True),
        finished_goods_stock=seeded["finished_goods_stock"].limit(0),
    )


def created(t, folder, names):
    assert stored_set.create_set({n: t[n] for n in names.split()}, str(folder)) == 1
    return str(folder)


PRODUCTION = (
    "production_statuses products roles users user_roles raw_material_stock tech_cards recipe_items production_batches "
    "finished_goods_stock quality_checks audit_log"
)


@pytest.fixture
def folder(t, tmp_path):
    return created(t, tmp_path, PRODUCTION)


@pytest.fixture
def suppliers(t, tmp_path):
    return created(t, tmp_path, "suppliers")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def production(spark):
    rows = [(1, "completed"), (2, "completed"), (3, "cancelled")]
    return spark.createDataFrame(rows, "production_batch_id bigint, new_status string")


def deliveries(spark):
    rows = [(1, "accepted", 3), (2, "accepted", 3), (3, "received", 3)]
    return spark.createDataFrame(rows, "delivery_id bigint, new_status string, user_id bigint")


def test_a_set_holds_its_tables(spark, t, folder):
    got = stored_set.read_set(spark, folder)
    assert set(got) == set(PRODUCTION.split())
    assert all(rows_of(got[n]) == rows_of(t[n]) for n in got)
    with pytest.raises(FileExistsError):
        stored_set.create_set(t, folder)


def test_production_wave_is_one_commit(spark, t, folder):
    want = run_production_wave(t, production(spark), NOW)
    version, judged = stored_waves.commit_production_wave(spark, folder, production(spark), NOW, 2)
    assert version == 2 and rows_of(judged) == rows_of(want.judged)
    got = stored_set.read_set(spark, folder)
    assert {r.production_batch_id: r.status_code for r in got["production_batches"].collect()} == {
        r.production_batch_id: "completed" if r.production_batch_id == 1 else "in_progress"
        for r in t["production_batches"].collect()
    }
    assert rows_of(got["raw_material_stock"]) == rows_of(want.material_stock)
    lots = got["finished_goods_stock"].collect()
    assert [(r.finished_stock_id, r.production_batch_id, r.quantity_current) for r in lots] == [(1, 1, D("118.000"))]
    last = t["audit_log"].agg(F.max("audit_id")).first()[0] or 0
    new = got["audit_log"].where(f"audit_id > {last}").collect()
    assert [(r.audit_id, r.user_id, r.action_type, r.table_name, r.record_id) for r in new] == [
        (last + 1, 2, "UPDATE", "production_batches", "production_batch_id=1")
    ]
    before = stored_set.read_set(spark, folder, 1)
    assert all(rows_of(before[n]) == rows_of(t[n]) for n in ("production_batches", "raw_material_stock", "audit_log"))
    # The same wave again finds the batch completed and changes nothing.
    version, judged = stored_waves.commit_production_wave(spark, folder, production(spark), NOW)
    assert version == 2 and judged.where("reject_reason IS NULL").isEmpty()
    assert versions(spark, folder) == [1, 2]


def test_delivery_wave_is_one_commit(spark, t, tmp_path):
    folder = created(
        t, tmp_path, "raw_material_deliveries delivery_items raw_material_stock supplier_invoices audit_log"
    )
    emptied = t["raw_material_stock"].filter("stock_id > 2")
    change = stored_set.Transaction(spark, folder)
    gone = t["raw_material_stock"].filter("stock_id <= 2")
    change.rewrite("raw_material_stock", gone, ["stock_id"], lambda rows: rows.join(gone, "stock_id", "left_anti"))
    assert change.commit() == 2
    want = run_delivery_wave(t.replaced(raw_material_stock=emptied), deliveries(spark), AS_OF)
    version, judged = stored_waves.commit_delivery_wave(spark, folder, deliveries(spark), AS_OF, NOW)
    assert version == 3 and rows_of(judged) == rows_of(want.judged)
    got = stored_set.read_set(spark, folder)
    assert rows_of(got["raw_material_deliveries"]) == rows_of(want.deliveries.select(t["raw_material_deliveries"].columns))
    last = emptied.agg(F.max("stock_id")).first()[0]
    added = got["raw_material_stock"].where(f"stock_id > {last}")
    names = want.new_lots.columns
    assert rows_of(added.select(names)) == rows_of(want.new_lots) and added.count() == 2
    kept = t["supplier_invoices"].count()
    assert got["supplier_invoices"].count() == kept + want.new_invoices.count() == kept + 1


def test_ship_lines_are_one_commit(spark, t, tmp_path):
    tables = t.replaced(
        finished_goods_stock=seed_tables(spark, AS_OF)["finished_goods_stock"],
        invoices=t["invoices"].withColumn("status_code", F.lit("paid")),
        shipments=t["shipments"].withColumn("status_code", F.lit("planned")),
        shipment_items=t["shipment_items"].limit(0),
    )
    folder = created(
        tables,
        tmp_path,
        "customer_orders order_items finished_goods_stock quality_checks invoices shipments shipment_items audit_log",
    )
    lots = tables["finished_goods_stock"].withColumn("expiry_date", F.lit(AS_OF + timedelta(9)))
    change = stored_set.Transaction(spark, folder)
    change.rewrite("finished_goods_stock", lots, ["finished_stock_id"], lambda rows: lots)
    passed = lots.select(
        F.lit("finished_product").alias("check_type"), "production_batch_id", F.lit("passed").alias("result_code")
    )
    change.rewrite("quality_checks", tables["quality_checks"], ["quality_check_id"], lambda rows: rows.limit(0))
    change.insert("quality_checks", passed.distinct(), "production_batch_id")
    change.commit()
    # Every lot with every order line of its product and a shipment of the order; 1 is taken by each that may.
    requests = (
        tables["order_items"]
        .join(tables["shipments"].select("shipment_id", "order_id"), "order_id")
        .join(lots.select("product_id", "finished_stock_id"), "product_id")
        .select(
            F.concat_ws("-", "shipment_id", "order_item_id", "finished_stock_id").alias("request_id"),
            "shipment_id",
            "order_item_id",
            "finished_stock_id",
            F.lit(1).cast("decimal(12,3)").alias("quantity"),
        )
    )
    asked = requests.count()
    version, rejects = stored_waves.commit_ship_lines(spark, folder, requests, AS_OF, NOW)
    got = stored_set.read_set(spark, folder)
    shipped = got["shipment_items"].collect()
    assert version == 3 and shipped and len(shipped) + rejects.count() == asked
    assert sorted(r.shipment_item_id for r in shipped) == list(range(1, len(shipped) + 1))
    taken = lots.agg(F.sum("quantity_current")).first()[0] - got["finished_goods_stock"].agg(F.sum("quantity_current")).first()[0]
    assert taken == len(shipped)


def test_of_two_transactions_one_commits(spark, suppliers):
    folder = suppliers
    first, second = stored_set.Transaction(spark, folder), stored_set.Transaction(spark, folder)
    for change, name in ((first, "one"), (second, "two")):
        rows = spark.createDataFrame([(name,)], "company_name string")
        change.insert("suppliers", rows, "company_name")
    assert second.commit() == 2
    with pytest.raises(stored_set.Conflict):
        first.commit()
    names = {r.company_name for r in stored_set.read_set(spark, folder)["suppliers"].collect()}
    assert "two" in names and "one" not in names


def test_wave_never_broadcasts_by_the_size_of_packed_files(spark, t, folder, monkeypatch):
    """The files of the requests take under 10 MB, the default limit, and their rows over that."""

    class Seen(Exception):
        pass

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def plan_of(tables, requests, _):
        limits = [spark.conf.get(f"spark.sql.{kind}autoBroadcastJoinThreshold") for kind in ("", "adaptive.")]
        raise Seen(
            limits,
            plan(tables["production_batches"].join(requests, "production_batch_id", "left_semi")),
            plan(requests.join(tables["production_statuses"].withColumnRenamed("status_code", "new_status"), "new_status")),
        )

    monkeypatch.setattr(stored_waves, "run_production_wave", plan_of)
    before = [spark.conf.get(f"spark.sql.{kind}autoBroadcastJoinThreshold", None) for kind in ("", "adaptive.")]
    requests = spark.range(400_000).select(
        F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("production_batch_id"), F.lit("completed").alias("new_status")
    )
    with pytest.raises(Seen) as found:
        stored_waves.commit_production_wave(spark, folder, requests, NOW)
    limits, large, small = found.value.args
    assert "Broadcast" not in large and "BroadcastHashJoin" in small
    assert limits == [str(10 * 2**20 // 100), str(10 * 2**20)]
    after = [spark.conf.get(f"spark.sql.{kind}autoBroadcastJoinThreshold", None) for kind in ("", "adaptive.")]
    assert after == before


def test_compaction_is_a_commit_without_audit_rows(spark, t, tmp_path):
    folder = created(t, tmp_path, "suppliers audit_log")
    for name in ("one", "two"):
        change = stored_set.Transaction(spark, folder)
        change.insert("suppliers", spark.createDataFrame([(name,)], "company_name string"), "company_name")
        change.commit()
    rows = rows_of(stored_set.read_set(spark, folder)["suppliers"])
    change = stored_set.Transaction(spark, folder)
    change.compact("suppliers")
    change.audit(NOW)
    assert change.commit() == 4
    got = stored_set.read_set(spark, folder)
    assert rows_of(got["suppliers"]) == rows and len(got["suppliers"].inputFiles()) == 1
    assert rows_of(got["audit_log"]) == rows_of(t["audit_log"])


def test_killed_commit_shows_nothing(spark, t, folder, monkeypatch):
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(stored_set, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            stored_waves.commit_production_wave(spark, folder, production(spark), NOW)
    got = stored_set.read_set(spark, folder)
    assert all(rows_of(got[n]) == rows_of(t[n]) for n in ("production_batches", "raw_material_stock", "audit_log"))
    # Table versions of the killed wave are there, but the next one starts from the listed ones.
    assert stored.latest(spark, f"{folder}/tables/raw_material_stock") == 2
    version, _ = stored_waves.commit_production_wave(spark, folder, production(spark), NOW)
    want = run_production_wave(t, production(spark), NOW)
    got = stored_set.read_set(spark, folder)
    assert version == 2 and rows_of(got["raw_material_stock"]) == rows_of(want.material_stock)
    assert got["finished_goods_stock"].count() == 1


def cut_off(folder, version):
    """What a writer that ends while it writes a manifest leaves."""
    (Path(folder) / "manifests" / f"{version:08d}" / "_temporary").mkdir(parents=True)


def test_manifest_cut_off_stops_writers_until_told(spark, suppliers):
    folder = suppliers
    cut_off(folder, 2)
    rows = spark.createDataFrame([("new",)], "company_name string")
    assert stored_set.latest(spark, folder) == 1
    with pytest.raises(RuntimeError):
        stored_set.Transaction(spark, folder)
    change = stored_set.Transaction(spark, folder, after_crash=True)
    change.insert("suppliers", rows, "company_name")
    assert change.commit() == 3
    change = stored_set.Transaction(spark, folder)
    change.insert("suppliers", rows, "company_name")
    assert change.commit() == 4 and versions(spark, folder) == [1, 3, 4]


def test_manifest_cut_off_in_one_stored_table_and_in_snapshots(spark, tmp_path):
    rows = spark.range(5).withColumn("name", F.lit("a"))
    folder = str(tmp_path / "table")
    stored.create(rows, folder, ["id"])
    cut_off(folder, 2)
    keys = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(RuntimeError):
        stored.rewrite(folder, keys, ["id"], lambda df: df)
    assert stored.rewrite(folder, keys, ["id"], lambda df: df.withColumn("name", F.lit("b")), after_crash=True) == 3
    assert {r.name for r in stored.read(spark, folder).collect()} == {"b"}
    folder = str(tmp_path / "snapshots")
    table = seed_tables(spark, AS_OF)["roles"]
    assert publish_snapshot({"roles": table}, folder) == 1
    cut_off(folder, 2)
    assert read_snapshot(spark, folder)["roles"].count() == table.count()
    assert publish_snapshot({"roles": table.limit(1)}, folder) == 3
    assert read_snapshot(spark, folder)["roles"].count() == 1


def test_files_of_a_period_and_of_a_document_are_few(spark, t, tmp_path):
    """The layout leaves most files out of the value ranges that common filters ask for."""
    import pyarrow.parquet as pq

    orders = spark.range(4000).select(
        (F.hash("id").cast("bigint") % 100000).alias("order_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("order_date"),
        F.lit("draft").alias("status_code"),
    )
    lines = spark.range(4000).select("id", (F.hash("id") % 1000).cast("bigint").alias("order_id")).select(
        F.col("id").alias("order_item_id"), "order_id", (F.col("id") % 7).alias("product_id")
    )
    stored_set.create_set({"customer_orders": orders, "order_items": lines}, str(tmp_path), file_rows=100)

    def files(name, column, low, high):
        paths = sorted((tmp_path / "tables" / name).glob("data/*/*.parquet"))
        met = 0
        for path in paths:
            group = pq.ParquetFile(path).metadata
            at = group.schema.to_arrow_schema().names.index(column)
            stats = [group.row_group(i).column(at).statistics for i in range(group.num_row_groups)]
            met += any(s.min <= high and low <= s.max for s in stats)
        return met, len(paths)

    day = datetime.fromtimestamp(1_700_000_000, timezone.utc) + timedelta(days=80)
    met, total = files("customer_orders", "order_date", day, day + timedelta(days=1))
    assert total >= 40 and met <= 2
    met, total = files("order_items", "order_id", 42, 42)
    assert total >= 40 and met <= 2
