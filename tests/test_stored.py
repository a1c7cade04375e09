"""Stored tables: writes replace only files with changed keys; periods meet days by equal keys."""

from datetime import date, datetime, timedelta
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from stockweave.functions.intervals import LEVELS, nodes_of_day, nodes_of_interval
from stockweave.operators import gates, writes
from stockweave.operators.audit import audit_diff
from stockweave.plans.stored_writes import audit_versions, deactivate_stored, update_stored, upsert_stored
from stockweave.sources import stored

NOW = datetime(2026, 4, 20, 12)


def offers(spark, n=4000):
    return spark.range(n).select(
        "id", (F.col("id") % 50).alias("supplier"), F.when(F.col("id") % 3 != 0, F.format_string("m%06d", "id")).alias("name"),
        F.lit(True).alias("is_active"),
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def on_disk(folder):
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(folder).glob("data/*/*.parquet")}


@pytest.fixture
def folder(spark, tmp_path):
    assert stored.create(offers(spark), str(tmp_path), ["id"], file_rows=100) == 1
    return str(tmp_path)


def test_upsert_replaces_only_files_with_changed_keys(spark, folder):
    before = on_disk(folder)
    assert len(before) >= 40
    changes = spark.createDataFrame(
        [(7, "a", 1), (7, "b", 2), (2001, None, 1), (90001, "new", 1), (90002, "", 1)], "id long, name string, sent int"
    )
    assert upsert_stored(folder, changes, ["id"], "sent", file_rows=100) == 2
    want = writes.upsert_by_key(offers(spark), changes, ["id"], "sent").drop("write_kind")
    assert rows_of(stored.read(spark, folder)) == rows_of(want)
    assert rows_of(stored.read(spark, folder, 1)) == rows_of(offers(spark))
    after = on_disk(folder)
    assert all(after[path] == content for path, content in before.items())
    old, new = (set(stored._listed(spark, folder, v)[0]) for v in (1, 2))
    assert len(old - new) == 2 and len(old & new) == len(before) - 2


def test_upsert_where_blank_and_null_are_one_key(spark, folder):
    changes = spark.createDataFrame([(3, "", 9, 1), (4, "m000004", 9, 1), (4, "", 8, 1)], "id long, name string, supplier long, sent int")
    upsert_stored(folder, changes, ["id", "name"], "sent", blank_as_null=("name",), file_rows=100)
    want = writes.upsert_by_key(offers(spark), changes, ["id", "name"], "sent", ("name",)).drop("write_kind")
    got = stored.read(spark, folder)
    assert rows_of(got) == rows_of(want) and got.count() == 4001


def test_update_and_deactivate_equal_the_whole_table_forms(spark, folder):
    changes = spark.createDataFrame([(5, 6, "x"), (8, 9, "m000010"), (99999, 1, "y")], "id long, supplier long, name string")
    version, rejects = update_stored(folder, changes, "id", ["name"], file_rows=100)
    rows, refused = writes.update_by_key(offers(spark), changes, "id", ["name"])
    assert version == 2 and rows_of(rejects) == rows_of(refused) and len(rejects.collect()) == 2
    assert rows_of(stored.read(spark, folder)) == rows_of(rows)
    ids = spark.createDataFrame([(1,), (1,), (3999,), (None,), (88888,)], "id long")
    assert deactivate_stored(folder, ids, "id") == 3
    assert rows_of(stored.read(spark, folder)) == rows_of(writes.deactivate(rows, ids, "id"))
    assert deactivate_stored(folder, ids.where("id > 50000"), "id") == 3


def test_lookups_of_a_write_are_cut_by_rows(spark, folder, monkeypatch):
    """Tasks hold a number of rows, however well their ids compress; a file is looked up by its number."""
    from stockweave.functions import joins
    from stockweave.sources.stored import files_with

    monkeypatch.setattr(joins, "PART_ROWS", 300)
    dealt, keep = [], joins.in_parts
    for module in (stored, writes):
        monkeypatch.setattr(module, "in_parts", lambda rows, parts, *c: dealt.append((rows, parts)) or keep(rows, parts, *c))
    keys = spark.createDataFrame([(7, None), (7, None), (2001, "m002001"), (None, "m000004"), (90001, "x")], "id long, name string")
    whole = [f for f in stored._listed(spark, folder, 1)[0]]
    hit = files_with(spark, folder, keys, ["id"])
    assert len(hit) == 2 and set(hit) < set(whole)
    assert {r.id for r in stored._read(spark, folder, hit).collect()} >= {7, 2001}
    assert [parts for _, parts in dealt] == [14, 14] and dict(dealt[0][0].dtypes) == {"k0": "bigint", "number": "int"}
    changes = spark.createDataFrame([(5, 90), (6, 91), (-1, 92)], "id long, supplier long")
    _, rejects = update_stored(folder, changes, "id", ["supplier"], file_rows=100)
    assert rows_of(rejects) == [(-1, "row_missing")]
    assert {parts for _, parts in dealt} == {14} and len(dealt) == 7


def test_audit_of_versions_reads_only_their_own_files(spark, folder):
    changes = offers(spark).where("id IN (11, 12, 3000)").withColumns({"supplier": F.lit(77).cast("long"), "sent": F.lit(1)})
    more = spark.createDataFrame([(-1, 1, "n", True, 1)], "id long, supplier long, name string, is_active boolean, sent int")
    new = upsert_stored(folder, changes.unionByName(more), ["id"], "sent", file_rows=100)
    before, after = stored.changed_rows(spark, folder, 1, new)
    assert before.count() <= 200 and after.count() == before.count() + 1
    got = audit_versions(spark, folder, 1, new, ["id"], "offers", NOW, 1)
    want = audit_diff(offers(spark), stored.read(spark, folder), ["id"], "offers", NOW, 1)
    assert rows_of(got) == rows_of(want) and got.count() == 4
    assert audit_versions(spark, folder, new, new, ["id"], "offers", NOW).count() == 0


def test_killed_write_leaves_the_version_before(spark, folder):
    def killed(rows):
        raise KeyboardInterrupt

    keys = spark.createDataFrame([(5,)], "id long")
    with pytest.raises(KeyboardInterrupt):
        stored.rewrite(folder, keys, ["id"], killed)
    assert stored.latest(spark, folder) == 1 and stored.read(spark, folder).count() == 4000
    with pytest.raises(FileExistsError):
        stored.create(offers(spark), folder, ["id"])


def test_appends_are_compacted_and_full_files_stay(spark, folder):
    first = on_disk(folder)
    for i in range(4):
        stored.append(folder, offers(spark, 3 + i).withColumn("id", F.col("id") + 10_000 * (i + 1)))
    rows, files = rows_of(stored.read(spark, folder)), stored._listed(spark, folder, 5)[0]
    assert len(rows) == 4018
    assert stored.compact(spark, folder, file_rows=100) == 6
    left = stored._listed(spark, folder, 6)[0]
    assert rows_of(stored.read(spark, folder)) == rows and len(left) < len(files)
    after = on_disk(folder)
    assert all(after[path] == content for path, content in first.items())
    full = {f"{folder}/{f}" for f in left} & set(first)
    assert len(full) >= 39
    assert audit_versions(spark, folder, 5, 6, ["id"], "offers", NOW).count() == 0
    stored.rewrite(folder, spark.createDataFrame([(20_000,)], "id long"), ["id"], lambda df: df.where("id != 20000"))
    assert stored.read(spark, folder).count() == 4017 and stored.read(spark, folder, 5).count() == 4018


def test_nothing_to_compact(spark, tmp_path):
    folder = str(tmp_path)
    stored.create(offers(spark, 0), folder, ["id"])
    assert stored.compact(spark, folder) == 1
    stored.append(folder, offers(spark, 0))
    assert stored.compact(spark, folder) == 3 and stored.read(spark, folder).count() == 0


def test_empty_stored_table(spark, tmp_path):
    stored.create(offers(spark, 0), str(tmp_path), ["id"])
    assert stored.read(spark, str(tmp_path)).count() == 0
    upsert_stored(str(tmp_path), offers(spark, 3).withColumn("sent", F.lit(1)), ["id"], "sent")
    assert rows_of(stored.read(spark, str(tmp_path))) == rows_of(offers(spark, 3))


def test_interval_and_day_share_one_node(spark):
    """Against plain comparison, for random, open, reversed, extreme and missing ends."""
    random = Random(3)
    days = [date(1, 1, 1), date(9999, 12, 31), date(1970, 1, 1), date(2024, 2, 29)]
    days += [date(2020, 1, 1) + timedelta(random.randrange(900)) for _ in range(40)]
    spans = [(a, b) for a in days[:12] for b in days[:12]] + [(d, None) for d in days[:12]] + [(None, days[0]), (None, None)]
    spans += [tuple(sorted(random.sample(days, 2))) for _ in range(80)]
    left = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, a date, b date")
    right = spark.createDataFrame([(j, d) for j, d in enumerate([*days, None])], "j int, d date")
    nodes = left.select("i", F.explode(nodes_of_interval(F.col("a"), F.col("b"))).alias("node"))
    pairs = nodes.join(right.select("j", F.explode(nodes_of_day(F.col("d"))).alias("node")), "node").select("i", "j")
    got = [tuple(r) for r in pairs.collect()]
    want = {
        (i, j) for i, (a, b) in enumerate(spans) for j, d in enumerate(days) if a is not None and a <= d and (b is None or d <= b)
    }
    assert len(got) == len(set(got)) and set(got) == want
    assert nodes.groupBy("i").count().agg(F.max("count")).first()[0] <= 2 * LEVELS


def test_cards_in_force_of_one_product_with_many_cards(spark):
    """10^5 batches and 10^4 cards of one product: rows that meet are the result, not all pairs."""
    first = F.lit("2000-01-01").cast("date")
    cards = spark.range(10_000).select(
        F.col("id").alias("tech_card_id"), F.lit(1).cast("long").alias("product_id"), F.lit("active").alias("status_code"),
        F.date_add(first, F.col("id").cast("int")).alias("effective_from"),
        F.when(F.col("id") < 9999, F.date_add(first, F.col("id").cast("int"))).alias("effective_to"),
    )
    uses = spark.range(100_000).select(
        F.col("id").alias("production_batch_id"), F.lit(1).cast("long").alias("product_id"),
        F.date_add(first, (F.col("id") % 10_003).cast("int")).alias("day"),
    )
    found = gates.cards_in_force(uses, cards)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 100_000
    wrong = found.where("tech_card_id != least(production_batch_id % 10003, 9999)")
    assert wrong.count() == 0
