"""FEFO and admission against plain sequential loops, and what must hold for any allocation."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import brute_force
from stockweave.functions.components import components
from stockweave.operators import admission, fefo, movements
from stockweave.operators.admission import admit

DAY = date(2026, 4, 1)


def random_case(seed, materials=3, batches=25, lots=20):
    rng = random.Random(seed)
    demand = [
        (b, DAY + timedelta(days=rng.randrange(6)), m, D(rng.randrange(1, 60)) / 10)
        for b in range(batches)
        for m in rng.sample(range(materials), rng.randrange(1, materials + 1))
    ]
    days = {}
    demand = [(b, days.setdefault(b, day), m, q) for b, day, m, q in demand]
    shelf = [
        (s, rng.randrange(materials), DAY + timedelta(days=rng.randrange(-1, 8)), D(rng.randrange(1, 80)) / 10)
        for s in range(lots)
    ]
    return demand, shelf


def as_frames(spark, demand, shelf):
    d = spark.createDataFrame(demand, "production_batch_id bigint, day date, material_id bigint, quantity decimal(28,10)")
    lots = spark.createDataFrame(
        shelf, "stock_id bigint, material_id bigint, expiry_date date, gated decimal(12,3)"
    ).withColumn("ungated", F.col("gated"))
    return d, lots


@pytest.mark.parametrize("seed", range(4))
def test_fefo_equals_sequential_loop(spark, seed):
    demand, shelf = random_case(seed)
    takes, rejected = fefo.fefo_allocate(*as_frames(spark, demand, shelf))
    got = {(r.production_batch_id, r.material_id, r.stock_id): r.take_qty for r in takes.collect()}
    want, refused = brute_force.fefo(demand, shelf)
    assert got == want
    assert {r.production_batch_id for r in rejected.collect()} == refused


def test_fefo_on_supplied_data(spark, small):
    batches = small["production_batches"].filter(F.col("status_code").isin("planned", "in_progress"))
    demand = fefo.batch_demand(fefo.recipe_requirement(batches, small["recipe_items"]))
    lots = fefo.gated_lots(small["raw_material_stock"], small["quality_checks"])
    takes, rejected = fefo.fefo_allocate(demand, lots)
    got = {(r.production_batch_id, r.material_id, r.stock_id): r.take_qty for r in takes.collect()}
    asked = [tuple(r) for r in demand.select("production_batch_id", "day", "material_id", "quantity").collect()]
    shelf = [tuple(r) for r in lots.filter("gated > 0").select("stock_id", "material_id", "expiry_date", "gated").collect()]
    want, refused = brute_force.fefo(asked, shelf)
    assert got == want
    assert {r.production_batch_id for r in rejected.collect()} == refused

    # Conservation: every batch gets all it asked for or nothing; no lot gives more than it has.
    given, used = defaultdict(D), defaultdict(D)
    for (batch, material, stock), qty in got.items():
        given[(batch, material)] += qty
        used[stock] += qty
    wanted = {(b, m): q for b, _, m, q in asked if b not in refused}
    assert given == wanted
    held = {s: q for s, _, _, q in shelf}
    assert all(qty <= held[s] for s, qty in used.items())


def test_fefo_with_one_hot_material(spark):
    """All batches and lots share one material; the chunked walk must not lose or repeat a piece."""
    rng = random.Random(7)
    demand = [(b, DAY + timedelta(days=b % 3), 1, D(rng.randrange(1, 30)) / 10) for b in range(300)]
    shelf = [(s, 1, DAY + timedelta(days=rng.randrange(0, 5)), D(rng.randrange(1, 30)) / 10) for s in range(250)]
    rows = fefo.ROWS_PER_CHUNK
    fefo.ROWS_PER_CHUNK = 20
    try:
        takes, rejected = fefo.fefo_allocate(*as_frames(spark, demand, shelf))
        got = {(r.production_batch_id, r.material_id, r.stock_id): r.take_qty for r in takes.collect()}
    finally:
        fefo.ROWS_PER_CHUNK = rows
    want, refused = brute_force.fefo(demand, shelf)
    assert got == want
    assert {r.production_batch_id for r in rejected.collect()} == refused


@pytest.mark.parametrize("seed", range(3))
def test_admission_equals_sequential_loop(spark, seed):
    rng = random.Random(seed)
    needs = []
    for request in range(60):
        qty = D(rng.randrange(1, 9))
        for resource in {f"lot:{rng.randrange(5)}", f"line:{rng.randrange(8)}"}:
            needs.append((f"r{request:03d}", resource, DAY, qty, D(0)))
    capacity = {f"lot:{i}": D(30) for i in range(5)} | {f"line:{i}": D(20) for i in range(7)}
    df = spark.createDataFrame(
        needs, "request_id string, resource_id string, day date, quantity decimal(12,3), skip decimal(12,3)"
    )
    caps = spark.createDataFrame(list(capacity.items()), "resource_id string, capacity decimal(12,3)")
    accepted, refused = admit(df, caps)
    want = brute_force.admit([(r, k, q) for r, k, _, q, _ in needs], capacity)
    assert {r.request_id for r in refused.collect()} == want
    assert {r.request_id for r in accepted.collect()} == {n[0] for n in needs} - want


@pytest.mark.parametrize("seed", range(3))
def test_admission_by_components(spark, seed, monkeypatch):
    """The walk through components gives what the sequential loop gives, also without any split by size."""
    monkeypatch.setattr(admission, "WALK_ROWS", 0)
    monkeypatch.setattr(admission, "ROUNDS", 1 + seed % 2)
    rng = random.Random(seed)
    needs, left = [], {}
    for request in range(90):
        group = request % 3
        for resource in {f"lot:{group}:{rng.randrange(4)}" for _ in range(2)}:
            skip = D(max(0, request // 30 - 1) * 5)
            needs.append((f"r{request:03d}", resource, DAY + timedelta(days=request // 30), D(rng.randrange(1, 9)), skip))
            left[resource] = D(40)
    df = spark.createDataFrame(
        needs, "request_id string, resource_id string, day date, quantity decimal(12,3), skip decimal(12,3)"
    )
    caps = spark.createDataFrame(list(left.items()), "resource_id string, capacity decimal(12,3)")
    accepted, refused = admit(df, caps)
    place, by_request = defaultdict(D), defaultdict(list)
    for request, resource, day, qty, skip in needs:
        by_request[(day, request)].append((resource, qty, skip))
    want = set()
    for key in sorted(by_request):
        ends = {r: max(place[r], skip) + qty for r, qty, skip in by_request[key]}
        if any(end > left[r] for r, end in ends.items()):
            want.add(key[1])
        else:
            place.update(ends)
    assert {r.request_id for r in refused.collect()} == want and len(want) > 5
    assert {r.request_id for r in accepted.collect()} == {n[0] for n in needs} - want


def _chain(n):
    """Each request needs all of its own resource and of the next, so every second one is refused."""
    return [(f"r{i:07d}", f"m{i + j:07d}", DAY, D(1), D(0)) for i in range(n) for j in (0, 1)]


def test_admission_of_a_long_chain_takes_few_jobs(spark, monkeypatch):
    written = []

    def counting(df, keep=admission.cut_lineage):
        written.append(1)
        return keep(df)

    monkeypatch.setattr(admission, "cut_lineage", counting)
    counts = []
    for n in (24, 100_000):
        written.clear()
        df = spark.createDataFrame(
            _chain(n), "request_id string, resource_id string, day date, quantity decimal(12,3), skip decimal(12,3)"
        )
        caps = spark.range(n + 1).select(F.format_string("m%07d", "id").alias("resource_id"), F.lit(D(1)).alias("capacity"))
        _, refused = admit(df, caps)
        assert {r.request_id for r in refused.collect()} == {f"r{i:07d}" for i in range(1, n, 2)}
        counts.append(len(written))
    assert counts[0] == counts[1] <= 4


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 700)] + [(5000, 5001 + i) for i in range(300)] + [(9, 9), (6000, 8), (8, 6001)]
    random.Random(1).shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == (
        {i: 10 for i in range(10, 701)} | {i: 5000 for i in range(5000, 5301)} | {9: 9} | {8: 8, 6000: 8, 6001: 8}
    )
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_overlaps_cut_crowded_axes_by_depth(spark, monkeypatch):
    """A million small needs on a hundredth of the axis beside one large lot: chunks of like size, nothing lost."""
    monkeypatch.setattr(fefo, "ROWS_PER_CHUNK", 50_000)
    n = 1_000_000
    unit = "decimal(38,10)"
    demand = spark.range(n).selectExpr(
        "id AS request_id", "1L AS resource_id", f"CAST(id AS {unit}) AS start_at", f"CAST(id + 1 AS {unit}) AS end_at"
    )
    lots = spark.createDataFrame([(7, 1, D(0), D(100 * n))], f"stock_id bigint, resource_id bigint, start_at {unit}, end_at {unit}")
    sizes = [r["count"] for r in fefo._cut_by_depth(demand.select("resource_id", "start_at")).groupBy("chunk").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 2 * n / len(sizes)
    takes = fefo._overlaps(lots, demand)
    assert takes.agg(F.count("*"), F.sum("take_qty"), F.max("take_qty")).first() == (n, D(n), D(1))


def test_consumption_guard(spark, small):
    lots = small["finished_goods_stock"]
    one = lots.filter("quantity_current > 10").orderBy("finished_stock_id").first()
    key = one.finished_stock_id

    def takes(*quantities):
        return spark.createDataFrame([(key, D(q)) for q in quantities], "finished_stock_id bigint, take_qty decimal(28,10)")

    from datetime import datetime

    now = datetime(2026, 4, 1)
    after, short = movements.apply_consumption(lots, takes("1.2344", "1.2341"), "finished_stock_id", now)
    left = after.filter(F.col("finished_stock_id") == key).first().quantity_current
    assert left == (one.quantity_current - D("2.4685")).quantize(D("0.001"), rounding="ROUND_HALF_UP")
    assert short.count() == 0
    after, short = movements.apply_consumption(lots, takes("100000"), "finished_stock_id", now)
    assert after.filter(F.col("finished_stock_id") == key).first().quantity_current == one.quantity_current
    assert [r.finished_stock_id for r in short.collect()] == [key]


def _allocation_inputs(spark):
    """Forty batches that contest lots of three materials, some expired or of other materials."""
    rng = random.Random(5)
    demand = [(b, DAY + timedelta(days=b % 4), m, D(rng.randrange(1, 9))) for b in range(40) for m in rng.sample(range(3), 2)]
    lots = [(f"s{i:03d}", i % 5, DAY + timedelta(days=rng.randrange(-1, 6)), D(rng.randrange(1, 12)), D(0)) for i in range(60)]
    lots += [("none0", 0, None, D(3), D(0)), ("none1", 1, None, D(2), D(0))]
    return (
        spark.createDataFrame(demand, "production_batch_id bigint, day date, material_id bigint, quantity decimal(28,10)"),
        spark.createDataFrame(
            lots, "stock_id string, material_id bigint, expiry_date date, gated decimal(12,3), ungated decimal(12,3)"
        ),
    )


def test_crowded_materials_are_allocated_as_others(spark, monkeypatch):
    from stockweave.functions import scan

    demand, lots = _allocation_inputs(spark)
    found = []
    for rows in (200_000, 30):
        monkeypatch.setattr(scan, "WINDOW_ROWS", rows)
        takes, refused = fefo.fefo_allocate(demand, lots)
        found.append((sorted(map(tuple, takes.collect())), sorted(map(tuple, refused.collect()))))
    assert found[0] == found[1] and found[0][0] and found[0][1]


def test_needs_move_once_along_their_axis(spark):
    """Without a crowded material, positions take one shuffle of the needs and no join."""
    needs = spark.createDataFrame(
        [(1, 1, DAY, D(1), D(0), D(5), False)],
        "request_id bigint, resource_id bigint, day date, quantity decimal(38,10), skip decimal(38,10), "
        "capacity decimal(38,10), accepted boolean",
    )
    plan = admission._positions(needs, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
