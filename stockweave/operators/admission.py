"""First-come admission of requests that draw on shared, limited resources.

Requests are taken in the order (day, request_id). A request is accepted only if
every resource it needs still holds enough after the earlier accepted requests;
otherwise it is rejected as a whole and takes nothing. That is what handling the
requests one by one gives, computed for all of them at once.

A round brackets the outcome: counting every undecided earlier request as
accepted gives the least that can be left, counting none gives the most. A
request that fits the first bound is accepted, one that misses the second is
rejected, and only contested resources go on. There are at most ``ROUNDS`` rounds.

What is contested then depends on the order, as in a chain of requests in which
each shares a resource with the next. Requests and the resources they contest form
components, which do not touch each other. A task walks through its components one
after another, in request order, and keeps no rows: only what the resources of the
present component have given. The number of jobs thus does not depend on the length of a chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.components import components
from stockweave.functions.scan import crowded_keys, with_chunk
from stockweave.session import cut_lineage

AMOUNT = "decimal(38,10)"
#: Sums of amounts, which keep all places when two of them are added up.
_SUM = "decimal(36,10)"
_CHUNK = ["resource_id", "day", "_chunk"]

#: Most rounds of brackets before the walk.
ROUNDS = 3
#: Contested needs that one task walks through without a search for components.
WALK_ROWS = 500_000


def _positions(needs: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Adds where each need ends on its resource's axis, for two ways of counting.

    ``high`` counts all needs present, ``low`` only those of accepted requests.
    ``skip`` is the part of the axis that is gone by the need's day (expired
    stock): nobody can start before it, which turns the running total into a
    running maximum. The needs of a resource move once, together; only those of the
    ``crowded`` resources are cut into chunks.
    """
    if crowded is None:
        return _along_resources(needs)
    return _along_resources(needs.join(crowded, "resource_id", "left_anti")).unionByName(
        _along_chunks(needs.join(crowded, "resource_id", "left_semi"))
    )


def _along_resources(needs: DataFrame) -> DataFrame:
    """``_positions`` with a window per resource."""
    order = Window.partitionBy("resource_id").orderBy("day", "request_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("accepted"), F.col("quantity")).otherwise(0)
    offsets = needs.filter(F.col("resource_id").isNotNull()).select(
        "*",
        F.coalesce(F.sum("quantity").over(before), F.lit(0)).cast(_SUM).alias("o_high"),
        F.coalesce(F.sum(counted).over(before), F.lit(0)).cast(_SUM).alias("o_low"),
    )
    quantity, skip = F.col("quantity").cast(_SUM), F.col("skip").cast(_SUM)
    placed = offsets.select(
        *needs.columns,
        (F.col("o_high") + quantity + F.max(skip - F.col("o_high")).over(until)).cast(AMOUNT).alias("high"),
        (F.col("o_low") + quantity + F.max(skip - F.col("o_low")).over(until)).cast(AMOUNT).alias("low"),
    )
    # A need without a day takes its part of the axis, but no place on it.
    return placed.filter(F.col("day").isNotNull())


def _along_chunks(needs: DataFrame) -> DataFrame:
    """``_positions`` with a window per chunk and one over the totals of chunks."""
    totals = needs.groupBy(*_CHUNK).agg(
        F.sum("quantity").alias("t_high"),
        F.sum(F.when(F.col("accepted"), F.col("quantity")).otherwise(0)).alias("t_low"),
        F.max("skip").alias("skip"),
    )
    along = Window.partitionBy("resource_id").orderBy("day", "_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        totals.select(
            *_CHUNK,
            "skip",
            F.coalesce(F.sum("t_high").over(before), F.lit(0)).alias("o_high"),
            F.coalesce(F.sum("t_low").over(before), F.lit(0)).alias("o_low"),
        )
        .select(
            *[F.col(c).alias(f"k{c}") for c in _CHUNK],
            (F.col("o_high") + F.max(F.col("skip") - F.col("o_high")).over(until)).alias("base_high"),
            (F.col("o_low") + F.max(F.col("skip") - F.col("o_low")).over(until)).alias("base_low"),
        )
    )
    inside = Window.partitionBy(*_CHUNK).orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = needs.join(offsets, [F.col(c) == F.col(f"k{c}") for c in _CHUNK])
    counted = F.when(F.col("accepted"), F.col("quantity")).otherwise(0)
    return joined.select(
        *needs.columns,
        (F.col("base_high") + F.sum("quantity").over(inside)).cast(AMOUNT).alias("high"),
        (
            F.col("base_low")
            + F.sum(counted).over(inside)
            + F.when(F.col("accepted"), F.lit(0)).otherwise(F.col("quantity"))
        )
        .cast(AMOUNT)
        .alias("low"),
    )


def _walked(contested: DataFrame, split: bool) -> DataFrame:
    """The undecided requests of ``contested`` that are refused, in request order; ``split`` deals components to tasks.

    Rows arrive by component, day and request. An accepted request adds its needs to what its resources have given.
    """
    schema = "request_id " + contested.schema["request_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, request, open_request, fits = None, None, False, True
        given: dict[object, Decimal] = {}
        ends: dict[object, Decimal] = {}
        refused: list = []
        kind = None
        for batch in batches:
            kind = batch.schema.field("request_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in _WALK)):
                part, request_id, resource, quantity, skip, capacity, accepted = row
                if request_id != request or part != component:
                    if open_request and not fits:
                        refused.append(request)
                    elif fits:
                        given.update(ends)
                    if part != component:
                        given.clear()
                    component, request, open_request, fits = part, request_id, not accepted, True
                    ends.clear()
                end = max(given.get(resource, skip), skip) + quantity
                ends[resource] = end
                fits = fits and (accepted or end <= capacity)
            yield pa.RecordBatch.from_arrays([pa.array(refused, kind)], names=["request_id"])
            refused = []
        if open_request and not fits:
            yield pa.RecordBatch.from_arrays([pa.array([request], kind)], names=["request_id"])

    if split:
        label = cut_lineage(_components(contested))
        rows = contested.join(label, "resource_id").repartition("component")
    else:
        rows = contested.withColumn("component", F.lit(0).cast("bigint")).repartition(1)
    ordered = rows.sortWithinPartitions("component", "day", "request_id").select(*_WALK)
    return cut_lineage(ordered.mapInArrow(walk, schema))


_WALK = ["component", "request_id", "resource_id", "quantity", "skip", "capacity", "accepted"]


def _components(contested: DataFrame) -> DataFrame:
    """(resource_id, component): resources that undecided requests share, directly or over others."""
    undecided = contested.filter(~F.col("accepted"))
    resource = F.xxhash64(F.lit("resource"), "resource_id")
    request = F.xxhash64(F.lit("request"), "request_id")
    label = components(undecided.select(request.alias("a"), resource.alias("b")))
    return (
        contested.select("resource_id").distinct().withColumn("node", resource).join(label, "node").select("resource_id", "component")
    )


def admit(needs: DataFrame, capacity: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits requests into accepted needs and rejected request ids.

    ``needs``: request_id, resource_id, day, quantity (> 0, one row per request
    and resource) and skip (0 where nothing expires; never falls with day).
    ``capacity``: resource_id, capacity. A resource without a row has none. Without this table
    ``needs`` has a column capacity, the same in all rows of a resource.

    Returns the accepted needs with start_at and end_at on the axis of their
    resource, and the rejected ids. Both stand on tables written to the
    shared folder.
    """
    if capacity is not None:
        needs = needs.join(capacity.select("resource_id", "capacity"), "resource_id", "left")
    prepared = needs.select(
        "request_id",
        "resource_id",
        "day",
        F.col("quantity").cast(AMOUNT).alias("quantity"),
        F.col("skip").cast(AMOUNT).alias("skip"),
        F.coalesce(F.col("capacity").cast(AMOUNT), F.lit(0)).cast(AMOUNT).alias("capacity"),
    )
    prepared = cut_lineage(prepared)
    crowded = crowded_keys(prepared, "resource_id")
    if crowded is not None:
        prepared = cut_lineage(with_chunk(prepared, "request_id"))

    of_request = Window.partitionBy("request_id")
    refused: list[DataFrame] = []
    contested = prepared.withColumn("accepted", F.lit(False))
    for number in range(1, ROUNDS + 1):
        placed = _positions(contested, crowded).select(
            *prepared.columns,
            "accepted",
            (F.col("high") > F.col("capacity")).alias("is_tight"),
            (F.col("low") > F.col("capacity")).alias("is_short"),
        )
        fits = F.bool_and(~F.col("is_tight")).over(of_request)
        misses = F.bool_or("is_short").over(of_request)
        judged = cut_lineage(
            placed.select(
                *prepared.columns,
                "is_tight",
                (F.col("accepted") | fits).alias("accepted"),
                (~F.col("accepted") & misses).alias("refused"),
            )
        )
        refused.append(judged.filter("refused").select("request_id").distinct())
        undecided = judged.filter(~F.col("accepted") & ~F.col("refused"))
        open_needs = undecided.count()
        if not open_needs:
            break
        tight = undecided.filter("is_tight").select("resource_id").distinct()
        contested = judged.filter(~F.col("refused")).join(tight, "resource_id", "left_semi").drop("is_tight", "refused")
        if open_needs <= WALK_ROWS or number == ROUNDS:
            refused.append(_walked(cut_lineage(contested), open_needs > WALK_ROWS))
            break

    refused_ids = reduce(DataFrame.unionByName, refused)
    kept = prepared.join(refused_ids, "request_id", "left_anti").withColumn("accepted", F.lit(True))
    accepted = _positions(kept, crowded).select(
        "request_id",
        "resource_id",
        "day",
        "quantity",
        (F.col("high") - F.col("quantity")).cast(AMOUNT).alias("start_at"),
        F.col("high").alias("end_at"),
    )
    return accepted, refused_ids
