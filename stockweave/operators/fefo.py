"""First-expired-first-out allocation of material lots to production batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.scan import crowded_keys, running_total
from stockweave.operators.admission import AMOUNT, admit
from stockweave.operators.gates import approved_keys, stock_from_day
from stockweave.session import cut_lineage

#: Target number of interval starts handled by one task of the overlap step.
ROWS_PER_CHUNK = 200_000


def recipe_requirement(batches: DataFrame, recipe_items: DataFrame) -> DataFrame:
    """Material needed per batch and recipe line: produced x quantity x (1 + waste / 100)."""
    waste = F.coalesce(F.col("waste_percent"), F.lit(0).cast("decimal(5,2)"))
    factor = F.lit(1).cast("decimal(5,2)") + (waste / F.lit(100).cast("decimal(3,0)")).cast("decimal(7,4)")
    lines = recipe_items.select(
        "tech_card_id", "recipe_item_id", "material_id", F.col("quantity").alias("recipe_qty"), factor.alias("factor")
    )
    return batches.join(lines, "tech_card_id").select(
        "production_batch_id",
        F.to_date("production_date").alias("day"),
        "recipe_item_id",
        "material_id",
        (F.col("quantity_produced") * F.col("recipe_qty") * F.col("factor")).cast("decimal(28,10)").alias("required_qty"),
    )


def batch_demand(requirement: DataFrame) -> DataFrame:
    """Demand per batch and material; lines of several stages are added up."""
    return requirement.groupBy("production_batch_id", "day", "material_id").agg(
        F.sum("required_qty").cast(AMOUNT).alias("quantity")
    )


def gated_lots(stock: DataFrame, checks: DataFrame) -> DataFrame:
    """Material lots in stock, with the quantity that passed quality control."""
    approved = approved_keys(checks, "delivery_item_id", "raw_material").withColumn("is_approved", F.lit(True))
    return (
        stock.filter(F.col("quantity_current") > 0)
        .join(approved, "delivery_item_id", "left")
        .select(
            "stock_id",
            "material_id",
            "expiry_date",
            F.when(F.col("is_approved"), F.col("quantity_current")).otherwise(0).alias("gated"),
            F.col("quantity_current").alias("ungated"),
        )
    )


def lots_for(
    batches: DataFrame, recipe_items: DataFrame, stock: DataFrame, checks: DataFrame
) -> DataFrame:
    """``gated_lots`` of the materials that the recipes of the batches name."""
    named = recipe_items.join(batches.select("tech_card_id"), "tech_card_id", "left_semi").select("material_id").distinct()
    return gated_lots(stock.join(named, "material_id", "left_semi"), checks)


def production_feasibility(
    batches: DataFrame, recipe_items: DataFrame, stock: DataFrame, checks: DataFrame
) -> DataFrame:
    """``feasibility_of_lots`` against the present stock."""
    return feasibility_of_lots(batches, recipe_items, gated_lots(stock, checks))


def feasibility_of_lots(batches: DataFrame, recipe_items: DataFrame, lots: DataFrame) -> DataFrame:
    """Dry run of every batch against the lots (``gated_lots``), one row per batch and material.

    ``verdict`` is ok, not_quality_approved, insufficient, or no_recipe (then
    without a material).
    """
    demand = batch_demand(recipe_requirement(batches, recipe_items))
    left = stock_from_day(lots, demand)
    verdict = (
        F.when((F.col("ungated_left") > 0) & (F.col("gated_left") == 0), "not_quality_approved")
        .when(F.col("gated_left") < F.col("quantity"), "insufficient")
        .otherwise("ok")
    )
    checked = demand.join(left, ["material_id", "day"]).select(
        "production_batch_id",
        "material_id",
        F.col("quantity").alias("required_qty"),
        F.col("gated_left").alias("available_qty"),
        verdict.alias("verdict"),
    )
    bare = batches.join(recipe_items.select("tech_card_id"), "tech_card_id", "left_anti").select(
        "production_batch_id",
        F.lit(None).cast("bigint").alias("material_id"),
        F.lit(None).cast(AMOUNT).alias("required_qty"),
        F.lit(None).cast(AMOUNT).alias("available_qty"),
        F.lit("no_recipe").alias("verdict"),
    )
    return checked.unionByName(bare)


def _cut_by_depth(starts: DataFrame) -> DataFrame:
    """``starts`` as a table with ``chunk``, which never falls along the axis of a resource.

    Chunks are the ranges of a sort by resource and place, whose bounds Spark samples: they hold about
    ``ROWS_PER_CHUNK`` rows each, however the starts crowd on an axis. The table fixes them for every later use.
    """
    starts = cut_lineage(starts)
    chunks = 1 + starts.count() // ROWS_PER_CHUNK
    if chunks == 1:
        return starts.withColumn("chunk", F.lit(0))
    ranged = starts.repartitionByRange(chunks, "resource_id", "start_at")
    return cut_lineage(ranged.withColumn("chunk", F.spark_partition_id()))


def _overlaps(lots: DataFrame, demand: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Pairs of overlapping intervals on the axis of each material, with the overlap.

    Neither side overlaps itself, so walking the starts of both sides in order
    and remembering the latest start of each side meets every overlapping pair
    once: the output grows with lots + demands, never with their product. The
    axes of materials with many rows in ``among``, by default in the starts themselves, are cut into chunks of about as many
    starts; what is open at a chunk's edge comes from the chunk summaries.
    """
    lot = F.struct("stock_id", F.col("end_at").alias("end_at"))
    need = F.struct("request_id", F.col("end_at").alias("end_at"))
    starts = lots.select(
        "resource_id", "start_at", F.lit(0).alias("side"), lot.alias("lot"), F.lit(None).alias("need")
    ).unionByName(
        demand.select("resource_id", "start_at", F.lit(1).alias("side"), F.lit(None).alias("lot"), need.alias("need"))
    )
    crowded = crowded_keys(starts if among is None else among, "resource_id")
    upto = Window.partitionBy("resource_id").orderBy("start_at", "side").rowsBetween(Window.unboundedPreceding, 0)
    walked = (starts if crowded is None else starts.join(crowded, "resource_id", "left_anti")).select(
        "resource_id",
        "start_at",
        F.last("lot", ignorenulls=True).over(upto).alias("lot"),
        F.last("need", ignorenulls=True).over(upto).alias("need"),
    )
    if crowded is not None:
        walked = walked.unionByName(_walked_in_chunks(starts.join(crowded, "resource_id", "left_semi")))
    return walked.select(
        F.col("need.request_id").alias("request_id"),
        "resource_id",
        F.col("lot.stock_id").alias("stock_id"),
        (F.least("lot.end_at", "need.end_at") - F.col("start_at")).cast(AMOUNT).alias("take_qty"),
    ).filter(
        F.col("resource_id").isNotNull()
        & F.col("request_id").isNotNull()
        & F.col("stock_id").isNotNull()
        & (F.col("take_qty") > 0)
    )


def _walked_in_chunks(starts: DataFrame) -> DataFrame:
    """(resource_id, start_at, lot, need): at each start, the latest lot and need of the material."""
    placed = _cut_by_depth(starts)

    latest = {
        side: F.max(F.when(F.col(side).isNotNull(), F.struct("start_at", side))).alias(side) for side in ("lot", "need")
    }
    before = Window.partitionBy("resource_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("resource_id", "chunk").agg(*latest.values()).select(
        F.col("resource_id").alias("k_resource"),
        F.col("chunk").alias("k_chunk"),
        F.last(F.col("lot.lot"), ignorenulls=True).over(before).alias("open_lot"),
        F.last(F.col("need.need"), ignorenulls=True).over(before).alias("open_need"),
    )
    upto = (
        Window.partitionBy("resource_id", "chunk")
        .orderBy("start_at", "side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return placed.join(
        carried, (F.col("resource_id") == F.col("k_resource")) & (F.col("chunk") == F.col("k_chunk"))
    ).select(
        "resource_id",
        "start_at",
        F.coalesce(F.last("lot", ignorenulls=True).over(upto), F.col("open_lot")).alias("lot"),
        F.coalesce(F.last("need", ignorenulls=True).over(upto), F.col("open_need")).alias("need"),
    )


def _expired_by_day(usable: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (resource_id, day) of ``wanted``: skip, the quantity that expired before, and capacity, that of all days.

    Lots are first added up per expiry day, so a window holds at most one row per calendar day on either side.
    """
    daily = usable.groupBy("resource_id", F.col("expiry_date").alias("day")).agg(F.sum("gated").cast(AMOUNT).alias("gated"))
    asked = wanted.select("resource_id", "day").distinct()
    rows = daily.withColumn("is_lot", F.lit(1)).unionByName(
        asked.select("*", F.lit(None).cast(AMOUNT).alias("gated"), F.lit(0).alias("is_lot"))
    )
    axis = Window.partitionBy("resource_id")
    before = axis.orderBy("day", "is_lot").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "resource_id",
        "day",
        "is_lot",
        F.coalesce(F.sum("gated").over(before), F.lit(0)).cast(AMOUNT).alias("skip"),
        F.coalesce(F.sum("gated").over(axis), F.lit(0)).cast(AMOUNT).alias("capacity"),
    ).filter(F.col("is_lot") == 0).drop("is_lot")


def _shelves(usable: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """(resource_id, stock_id, start_at, end_at) of the lots, in expiry order on the axis of their material."""

    def ends(lots: DataFrame) -> DataFrame:
        until = Window.partitionBy("resource_id").orderBy("expiry_date", "stock_id").rowsBetween(Window.unboundedPreceding, 0)
        # Lots without a day are the first on an axis and serve nobody.
        return lots.withColumn("end_at", F.sum("gated").over(until)).filter(F.col("expiry_date").isNotNull())

    def ends_by_chunk(lots: DataFrame) -> DataFrame:
        return running_total(lots, ["resource_id"], ["expiry_date", "stock_id"], {"gated": "end_at"}, group_by_day="expiry_date")

    if crowded is None:
        placed = ends(usable)
    else:
        placed = ends(usable.join(crowded, "resource_id", "left_anti")).unionByName(
            ends_by_chunk(usable.join(crowded, "resource_id", "left_semi")).select(*usable.columns, "end_at")
        )
    return placed.select(
        "resource_id",
        "stock_id",
        (F.col("end_at") - F.col("gated")).cast(AMOUNT).alias("start_at"),
        F.col("end_at").cast(AMOUNT).alias("end_at"),
    )


def fefo_allocate(demand: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes lots for batches, earliest expiry first, each batch all or nothing.

    ``demand``: production_batch_id, day, material_id, quantity. Batches are
    served in the order (day, production_batch_id); a lot serves a batch only if
    it expires on the batch's day or later. ``lots``: as from ``gated_lots``;
    only the approved quantity is used.

    Returns (production_batch_id, material_id, stock_id, take_qty) and the ids
    of the rejected batches.

    Lots in expiry order and batches in day order lie on one axis per material.
    Expired stock is always a prefix of that axis, so it only pushes a batch's
    start forward. Both stay whole in one task per material unless it is crowded.
    """
    demand = cut_lineage(demand)
    wanted = demand.filter(F.col("quantity") > 0).withColumnRenamed("material_id", "resource_id")
    approved = lots.filter(F.col("gated") > 0).select(
        F.col("material_id").alias("resource_id"),
        "expiry_date",
        "stock_id",
        F.col("gated").cast(AMOUNT).alias("gated"),
    )
    usable = cut_lineage(approved)
    needs = wanted.join(_expired_by_day(usable, wanted), ["resource_id", "day"]).select(
        F.col("production_batch_id").alias("request_id"), "resource_id", "day", "quantity", "skip", "capacity"
    )
    accepted, rejected = admit(needs)
    among = usable.select("resource_id").unionAll(wanted.select("resource_id"))
    shelves = _shelves(usable, crowded_keys(usable, "resource_id"))
    takes = _overlaps(shelves, accepted, among).select(
        F.col("request_id").alias("production_batch_id"),
        F.col("resource_id").alias("material_id"),
        "stock_id",
        "take_qty",
    )
    return takes, rejected.withColumnRenamed("request_id", "production_batch_id")
