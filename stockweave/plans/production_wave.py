"""A wave of production status requests, from validation to new stock."""

from __future__ import annotations

from collections import ChainMap
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.operators.fefo import batch_demand, fefo_allocate, feasibility_of_lots, lots_for, recipe_requirement
from stockweave.operators.gates import valid_tech_cards
from stockweave.operators.movements import apply_consumption, finalize_batches
from stockweave.operators.rules import rows_with_unfit_user
from stockweave.operators.transitions import validate_transitions
from stockweave.session import cut_lineage


@dataclass
class ProductionWave:
    judged: DataFrame
    takes: DataFrame
    material_stock: DataFrame
    new_lots: DataFrame


def judge_production_requests(t, requests: DataFrame) -> DataFrame:
    """Requests (production_batch_id, new_status) with a reject reason, before any stock is taken.

    Checked in this order: edge, responsible user, tech card, stock (starting) or
    an existing lot (completing). A target that the status dictionary does not
    know is refused at the end.
    """
    t = _of_requests(t, requests)
    early = _judge_early(t, requests)
    return _judge_stock(t, early, _open_lots(t, early, ["in_progress"]))


def _of_requests(t, requests: DataFrame) -> ChainMap:
    """The tables with only the batches that the requests name, as a table in the shared folder: it is read many times."""
    named = t["production_batches"].join(requests, "production_batch_id", "left_semi")
    return ChainMap({"production_batches": cut_lineage(named)}, t)


def _judge_early(t, requests: DataFrame) -> DataFrame:
    """The requests judged by all that comes before the stock, with early_reason; a table in the shared folder."""
    batches = t["production_batches"]
    edges = validate_transitions(batches, requests, "production_batch_id", "production")
    uses = batches.select(
        "production_batch_id", "product_id", "tech_card_id", F.to_date("production_date").alias("day")
    )
    cards = valid_tech_cards(uses, t["tech_cards"], t["products"]).select(
        "production_batch_id", F.col("reject_reason").alias("card_reason")
    )
    unfit = rows_with_unfit_user(t, "production_batches", "responsible_user_id", ("technologist",)).select(
        "production_batch_id", F.lit(True).alias("is_unfit")
    )
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("is_unfit"), "responsible_not_technologist")
        .otherwise(F.col("card_reason"))
    )
    return cut_lineage(
        edges.join(unfit, "production_batch_id", "left")
        .join(cards, "production_batch_id", "left")
        .select("production_batch_id", "current_status", "new_status", reason.alias("early_reason"))
    )


def _open_batches(t, early: DataFrame, statuses: list[str]) -> DataFrame:
    """The batches with a request for one of the statuses that nothing has refused yet."""
    asked = early.filter(F.col("early_reason").isNull() & F.col("new_status").isin(statuses))
    return t["production_batches"].join(asked, "production_batch_id", "left_semi")


def _open_lots(t, early: DataFrame, statuses: list[str]) -> DataFrame:
    """The lots of the materials that open requests for the statuses ask for; a table in the shared folder."""
    asked = _open_batches(t, early, statuses)
    return cut_lineage(lots_for(asked, t["recipe_items"], t["raw_material_stock"], t["quality_checks"]))


def _judge_stock(t, early: DataFrame, lots: DataFrame) -> DataFrame:
    """The requests of ``_judge_early`` judged by what is in stock; only open ones are compared with the lots."""
    feasible = (
        feasibility_of_lots(_open_batches(t, early, ["in_progress"]), t["recipe_items"], lots)
        .filter(F.col("verdict") != "ok")
        .groupBy("production_batch_id")
        .agg(F.min_by("verdict", F.coalesce("material_id", F.lit(-1))).alias("stock_reason"))
    )
    _, stocked = finalize_batches(t["production_batches"], t["finished_goods_stock"], t["products"])
    known = t["production_statuses"].select(F.col("status_code").alias("new_status"), F.lit(True).alias("is_known"))
    reason = (
        F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
        .when(F.col("stock_reason").isNotNull(), F.col("stock_reason"))
        .when((F.col("new_status") == "completed") & F.col("stocked_reason").isNotNull(), F.col("stocked_reason"))
        .when(F.col("is_known").isNull(), "status_unknown")
    )
    return (
        early.join(feasible, "production_batch_id", "left")
        .join(stocked.withColumnRenamed("reject_reason", "stocked_reason"), "production_batch_id", "left")
        .join(known, "new_status", "left")
        .select("production_batch_id", "current_status", "new_status", reason.alias("reject_reason"))
    )


def run_production_wave(t, requests: DataFrame, now: datetime) -> ProductionWave:
    """Applies a wave: completed batches take their materials and put finished lots on stock.

    Batches that find too little material are refused as a whole. The lots of the materials that open requests
    ask for are looked up once, for the judgement and for the allocation.
    """
    t = _of_requests(t, requests)
    early = _judge_early(t, requests)
    lots = _open_lots(t, early, ["in_progress", "completed"])
    judged = cut_lineage(_judge_stock(t, early, lots))
    completing = judged.filter(F.col("reject_reason").isNull() & (F.col("new_status") == "completed"))
    batches = t["production_batches"].join(completing, "production_batch_id", "left_semi")
    recipe = t["recipe_items"]
    bare = batches.join(recipe.select("tech_card_id"), "tech_card_id", "left_anti").select("production_batch_id")
    demand = batch_demand(recipe_requirement(batches, recipe))
    takes, short = fefo_allocate(demand, lots)
    takes = cut_lineage(takes)
    refused = short.withColumn("late_reason", F.lit("insufficient")).unionByName(
        bare.withColumn("late_reason", F.lit("no_recipe"))
    )
    judged = judged.join(refused, "production_batch_id", "left").select(
        "production_batch_id",
        "current_status",
        "new_status",
        F.coalesce("reject_reason", "late_reason").alias("reject_reason"),
    )
    stock, _ = apply_consumption(t["raw_material_stock"], takes, "stock_id", now)
    done = batches.join(refused, "production_batch_id", "left_anti")
    lots, _ = finalize_batches(done, t["finished_goods_stock"], t["products"])
    return ProductionWave(judged, takes, stock, lots)
