"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the corpus are the seats, in blocks of equal size. Sources get
blocks by the highest quotients target / (2 k - 1). The documents of a source are dealt
to shards of about ``shard_words`` words, which share the blocks of the source
in the same way by their words. Inside a shard, documents stand in seeded order
on a line cut into blocks; a quota of several times the line takes all blocks so
many times, and the rest of the quota takes blocks in a seeded order.

No task sees a whole source: windows run over one shard or over a table of sources.

Cases: null text and text without words have size 0 and are never taken; a null source is a source
of its own, last in order; rows that repeat a doc_id are told apart by their text, and equal rows get equal
shares; empty tables give empty results; other columns are ignored or, by ``mix``, returned
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import join_same, let, md5_number, n_words, packed, text_key, unpacked
from stockweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 22
SEED = 17
#: A prime above any number of blocks in a shard: multiplying by it permutes the blocks.
STEP = 2654435761


def seeded(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts, joined by colons; null parts are empty."""
    return md5_number(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def source_key(source: Column) -> Column:
    """The source as a key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit(">")).otherwise(F.concat(F.lit("="), source))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Adds ``target`` to (source_key, source_size): the share by weight, at most ``ceiling`` sizes.

    A source stops at its ceiling if the words of all sources, filled by weight up
    to the level where it stops, do not use up the corpus; the others share the rest by weight.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(Window.partitionBy("_all").orderBy("source_key")) - 1) % len(weights) + 1).cast("int"),
    )
    every = Window.partitionBy("_all")
    by_level = every.orderBy("_level", "source_key").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        sources.withColumn("_all", F.lit(0))
        .withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("_level", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_open", F.sum("_weight").over(every) - F.sum("_weight").over(by_level))
        .withColumn("_full", F.sum("_limit").over(by_level) + F.col("_level") * F.col("_open") <= F.col("_total"))
    )
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(every), F.lit(0.0))
    sharing = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(every)
    share = (F.col("_total") - spent) * F.col("_weight") / sharing
    return filled.select(
        "source_key", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(share).alias("target")
    )


def apportion(rows: DataFrame, group: str, key: str, claim: str, seats: str, quota: str = "quota") -> DataFrame:
    """Adds ``quota``: the ``seats`` of a group go to the highest quotients claim / (2 k - 1).

    Only seats near the fair share are ranked: each row surely has the seats far
    above the cut, so about three quotients per row are compared. Ties go by ``key``.
    """
    every = Window.partitionBy(group)
    fair = rows.withColumn("_fair", F.try_divide(F.col(claim) * F.col(seats), F.sum(claim).over(every)))
    spread = F.ceil(F.col("_fair") * F.count(F.lit(1)).over(every) / F.col(seats)) + 1
    near = (
        fair.where((F.col(claim) > 0) & (F.col(seats) > 0))
        .withColumn("_spread", spread)
        .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.round("_fair").cast("long") - F.col("_spread")))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(every))
        .withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.round("_fair").cast("long") + F.col("_spread"))))
    )
    order = Window.partitionBy(group).orderBy(F.desc(F.col(claim) / (2 * F.col("_k") - 1)), key, "_k")
    won = (
        near.withColumn("_won", (F.row_number().over(order) <= F.col("_open")).cast("long"))
        .groupBy(group, key)
        .agg((F.max("_sure") + F.sum("_won")).alias(quota))
    )
    return rows.join(won, [group, key], "left").withColumn(quota, F.coalesce(F.col(quota), F.lit(0).cast("long")))


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    ceiling: int = CEILING,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: size, source_size, target, ``passes`` over the whole text, ``ranges`` of words taken
    once more as [from, to), and ``taken``, the words of both.

    A source has a shard per ``shard_words`` words. Blocks have ``block_words`` words at every size of the corpus, but for
    the last of a shard, which has the rest; a source misses its target by half a block and one such rest per shard at most.
    """
    sizes = cut_lineage(
        docs.select(
            "doc_id",
            text_key(F.col("text")).alias("text_key"),
            source_key(F.col("source")).alias("source_key"),
            n_words(F.col("text")).alias("size"),
            seeded(F.lit(seed), F.col("doc_id"), F.md5("text")).alias("place"),
        )
    )
    sources = cut_lineage(
        targets(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, ceiling)
    )
    block = block_words
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    blocks = apportion(
        sources.withColumns({"_all": F.lit(0), "_blocks": F.lit(-(-total // block))}),
        "_all",
        "source_key",
        "target",
        "_blocks",
        "source_blocks",
    ).drop("_all", "_blocks")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))
    blocks = cut_lineage(blocks.withColumn("shards", shards))
    dealt = cut_lineage(
        sizes.join(blocks, "source_key").withColumn("shard", F.col("place") % F.col("shards"))
    )
    quotas = dealt.groupBy("source_key", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(quotas, "source_key", "shard", "shard_size", "source_blocks").withColumn(
        "line", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    )
    quotas = cut_lineage(
        quotas.select(
            "source_key", "shard", "line", F.least(F.col("quota"), F.col("line") * ceiling).alias("quota")
        )
    )
    here = (
        Window.partitionBy("source_key", "shard")
        .orderBy("place", "doc_id", "text_key")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = dealt.withColumn("end", F.sum("size").over(here)).join(quotas, ["source_key", "shard"])
    start = F.col("end") - F.col("size")
    rest = F.pmod(F.col("quota"), F.col("line"))
    offset = seeded(F.lit(seed), F.col("source_key"), F.col("shard")) % F.col("line")
    taken_blocks = F.filter(
        F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block)),
        lambda b: F.pmod(b * F.lit(STEP) + F.col("offset"), F.col("line")) < F.col("rest"),
    )
    ranges = F.transform(
        taken_blocks,
        lambda b: F.struct(
            (F.greatest(b * block, start) - start).alias("from"), (F.least((b + 1) * block, F.col("end")) - start).alias("to")
        ),
    )
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    counted = (
        placed.withColumns({"rest": rest, "offset": offset})
        .withColumn("passes", F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("quota") / F.col("line"))).cast("long"))
        .withColumn("ranges", F.when((F.col("size") == 0) | (F.col("rest") == 0), none).otherwise(ranges))
    )
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return counted.select(
        "doc_id",
        "text_key",
        "source_key",
        "size",
        "source_size",
        "target",
        "passes",
        "ranges",
        (F.col("passes") * F.col("size") + more).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each pass over a document, and one
    with the words of its ranges (each with the white space before it) where it has some."""
    key = ["doc_id", "text_key", "source_key"]
    share = (
        plan(docs, **options)
        .where("taken > 0")
        .groupBy(*key)
        .agg(
            F.sum("passes").alias("passes"),
            F.filter(F.collect_list("ranges"), lambda r: F.size(r) > 0).alias("parts"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    keyed = packed(docs, "doc_id", "text", "source").withColumns(
        {"text_key": text_key(F.col("text")), "source_key": source_key(F.col("source"))}
    )
    joined = join_same(keyed, share, key)
    # Equal rows put what they take together on one of them.
    once = joined.where("copies = 1").unionAll(joined.where("copies > 1").dropDuplicates(key))
    parts = let(
        F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
        lambda tokens: F.transform(
            "parts",
            lambda ranges: F.array_join(
                F.flatten(
                    F.transform(
                        ranges,
                        lambda r: F.slice(tokens, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")),
                    )
                ),
                "",
            ),
        ),
    )
    whole = F.when(F.col("passes") > 0, F.array_repeat(F.col("text"), F.col("passes").cast("int"))).otherwise(
        F.array().cast("array<string>")
    )
    mixed = once.withColumn("text", F.explode(F.concat(whole, parts)))
    return unpacked(mixed, docs, "doc_id", "text", "source", sized=True)
