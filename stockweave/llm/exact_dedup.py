"""Exact dedup by content-defined chunk recipes.

A text is cut after line and sentence ends, so equal passages give equal chunks
wherever they stand. A chunk gets a 64-bit identifier, verified over the whole
corpus: where chunks with different SHA-256 share an identifier, they get
variant numbers. Two texts are equal if their ordered lists of verified
identifiers are. Only lists move between tasks, never the texts.

Cases: null text counts as empty; all empty texts form one group; of equal
texts the row with the largest doc_id stays (null ids sort below all others);
of rows that repeat doc_id and text one stays; empty tables give empty results;
other columns are ignored or, by ``keep_one``, returned as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import join_same, packed, unpacked
from stockweave.session import cut_lineage

#: Chunks end after a line or sentence end, at least 512 and at most 4096 code points long (the last may be shorter).
CHUNK = r"(?s).{512,4096}?(?:\n|[.!?]\x20)|.{1,4096}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, ids, digests): the ordered chunk lists of each document.

    ``id_bits`` below 64 is for tests, to make identifiers collide.
    """

    def identifier(chunk: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(chunk), 64 - id_bits) if id_bits < 64 else F.xxhash64(chunk)

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.sha2(text, 256).alias("text_sha256"), chunks(text).alias("chunks")).select(
        "doc_id",
        "text_sha256",
        F.transform("chunks", identifier).alias("ids"),
        F.transform("chunks", lambda x: F.unhex(F.sha2(x, 256))).alias("digests"),
    )


def variants(recipe: DataFrame) -> DataFrame:
    """(id, digest, variant) of identifiers that stand for more than one chunk; as a rule there are none."""
    rows = recipe.select(F.explode(F.arrays_zip("ids", "digests")).alias("x")).select(
        F.col("x.ids").alias("id"), F.col("x.digests").alias("digest")
    )
    several = rows.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("id")
    several = cut_lineage(several)
    found = rows.join(several, "id").distinct().withColumnsRenamed({"id": "own", "digest": "own_digest"})
    # A variant is the number of smaller digests under the identifier plus one; identifiers have few.
    other = found.withColumnsRenamed({"own": "id", "own_digest": "digest"})
    return (
        other.join(found, (F.col("own") == F.col("id")) & (F.col("own_digest") <= F.col("digest")))
        .groupBy("id", "digest")
        .agg(F.count(F.lit(1)).alias("variant"))
    )


def verified(recipe: DataFrame) -> DataFrame:
    """``recipe`` with ``variants``: the variant numbers along the list, empty where no identifier collides."""
    found = cut_lineage(variants(recipe))
    chunk = recipe.select(
        "doc_id", "text_sha256", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "x")
    ).select("doc_id", "text_sha256", "at", F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"))
    of_doc = (
        chunk.join(found, ["id", "digest"])
        .select("doc_id", "text_sha256", "at", "variant")
        .distinct()
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("at", "variant"))).alias("variants"))
    )
    empty = F.array().cast("array<struct<at:int,variant:bigint>>")
    return join_same(recipe, of_doc, ["doc_id", "text_sha256"], "left").select(
        "doc_id", "text_sha256", "ids", F.coalesce("variants", empty).alias("variants")
    )


def deduplicate(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    recipe = cut_lineage(recipes(docs, id_bits))
    key = ["ids", "variants"]
    rows = cut_lineage(
        verified(recipe).groupBy("doc_id", "text_sha256", *key).agg(F.count(F.lit(1)).alias("copies"))
    )
    groups = cut_lineage(
        rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    )
    return (
        join_same(rows, groups, key)
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def keep_one(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    verdict = (
        deduplicate(docs, id_bits)
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .where("kept")
        .select("doc_id", "text_sha256", "copies")
    )
    key = ["doc_id", "text_sha256"]
    keyed = packed(docs, "doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = join_same(keyed, verdict, key)
    once = joined.where("copies = 1")
    # Rows that repeat doc_id and text: the first of the other columns stays.
    again = joined.where("copies > 1").dropDuplicates(key)
    return unpacked(once.unionAll(again), docs, "doc_id", "text")
