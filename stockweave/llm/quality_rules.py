"""Quality rules: lines that many documents of a host share are removed, depleted documents rejected.

Lines are normalised and hashed; for each host the distinct documents of a line
are counted. Documents with equal texts count once. A line is removed above
``max(min_docs, share * texts of the host)``. As the limit is a share of the
host, a host has at most (lines per document / share) removed lines at any size.

Cases: null text has no words and fails the base rules; a null host is a host of
its own; rows that repeat a doc_id each get their own row; empty tables give
empty results; other columns are ignored or, by ``clean``, returned as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import WORD, join_same, let, md5_number, packed, text_key, unpacked
from stockweave.session import cut_lineage

MIN_DOCS = 25
HOST_SHARE = 0.01
LEFT_SHARE = 0.5
SYMBOLS = "[#*$%&|<>]"


def host(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def plain_lines(text: Column) -> Column:
    """The lines that have a word, with one space between words and none around them."""
    plain = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.array_remove(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), "")


def line_hash(line: Column) -> Column:
    """Hash of a plain line in lower case with digits as 0."""
    return md5_number(F.regexp_replace(F.lower(line), "[0-9]", "0"))


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows found twice or more in the words ``w``.

    Only texts with fewer distinct windows than windows go on: there, windows are
    sorted by hash, equal neighbours give the repeated positions, and a walk over
    these in order counts each covered word once.
    """

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def walk(s: Column) -> Column:
        repeated = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["i"])),
            start,
            lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n")),
        )["n"]

    def covered(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), walk)
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(w) < 4, none).otherwise(
        let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window), covered)
    )


def _measured(docs: DataFrame) -> DataFrame:
    """One row per document with the base measures and its lines as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(lines: Column) -> Column:
        return let(
            F.split(F.array_join(lines, " "), " "),
            lambda w: F.struct(
                F.when(F.size(lines) == 0, 0).otherwise(F.size(w)).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                n_repeat_words(w).alias("n_repeat_words"),
                F.transform(
                    lines,
                    lambda x: F.struct(
                        line_hash(x).alias("line"),
                        (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"),
                    ),
                ).alias("lines"),
            ),
        )

    dup = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))
    )
    return docs.select(
        F.col("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        host(F.col("source")).alias("host"),
        let(plain_lines(text), measures).alias("m"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    ).select("doc_id", "text_key", "host", "m.*", "n_symbols", "n_dup_lines")


def frequent_lines(measured: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    """(host, line) of the lines to remove. Counts are pre-aggregated below each shuffle."""
    hosts = measured.groupBy("host").agg(F.countDistinct("text_key").alias("host_docs"))
    holders = (
        measured.select("host", "text_key", F.explode(F.array_distinct("lines.line")).alias("line"))
        .groupBy("host", "line", "text_key")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    many = holders.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    return many.join(hosts, "host").where(F.col("n_docs") > F.lit(host_share) * F.col("host_docs")).select("host", "line")


def judge(
    docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, left_share: float = LEFT_SHARE
) -> DataFrame:
    """One row per document: base measures, ``base_failed``, ``n_left_words``, ``removed`` (line hashes), ``kept``.

    ``kept`` is false if a base rule fails or fewer than ``left_share`` of the words stay.
    """
    measured = cut_lineage(_measured(docs))
    frequent = cut_lineage(frequent_lines(measured, min_docs, host_share))
    lines = measured.select("doc_id", "text_key", "host", F.explode("lines").alias("x")).select(
        "doc_id", "text_key", "host", F.col("x.line").alias("line"), F.col("x.words").alias("words")
    )
    hit = (
        lines.join(frequent, ["host", "line"])
        .groupBy("doc_id", "text_key", "host", "line")
        .agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("times"))
    )
    # Rows that repeat doc_id, host and text share one entry; ``times`` then counts all of them.
    removed = hit.groupBy("doc_id", "text_key", "host").agg(
        F.sum("words").alias("hit_words"), F.sort_array(F.collect_list("line")).alias("removed")
    )
    copies = measured.groupBy("doc_id", "text_key", "host").agg(F.count(F.lit(1)).alias("copies"))
    key = ["doc_id", "text_key", "host"]
    removed = join_same(removed, copies.where("copies > 1"), key, "left").select(
        *key, (F.col("hit_words") / F.coalesce(F.col("copies"), F.lit(1))).cast("long").alias("removed_words"), "removed"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    return join_same(measured, removed, key, "left").select(
        *key,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        left.alias("n_left_words"),
        "removed",
        (~failed & (left >= F.lit(left_share) * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that stay, with frequent lines taken out of ``text``; the columns of ``docs``.

    ``n_chars``, where there is one, follows the new text.
    """
    verdict = judge(docs, **limits).where("kept").select("doc_id", "text_key", "host", "removed").distinct()
    keyed = packed(docs, "doc_id", "text", "source").withColumns(
        {"text_key": text_key(F.col("text")), "host": host(F.col("source"))}
    )
    joined = join_same(keyed, verdict, ["doc_id", "text_key", "host"])
    lines = F.filter(
        F.split("text", "\n"),
        lambda x: F.coalesce(~F.array_contains(F.col("removed"), line_hash(F.get(plain_lines(x), 0))), F.lit(True)),
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return unpacked(joined.withColumn("text", text), docs, "doc_id", "text", "source", sized=True)
