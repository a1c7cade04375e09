"""Connected components by alternating large and small stars.

Each round is a pre-aggregated minimum per node and a join; labels stay in
tables. A hub with many neighbours is one key of the join, which adaptive
execution splits as both sides are shuffled from tables. Tables get a file per
``FILE_ROWS`` rows, so a graph that shrinks does not keep its many small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import cut_lineage

FILE_ROWS = 250_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a table with files for about ``rows`` rows."""
    return cut_lineage(df.coalesce(1 + rows // FILE_ROWS))


def _stars(edges: DataFrame, larger: bool, rows: int) -> DataFrame:
    """One star step over edges a > b: every node points its larger (or smaller) neighbours to its least one."""
    both = edges.select("a", "b")
    if larger:
        both = both.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = compact(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
    pointed = both.join(least, "a")
    if larger:
        out = pointed.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pointed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("a"), F.col("m").alias("b"))
        )
    out = out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return compact(out, rows)


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root points on."""
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")).distinct())
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b); the component is its least node.

    Self-links are ignored; an empty table gives an empty one.
    """
    edges = cut_lineage(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    rows = edges.count()
    while not _settled(edges):
        edges = _stars(_stars(edges, True, rows), False, rows)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
