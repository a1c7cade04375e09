"""Connected components of a graph given as a table of links.

Every node keeps the least node it knows of its component. In a round, a node hears the least label among its
neighbours and takes it over together with the node that it pointed to before (hooking), and then follows the labels of
labels (jumping), so the distance to the least node halves; the number of rounds grows with the logarithm of the
longest chain. Minima are pre-aggregated below each shuffle, so a node with many links is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b: bigint); the component is its least node."""
    ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = cut_lineage(ends.distinct())
    label = cut_lineage(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        # The least label next to a node, for the node itself and for the root that it points to.
        heard = (
            ends.join(label, ends["b"] == label["node"])
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
            .join(label, F.col("a") == F.col("node"))
            .select("node", "label", F.least("heard", "label").alias("heard"))
        )
        heard = cut_lineage(heard)
        hooks = heard.select("node", "heard").unionAll(heard.select(F.col("label").alias("node"), "heard"))
        hooked = cut_lineage(hooks.groupBy("node").agg(F.min("heard").alias("label")))
        for _ in range(2):
            ahead = hooked.select(F.col("node").alias("next"), F.col("label").alias("further"))
            hooked = cut_lineage(
                hooked.join(ahead, F.col("label") == F.col("next")).select("node", F.least("label", "further").alias("label"))
            )
        changed = not hooked.join(label.withColumnRenamed("label", "old"), "node").filter("label != old").isEmpty()
        label = hooked
        if not changed:
            return label.select("node", F.col("label").alias("component"))
