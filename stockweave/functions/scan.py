"""Running totals and row numbers whose work spreads over tasks, whatever the skew.

A plain window sorts each partition key inside one task. One key may hold a
third of all rows, so these functions cut every key into chunks that follow the
order, scan inside the chunks, and scan the chunk totals, which are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockweave.session import cut_lineage

#: Quantiles that bound the pieces of an id range; dense at the ends, where stray ids are.
QUANTILES = (0.0, 0.001, 0.01, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 0.99, 0.999, 1.0)

#: Equal-width chunks per piece.
CUTS = 128

#: Texts that are sampled for their quantiles, and steps of the two-step search among these.
SAMPLE = 8192
STEPS = 32

#: Most rows of a key that one window goes through.
WINDOW_ROWS = 200_000


def crowded_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` with more than ``WINDOW_ROWS`` rows, as a table in the shared folder; None if there are none.

    Rows are counted by parts of the hash first, and keys only in parts that have so many rows.
    """
    rows = df.count()
    if rows <= WINDOW_ROWS:
        return None
    part = F.pmod(F.xxhash64(key), F.lit(64 + 8 * rows // WINDOW_ROWS))
    full = df.groupBy(part.alias("part")).count().filter(F.col("count") > WINDOW_ROWS).collect()
    if not full:
        return None
    counts = df.filter(part.isin([r.part for r in full])).groupBy(key).count()
    crowded = cut_lineage(counts.filter(F.col("count") > WINDOW_ROWS).select(key))
    return None if crowded.isEmpty() else crowded


def order_number(df: DataFrame, column: str) -> Column:
    """A number that never falls as ``column`` rises.

    Numbers and dates stand for themselves. Text is compared byte by byte, so
    its first seven bytes, read as one number, keep the order.
    """
    if isinstance(df.schema[column].dataType, StringType):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("bigint")
    return F.col(column).cast("bigint")


def _text_chunk(df: DataFrame, column: str) -> Column:
    """The number of sampled quantiles of a text column that a text reaches.

    The sample takes the texts of least hash, so it is spread evenly over the distinct texts, is the same in every run,
    and has a fixed size. Common beginnings of ids thus do no harm. A row is compared with the first quantile of each
    step and then with those of one step.
    """
    sample = df.select(F.col(column).alias("text")).where(F.col(column).isNotNull())
    least = sample.orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()
    texts = sorted({r.text for r in least}, key=lambda x: x.encode())
    if not texts:
        return F.lit(0)
    count = min(STEPS * STEPS, len(texts))
    bounds = [texts[i * len(texts) // count] for i in range(count)]
    steps = [bounds[i : i + STEPS] for i in range(0, count, STEPS)]
    reached = lambda values: F.size(F.filter(values, lambda low: low <= F.col(column)))
    step = reached(F.array(*[F.lit(x[0]) for x in steps]))
    inside = reached(F.get(F.array(*[F.array(*map(F.lit, x)) for x in steps]), step - 1))
    return F.when(step < 1, F.lit(0)).otherwise((step - 1) * STEPS + inside)


def with_chunk(df: DataFrame, column: str, chunk: str = "_chunk") -> DataFrame:
    """Adds a chunk number that never falls as ``column`` rises.

    Estimated quantiles keep the chunks of similar size even if ids are unevenly
    spread. They steer only the spread of work, never a result. An estimate can
    differ from run to run, so it is taken once, as a list of bounded length that becomes
    part of the plan: every use and every repeated task sees the same chunks.
    """
    if isinstance(df.schema[column].dataType, StringType):
        return df.withColumn(chunk, F.coalesce(_text_chunk(df, column), F.lit(0)).cast("int"))
    number = order_number(df, column)
    bounds = df.agg(F.percentile_approx(number, list(QUANTILES), 10_000)).first()[0]
    if not bounds:
        return df.withColumn(chunk, F.lit(0))
    place = F.lit(0)
    pieces = list(zip(bounds, bounds[1:]))
    for i, (low, high) in enumerate(pieces):
        width = max(high - low, 1)
        inside = F.floor((F.col("_number") - F.lit(low)) / F.lit(float(width)) * CUTS)
        here = F.lit(i * CUTS) + F.greatest(F.lit(0), F.least(F.lit(CUTS - 1), inside))
        place = here if i == 0 else F.when(F.col("_number") > low, here).otherwise(place)
    return df.withColumn("_number", number).withColumn(chunk, place.cast("int")).drop("_number")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    group_by_day: str | None = None,
) -> DataFrame:
    """Adds inclusive running totals per ``keys``, in the order of ``order``.

    ``values`` maps the column to add up to the name of its total. The last
    column of ``order`` is the unique tie-break; ``group_by_day`` names a column
    before it with few values, which then also cuts the chunks.
    """
    chunked = with_chunk(df, order[-1])
    head = [group_by_day] if group_by_day else []
    chunk_keys = [*keys, *head, "_chunk"]
    totals = chunked.groupBy(*chunk_keys).agg(*[F.sum(v).alias(f"_t_{t}") for v, t in values.items()])
    before = Window.partitionBy(*keys).orderBy(*head, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in chunk_keys],
        *[F.coalesce(F.sum(f"_t_{t}").over(before), F.lit(0)).alias(f"_o_{t}") for t in values.values()],
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    match = [F.col(k) == F.col(f"_k_{k}") for k in chunk_keys]
    return (
        chunked.join(offsets, match, "inner")
        .select("*", *[(F.sum(v).over(inside) + F.col(f"_o_{t}")).alias(t) for v, t in values.items()])
        .drop("_chunk", *[f"_k_{k}" for k in chunk_keys], *[f"_o_{t}" for t in values.values()])
    )


def numbered(df: DataFrame, order: str, number: str = "number", start: Column | int = 0) -> DataFrame:
    """Adds start + 1, start + 2, … in the order of a unique column."""
    total = running_total(
        df.select("*", F.lit("all").alias("_all"), F.lit(1).cast("bigint").alias("_one")),
        ["_all"],
        [order],
        {"_one": number},
    ).drop("_all", "_one")
    offset = F.lit(start) if isinstance(start, int) else start
    return total.withColumn(number, (F.col(number) + offset).cast("bigint"))
