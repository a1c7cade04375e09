"""Joins of days with intervals of days by equal keys.

The days are the leaves of a binary tree whose nodes on level k hold 2^k days. An interval is the union of at most
two nodes per level that do not overlap, and a day lies in one node of each level. So a day is in an interval exactly if
one node of the interval is one of the day's, and then just one is: an equi join without a filter behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the tree: 2^22 days from year 1 on reach beyond year 9999, the last that a date can hold.
LEVELS = 22
FIRST_DAY = "0001-01-01"


def _leaf(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def _node(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.cast("int").alias("number"))


def nodes_of_interval(first: Column, last: Column) -> Column:
    """The nodes that make up the days from ``first`` to ``last``, both included; a NULL ``last`` is open.

    Empty for an interval that ends before it starts or has no start.
    """
    low = _leaf(first)
    end = F.coalesce(_leaf(last) + 1, F.lit(1 << LEVELS))
    nodes = []
    for level in range(LEVELS):
        left = F.shiftright(low + ((1 << level) - 1), level)
        right = F.shiftright(end, level)
        nodes.append(F.when((left < right) & (left % 2 == 1), _node(level, left)))
        nodes.append(F.when((left < right) & (right % 2 == 1), _node(level, right - 1)))
    whole = F.when((low == 0) & (end == 1 << LEVELS), _node(LEVELS, F.lit(0)))
    return F.array_compact(F.array(*nodes, whole))


def nodes_of_day(day: Column) -> Column:
    """The nodes that a day lies in, one per level; none for a NULL day."""
    nodes = F.array(*[_node(level, F.shiftright(_leaf(day), level)) for level in range(LEVELS + 1)])
    return F.when(day.isNotNull(), nodes)
