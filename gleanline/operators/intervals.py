"""Intervals of time cells as few dyadic nodes: node n of level k is the cells n * 2^k to (n + 1) * 2^k - 1.

An interval of m cells is at most 2 log2(m) nodes, and a cell is in one node of each level. So "which intervals hold this
cell" and "what is in this interval" are equi-joins whose rows grow with the logarithm of the interval, not with its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels told apart; of a longer interval the top level's nodes are many.
LEVELS = 16


def nodes_of(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """array<struct<level int, node long>>: the nodes that make up the cells first to last; none if first > last or either is null."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")  # the nodes low to high - 1 fit in
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        ends = F.array_compact(F.array(F.when(low % 2 != 0, node(low)), F.when(high % 2 != 0, node(high - 1))))
        every = F.transform(F.sequence(low, high - 1), lambda n: node(n))
        return F.when(low >= high, F.slice(ends, 1, 0)).otherwise(F.when(k == levels - 1, every).otherwise(ends))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))
    return F.when(first <= last, found).otherwise(F.slice(found, 1, 0))


def nodes_over(cell: Column, levels: int = LEVELS) -> Column:
    """array<struct<level int, node long>>: the node of each level that the cell is in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.floor(cell / F.call_function("shiftleft", F.lit(1).cast("long"), k)).cast("long").alias("node")))
