"""Connected components of a graph too large for one machine: alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanline.llm.common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large) or the smaller neighbours of each node to the least of them.

    The least neighbours are kept as a table of their own: both sides of the join are then plain shuffles, in
    which adaptive execution splits a node that has a large share of the edges.
    """
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = keep(near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").union(least.select("u", F.col("low").alias("v")))
    return keep(out.distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, component), a row for each node that has an edge to another; component is the least node reachable.

    Null ends, loops and repeated edges are ignored; an empty table gives an empty result. Every step is a shuffle
    keyed by node; the driver only sees a count and a checksum per round.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        now = _star(_star(now, large=True), large=False)
