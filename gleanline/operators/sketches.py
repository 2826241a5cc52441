"""Distinct sessions of a fleet from small sketches: one for each project, source and day, merged for any other view.

Exact counts stay the default everywhere. A sketch is a few KB however many sessions it has seen, so that a year of a fleet
is counted from its days without reading evidence again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's places.
LG_K = 12


def error(lg_k: int = LG_K) -> float:
    """Relative error that about 95 in 100 estimates stay within: two standard errors of 1.04 / sqrt(places)."""
    return 2 * 1.04 / math.sqrt(1 << lg_k)


def daily_sketches(e: DataFrame, column: str = "session_id", lg_k: int = LG_K) -> DataFrame:
    """(project, source, day, events, sketch) of the column's values; null values are not seen."""
    return e.groupBy("project", "source", F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.hll_sketch_agg(column, lg_k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, events, estimate): the sketches of each group put together, in any order and grouping."""
    g = sketches.groupBy(*keys).agg(F.sum("events").alias("events"), F.hll_union_agg("sketch").alias("sketch"))
    return g.select(*keys, "events", F.hll_sketch_estimate("sketch").alias("estimate"))


def against_exact(e: DataFrame, keys: list[str], column: str = "session_id", bound: float | None = None) -> DataFrame:
    """(keys, events, exact, within): exact counts, and whether the merged daily sketches are within twice the stated error of them."""
    exact = e.groupBy(*keys).agg(F.countDistinct(column).alias("exact"))
    most = 2 * error() if bound is None else bound
    x = merged(daily_sketches(e, column), keys).join(exact, keys)
    return x.select(*keys, "events", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= most * F.col("exact") + 1).alias("within"))
