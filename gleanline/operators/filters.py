"""Which evidence counts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions.text import at

KINDS = ("agent", "tool", "pattern", "skill")


def epoch(as_of: str) -> int:
    return int(datetime.fromisoformat(as_of).replace(tzinfo=timezone.utc).timestamp())


def visible(as_of: str) -> Column:
    """Past its quarantine."""
    return F.coalesce(F.col("quarantine_until"), F.lit(0)) <= epoch(as_of)


def in_window(days: float, as_of: str, ts: str = "ts", back: float = 0) -> Column:
    """ts in (as_of - back - days, as_of - back], as true instants."""
    end = at(as_of)
    upper = F.col(ts) <= end - F.expr(f"interval '{int(back * 24)}' hour") if back else F.lit(True)
    return (F.col(ts) > end - F.expr(f"interval '{int((back + days) * 24)}' hour")) & upper


def quarantine_filter(e: DataFrame, as_of: str) -> DataFrame:
    return e.where(visible(as_of))


def source_kind_filter(e: DataFrame, kind: str = "agent") -> DataFrame:
    return e.where(F.coalesce(F.col("source_kind"), F.lit("agent")) == kind)


def window_filter(e: DataFrame, as_of: str, days: int) -> DataFrame:
    return e.where(in_window(days, as_of))


def hook_allowlist(e: DataFrame, sources: tuple[str, ...] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    out = e.where(F.col("source_kind").isin(*kinds))
    return out if sources is None else out.where(F.col("source").isin(*sources))


def dark_sessions(s: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Begun more than hours ago and never ended."""
    return s.where(F.col("end_ts").isNull() & (F.col("start_ts") < at(as_of) - F.expr(f"interval '{hours}' hour"))).select("session_id", "start_ts")


def session_source(s: DataFrame, own: str, marker: str = "marker", title: str = "title", changed: str = "changed_files") -> DataFrame:
    """bootstrap if marked, self-building if title or a changed path is about the tool itself (the regex own names it), else normal."""
    return s.withColumn("source", F.when(F.coalesce(F.col(marker), F.lit(False)), "bootstrap").when(F.coalesce(F.col(title).rlike(own), F.lit(False)) | F.coalesce(F.exists(changed, lambda p: p.rlike(own)), F.lit(False)), "self-building").otherwise("normal"))
