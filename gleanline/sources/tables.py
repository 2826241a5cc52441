"""Sinks: appends that can be repeated, upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.text import rejected, sanitize
from gleanline.operators.filters import epoch, hook_allowlist
from gleanline.sources.versions import VersionedTable


def session_seq(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """seq goes on from the greatest of the session, in the order of time and id."""
    out = new.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id")).cast("long"))
    if existing is None:
        return out
    top = existing.groupBy("session_id").agg(F.max("seq").alias("top__"))
    return out.join(top, "session_id", "left").withColumn("seq", F.col("seq") + F.coalesce("top__", F.lit(0))).drop("top__")


def prepare_evidence(new: DataFrame, existing: DataFrame | None, as_of: str, quarantine_hours: int = 48) -> DataFrame:
    """Rows of known kinds, sanitised, numbered and in quarantine; a context that tries to instruct is blanked and flagged."""
    x = hook_allowlist(new).withColumns({c: sanitize(F.col(c)) for c in ("context", "override_reason")})
    x = x.withColumn("rejected", rejected(F.col("context")) | rejected(F.col("override_reason")))
    x = x.withColumns({c: F.when(rejected(F.col(c)), "").otherwise(F.col(c)) for c in ("context", "override_reason")})
    return session_seq(x, existing).withColumn("quarantine_until", F.lit(epoch(as_of) + 3600 * quarantine_hours if quarantine_hours else 0).cast("long"))


def new_rows(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What an append may add: each key once, none that is there."""
    return df.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def upsert(df: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order, new before old among equals."""
    both = df.withColumn("new__", F.lit(1)).unionByName(target.withColumn("new__", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("new__"))
    return both.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__", "new__")


def upsert_into(table: VersionedTable, new: DataFrame, keys: list[str], order: str) -> int:
    """The table's newest version with the last row of each key, as a version of its own; made anew where another writer came before."""
    return table.update(lambda now: upsert(new, now if now is not None else new.limit(0), keys, order))


def append_snapshot(df: DataFrame, path: str, calibrated_at: str) -> None:
    """A partition for each calibration; writing one again replaces it."""
    df.withColumn("calibrated_at", F.lit(calibrated_at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calibrated_at").parquet(path)


def merge_calibration(skills: DataFrame, existing: DataFrame | None, schema_version: int = 1) -> DataFrame:
    """The calibration after a run over skills: rows (section, name, schema_version, body).

    Only the section skills is replaced; the others, agents among them, stay. The version never falls.
    """
    own = skills.select(F.lit("skills").alias("section"), F.col("skill").alias("name"), F.to_json(F.struct(*[c for c in skills.columns if c != "skill"])).alias("body"))
    if existing is None:
        return own.select("section", "name", F.lit(schema_version).cast("int").alias("schema_version"), "body")
    top = F.broadcast(existing.agg(F.greatest(F.coalesce(F.max("schema_version"), F.lit(0)), F.lit(schema_version)).cast("int").alias("schema_version")))  # one row
    both = own.unionByName(existing.where("section <> 'skills'").select("section", "name", "body"))
    return both.crossJoin(top).select("section", "name", "schema_version", "body")


def append_trend(point: DataFrame, trend: DataFrame | None) -> DataFrame:
    """The trend with a point for its cycle: written anew where the cycle has one already."""
    return point if trend is None else trend.join(point.select("cycle"), "cycle", "left_anti").unionByName(point)


def prune_snapshots(history: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    from gleanline.operators.filters import in_window

    return history.where(in_window(days, as_of, "calibrated_at"))


def verdict_changes(verdicts: DataFrame) -> DataFrame:
    """Verdicts whose content differs from the agent's one before."""
    w = Window.partitionBy("agent").orderBy("ts", "id")
    return verdicts.where("agent <> 'synthesis'").withColumn("before__", F.lag("content_hash").over(w)).withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("before__"))).drop("before__")
