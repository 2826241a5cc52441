"""Snapshots of calibrations, their drift, and the trend of consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.text import at, quarter_label
from gleanline.operators.filters import in_window


def snapshot_as_of(history: DataFrame, as_of: str, min_age_days: int = 90) -> DataFrame:
    """The rows of the newest snapshot (calibrated_at) at least so old."""
    old = history.where(F.col("calibrated_at") <= at(as_of) - F.expr(f"interval '{min_age_days}' day"))
    return old.join(F.broadcast(old.agg(F.max("calibrated_at").alias("calibrated_at"))), "calibrated_at", "left_semi")


def rank_agents(calibration: DataFrame) -> DataFrame:
    """Ranks by weighted hit rate, equal ones by name; agents without any rate have none. A row an agent: the roster is small and bounded by its names."""
    return calibration.where(F.coalesce("weighted_hit_rate", "hit_rate").isNotNull()).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("weighted_hit_rate", "hit_rate")), "agent")).cast("long"))


def shared_agents(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("agent").intersect(b.select("agent"))


def drift_join(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Both calibrations on the agents that have a rate in both, ranked anew among these."""
    rated = lambda df: df.where(F.coalesce("weighted_hit_rate", "hit_rate").isNotNull())
    both = shared_agents(rated(current), rated(snapshot))
    def side(df, p):
        return rank_agents(df.join(both, "agent", "left_semi")).select("agent", F.coalesce("weighted_hit_rate", "hit_rate").alias(f"{p}_rate"), F.col("rank").alias(f"{p}_rank"))

    return side(current, "now").join(side(snapshot, "old"), "agent")


def drift_audit(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    d = drift_join(current, snapshot).select("agent", F.round(F.col("now_rate") - F.col("old_rate"), 6).alias("delta_hit_rate"), (F.col("now_rank") - F.col("old_rank")).alias("delta_rank"))
    high = (F.abs("delta_hit_rate") >= 0.2) | (F.abs("delta_rank") >= 5)
    return d.withColumn("severity", F.when(high, "high").when((F.col("delta_hit_rate") != 0) | (F.col("delta_rank") != 0), "low").otherwise("none"))


def drift_verdict(current: DataFrame, snapshot: DataFrame, min_correlation: float = 0.7) -> DataFrame:
    """DRIFT if an agent moved much or ranks agree too little; BOOTSTRAP if fewer than two agents can be compared."""
    a = drift_audit(current, snapshot).agg(F.count("*").alias("n"), F.sum(F.col("delta_rank") * F.col("delta_rank")).alias("d2"), F.count_if(F.col("severity") == "high").alias("high"))
    rho = F.when(F.col("n") >= 2, F.round(1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)), 6))
    return a.select("n", rho.alias("correlation"), F.when(rho.isNull(), "BOOTSTRAP").when((rho < min_correlation) | (F.col("high") > 0), "DRIFT").otherwise("STABLE").alias("verdict"))


def consensus_trend(e: DataFrame, g: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """One point: agreement of agents' rows (those without a reason to override), diversity of all sources in a session, share of failed signals. Each part is a single row."""
    own = e.where(in_window(days, as_of))
    agent = F.col("source_kind") == "agent"
    a = own.agg(F.count("*").alias("evidence_n"), F.count_if(agent).alias("agents"), F.count_if(agent & (F.coalesce("override_reason", F.lit("")) != "")).alias("o"), F.countDistinct("source").alias("sources"))
    s = own.groupBy("session_id").agg(F.countDistinct("source").alias("k")).agg(F.avg("k").alias("k"))
    r = g.where("signal_kind = 'error'").where(in_window(days, as_of, "observed_at")).agg(F.avg("value").alias("err"))
    x = a.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(r))
    return x.select(
        quarter_label(at(as_of)).alias("cycle"), F.when(F.col("agents") > 0, F.round(1 - F.col("o") / F.col("agents"), 6)).alias("agreement_rate"), F.when(F.col("sources") > 0, F.round(F.col("k") / F.col("sources"), 6)).alias("output_diversity"),
        F.round(1 - F.col("err"), 6).alias("defect_escape_rate"), "evidence_n",
    )
