"""Counting rules over evidence: patterns, eligibility, candidates.

Each is one or two aggregations by a key whose partial sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanline.config import DEFAULT, OVERRIDE_EVENTS, WRONG_REASONS, Thresholds
from gleanline.functions.text import is_agent_name, normalize_agent
from gleanline.operators.filters import quarantine_filter, source_kind_filter


def classified_patterns(e: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Groups of at least two visible events by source, event and reason (null as ''); ready, growing or emerging by how many of three minima they meet."""
    keys = [normalize_agent(F.col("source")).alias("source"), "event", F.coalesce("override_reason", F.lit("")).alias("override_reason")]
    g = quarantine_filter(e, as_of).groupBy(*keys).agg(F.count("*").alias("event_count"), F.countDistinct("session_id").alias("session_count"), F.countDistinct("project").alias("project_count"))
    met = (F.col("session_count") >= cfg.min_sessions).cast("int") + (F.col("project_count") >= cfg.min_projects).cast("int") + (F.col("event_count") >= cfg.min_events).cast("int")
    return g.where("event_count >= 2").withColumn("classification", F.when(met == 3, "ready").when(met >= 1, "growing").otherwise("emerging"))


def pattern_gaps(e: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """What growing patterns lack."""
    def lack(least, c):
        return F.greatest(F.lit(least) - F.col(c), F.lit(0)).cast("long")

    p = classified_patterns(e, as_of, cfg).where("classification = 'growing'").drop("classification")
    return p.select("*", lack(cfg.min_events, "event_count").alias("missing_events"), lack(cfg.min_sessions, "session_count").alias("missing_sessions"), lack(cfg.min_projects, "project_count").alias("missing_projects"))


def agent_wrong_pct(e: DataFrame, as_of: str) -> DataFrame:
    """Of each agent's overrides the share that say it was wrong, in whole percent rounded down."""
    o = source_kind_filter(quarantine_filter(e, as_of)).where(F.col("event").isin(*OVERRIDE_EVENTS))
    o = o.groupBy(normalize_agent(F.col("source")).alias("agent")).agg(F.count("*").alias("total"), F.count_if(F.col("override_reason").isin(*WRONG_REASONS)).alias("wrong"))
    return o.withColumn("wrong_pct", F.floor(100 * F.col("wrong") / F.col("total")).cast("long"))


def routing_eligible(e: DataFrame, blacklist: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """A status for every agent with evidence; the first reason that applies."""
    agents = source_kind_filter(e).select(normalize_agent(F.col("source")).alias("agent")).distinct()
    listed = blacklist.select(F.col("pattern_key").alias("agent"), F.lit(True).alias("listed")).distinct()
    x = agents.join(agent_wrong_pct(e, as_of), "agent", "left").join(listed, "agent", "left")
    status = (
        F.when(~is_agent_name(F.col("agent")), "invalid_agent_name").when(F.col("listed"), "blacklisted").when(F.coalesce("total", F.lit(0)) == 0, "no_override_events")
        .when(F.col("wrong_pct") < cfg.routing_pct, F.concat(F.lit("agent_wrong_pct="), F.col("wrong_pct").cast("string"))).otherwise("eligible")
    )
    return x.select("agent", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("wrong", F.lit(0)).alias("wrong"), "wrong_pct", status.alias("status"))


def blacklist_anti(patterns: DataFrame, blacklist: DataFrame) -> DataFrame:
    return patterns.join(blacklist.select(F.col("pattern_key").alias("source")), "source", "left_anti")


def override_anti(agents: DataFrame, overrides: DataFrame) -> DataFrame:
    return agents.join(overrides.select("agent"), "agent", "left_anti")


def routing_candidates(e: DataFrame, blacklist: DataFrame, overrides: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Ready agent_wrong patterns of eligible agents without an override."""
    ready = classified_patterns(e, as_of, cfg).where("classification = 'ready' and event = 'override' and override_reason = 'agent_wrong'")
    ok = routing_eligible(e, blacklist, as_of, cfg).where("status = 'eligible'").select("agent", "wrong_pct")
    out = ready.join(ok, F.col("source") == F.col("agent")).select("agent", "event_count", "session_count", "project_count", "wrong_pct")
    return override_anti(out, overrides)


def overlay_candidates(e: DataFrame, overrides: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Agents with a ready override pattern and a share of agent_wrong that is high but not enough for routing."""
    p = classified_patterns(e, as_of, cfg).where("event = 'override'").where(is_agent_name(F.col("source")))
    wrong = F.sum(F.when(F.col("override_reason") == "agent_wrong", F.col("event_count")).otherwise(0))
    g = p.groupBy(F.col("source").alias("agent")).agg(
        F.sum("event_count").alias("event_count"), F.max("session_count").alias("session_count"), F.max("project_count").alias("project_count"),
        F.floor(100 * wrong / F.sum("event_count")).cast("long").alias("wrong_pct"), F.bool_or(F.col("classification") == "ready").alias("ready"),
    )
    return override_anti(g.where(F.col("ready") & F.col("wrong_pct").between(cfg.overlay_pct, cfg.routing_pct - 1)).drop("ready"), overrides)


def override_confidence(e: DataFrame) -> DataFrame:
    """Share of an agent's overrides, under any of its names, that say it was wrong; 1 without overrides."""
    own = source_kind_filter(e)
    o = own.groupBy(normalize_agent(F.col("source")).alias("agent")).agg(F.count_if(F.col("event").isin(*OVERRIDE_EVENTS)).alias("total"), F.count_if(F.col("event").isin(*OVERRIDE_EVENTS) & F.col("override_reason").isin(*WRONG_REASONS)).alias("wrong"))
    return o.withColumn("confidence", F.when(F.col("total") > 0, F.round(F.col("wrong") / F.col("total"), 6)).otherwise(1.0))


def same_session_proposals(e: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals (session_id, agent) flagged where the same session proposed the agent."""
    mine = e.where("event = 'propose'").select("session_id", F.col("source").alias("agent")).distinct().withColumn("same", F.lit(True))
    return approvals.join(mine, ["session_id", "agent"], "left").withColumn("blocked", F.coalesce("same", F.lit(False))).drop("same")
