"""Before and after: baselines, samples and verdicts of canaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.config import DEFAULT, OVERRIDE_EVENTS, WRONG_REASONS, Thresholds
from gleanline.functions.text import at, normalize_agent

METRICS = ("override_rate", "fp_rate", "finding_density")


def _agent_sessions(e: DataFrame, s: DataFrame, project: bool = False) -> DataFrame:
    """One row for each agent and session: events, overrides and wrong ones, before any join with canaries."""
    o = F.col("event").isin(*OVERRIDE_EVENTS)
    g = e.groupBy(normalize_agent(F.col("source")).alias("agent"), "session_id").agg(F.count("*").alias("events"), F.count_if(o).alias("overrides"), F.count_if(o & F.col("override_reason").isin(*WRONG_REASONS)).alias("wrong"))
    return g.join(s.select("session_id", "start_ts", *(["project"] if project else [])), "session_id")


def join_agent_sessions(s: DataFrame, e: DataFrame, agent: str) -> DataFrame:
    return s.join(e.where(normalize_agent(F.col("source")) == agent), "session_id", "left_semi")


def last_n_sessions(c: DataFrame, e: DataFrame, s: DataFrame, n: int = 20, by_project: bool = False) -> DataFrame:
    """The last n sessions with evidence of the canary's agent before it was applied; by_project: of the canary's project, where it has one."""
    w = Window.partitionBy("canary_id").orderBy(F.desc("start_ts"), F.desc("session_id"))
    of = [F.col("project").alias("of_project")] if by_project else []
    own = c.select(F.col("id").alias("canary_id"), F.col("group_id").alias("agent"), "applied_at", *of)
    x = _agent_sessions(e, s, by_project).join(own, "agent").where("start_ts < applied_at")
    if by_project:
        x = x.where("of_project is null or of_project = '' or of_project = project").drop("of_project", "project")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def canary_baseline(c: DataFrame, e: DataFrame, s: DataFrame, cfg: Thresholds = DEFAULT, by_project: bool = False) -> DataFrame:
    """Rates over the last sessions, up to the change; none for a canary with too few of them."""
    g = last_n_sessions(c, e, s, cfg.window_sessions, by_project).join(c.select(F.col("id").alias("canary_id"), F.col("applied_at").alias("window_end")), "canary_id").groupBy("canary_id", "window_end").agg(
        F.count("*").alias("session_count"), F.sum("overrides").alias("o"), F.sum("wrong").alias("w"), F.sum("events").alias("ev"), F.min("start_ts").alias("window_start"),
    ).where(F.col("session_count") >= cfg.baseline_sessions)
    return g.select("canary_id", "session_count", F.round(F.col("o") / F.col("session_count"), 6).alias("override_rate"), F.round(F.when(F.col("o") > 0, F.col("w") / F.col("o")).otherwise(0.0), 6).alias("fp_rate"), F.round(F.col("ev") / F.col("session_count"), 6).alias("finding_density"), "window_start", "window_end")


def create_canary(c: DataFrame, baseline: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    x = c.join(baseline.select(F.col("canary_id").alias("id"), *(F.col(m).alias(f"baseline_{m}") for m in METRICS)), "id", "left")
    return x.withColumn("window_expires_at", F.col("applied_at") + F.expr(f"interval '{cfg.canary_days}' day")).withColumn("cohort_key", F.concat("group_id", F.lit(":*")))


def canary_samples(c: DataFrame, e: DataFrame, s: DataFrame) -> DataFrame:
    """A row for each active canary and later session with evidence of its agent."""
    own = c.where("status = 'active'").select(F.col("id").alias("canary_id"), F.col("group_id").alias("agent"), "applied_at")
    x = _agent_sessions(e, s).join(own, "agent").where("start_ts >= applied_at")
    return x.select("canary_id", "session_id", F.col("overrides").cast("double").alias("override_rate"), F.round(F.when(F.col("overrides") > 0, F.col("wrong") / F.col("overrides")).otherwise(0.0), 6).alias("fp_rate"), F.col("events").cast("double").alias("finding_density"))


def canary_summary(c: DataFrame, samples: DataFrame) -> DataFrame:
    g = samples.groupBy("canary_id").agg(F.count("*").alias("sample_count"), *(F.round(F.avg(m), 6).alias(f"avg_{m}") for m in METRICS))
    return c.join(g.withColumnRenamed("canary_id", "id"), "id", "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def canary_ready(summary: DataFrame, as_of: str) -> DataFrame:
    return summary.where((F.col("status") == "active") & ((F.col("sample_count") >= F.col("window_uses")) | (F.col("window_expires_at") <= at(as_of))))


def canary_verdicts(summary: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    """The state of each canary, first rule that applies; differences under the noise floor count as none."""
    up, down = 1 + cfg.alert_pct / 100, 1 - cfg.alert_pct / 100
    def off(m):
        return F.abs(F.col(f"avg_{m}") - F.col(f"baseline_{m}")) >= cfg.noise_floor

    worse = {
        "override_rate": off("override_rate") & (F.col("avg_override_rate") > F.col("baseline_override_rate") * up),
        "fp_rate": off("fp_rate") & (F.col("avg_fp_rate") > F.col("baseline_fp_rate") * up),
        "finding_density": off("finding_density") & (F.col("avg_finding_density") < F.col("baseline_finding_density") * down),
    }
    bad = {m: F.coalesce(x, F.lit(False)) for m, x in worse.items()}
    full = (F.col("sample_count") >= F.col("window_uses")) | (F.col("window_expires_at") <= at(as_of))
    reason = F.concat_ws("; ", *(F.when(x, F.lit(m)) for m, x in bad.items()))
    any_bad = bad["override_rate"] | bad["fp_rate"] | bad["finding_density"]
    status = (
        F.when(F.col("status") != "active", F.col("status")).when(F.col("baseline_override_rate").isNull(), "monitoring").when(~full, "monitoring")
        .when(F.col("sample_count") == 0, "expired_unused").when(any_bad, "alert").otherwise("passed")
    )
    return summary.select(F.col("id").alias("canary_id"), F.col("group_id").alias("agent"), status.alias("verdict"), F.when(status == "alert", reason).otherwise("").alias("reason"), "sample_count", *(F.col(f"avg_{m}") for m in METRICS))


def canary_overlap(c: DataFrame, agents: DataFrame) -> DataFrame:
    """BLOCK if the agent has an active canary, WARN with the others if some have, else OK."""
    active = c.where("status = 'active'").select(F.col("group_id").alias("other")).distinct()
    x = agents.join(F.broadcast(active.agg(F.sort_array(F.collect_set("other")).alias("others"))))
    own = F.array_contains("others", F.col("agent"))
    return x.select("agent", F.when(own, "BLOCK").when(F.size("others") > 0, "WARN").otherwise("OK").alias("decision"), F.when(own, "").otherwise(F.array_join("others", ", ")).alias("reason"))


def skill_canary_samples(m: DataFrame, g: DataFrame, baseline: DataFrame) -> DataFrame:
    """m (modification_id, skill_name, applied_at): signals after the change against the skill's mean before it."""
    x = g.join(m, "skill_name").where("observed_at > applied_at").join(baseline.select("skill_name", "signal_kind", F.col("mean").alias("baseline_value")), ["skill_name", "signal_kind"])
    return x.select("modification_id", "skill_name", "invocation_id", "signal_kind", "baseline_value", F.col("value").alias("canary_value"), F.round(F.col("value") - F.col("baseline_value"), 6).alias("delta")).dropDuplicates(["modification_id", "invocation_id", "signal_kind"])


def skill_canary_progress(samples: DataFrame) -> DataFrame:
    return samples.groupBy("skill_name").agg(F.countDistinct("invocation_id").alias("samples"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def skill_canary_verdicts(samples: DataFrame, min_n: int = 3) -> DataFrame:
    """reverted if a signal fell by a fifth and their sum by a tenth, pending with under min_n invocations, else ok."""
    n = samples.groupBy("modification_id").agg(F.countDistinct("invocation_id").alias("invocations"))
    k = samples.groupBy("modification_id", "signal_kind").agg(F.avg("baseline_value").alias("b"), F.avg("canary_value").alias("v"))
    t = k.groupBy("modification_id").agg(F.bool_or((F.col("b") > 0) & ((F.col("b") - F.col("v")) / F.col("b") >= 0.2)).alias("drop"), F.sum("b").alias("b"), F.sum("v").alias("v"))
    fell = F.col("drop") & (F.col("b") > 0) & ((F.col("b") - F.col("v")) / F.col("b") >= 0.1)
    return n.join(t, "modification_id").select("modification_id", "invocations", F.when(F.col("invocations") < min_n, "pending").when(fell, "reverted").otherwise("ok").alias("verdict"))
