"""Status, effectiveness and fleet reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.text import at, normalize_agent, week_label
from gleanline.operators.filters import in_window, quarantine_filter

TOOL_ADVICE = {
    "tool_error_rate_high": "check inputs before the call and read the error before a retry",
    "tool_rejection_rate_high": "ask before calls that were often rejected",
    "tool_edit_without_read": "read a file before editing it",
    "tool_bash_dominance": "prefer the dedicated tools over the shell",
    "tool_low_diversity": "consider the other tools",
}


def evidence_overview(e: DataFrame) -> DataFrame:
    return e.groupBy("source").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("project").alias("projects"), F.max("ts").alias("last_seen"))


def event_breakdown(e: DataFrame) -> DataFrame:
    return e.groupBy("source", "event", F.coalesce("override_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("count"))


def weekly_timeline(e: DataFrame, as_of: str, days: int = 56, most: int = 40) -> DataFrame:
    g = e.where(in_window(days, as_of)).groupBy("source", week_label(F.col("ts")).alias("week")).agg(F.count("*").alias("count"))
    return g.withColumn("bar", F.repeat(F.lit("█"), F.least(F.col("count"), F.lit(most)).cast("int")))


def evidence_health(e: DataFrame, s: DataFrame, as_of: str) -> DataFrame:
    a = e.agg(
        F.count("*").alias("events"), F.count_if(F.col("event") == "override").alias("overrides"), F.count_if(F.col("event") == "agent_dispatch").alias("dispatches"),
        F.count_if(in_window(7, as_of)).alias("recent"),
    )
    a = a.withColumn("override_pct", F.when(F.col("events") > 0, F.round(100 * F.col("overrides") / F.col("events"), 6)))
    dark = s.agg(F.count_if(F.col("end_ts").isNull() & (F.col("start_ts") < at(as_of) - F.expr("interval '24' hour"))).alias("dark"))
    return a.crossJoin(F.broadcast(dark))  # one row each


def status_counts(e: DataFrame, s: DataFrame, c: DataFrame, m: DataFrame) -> DataFrame:
    """name, value rows; each table is counted once."""
    def one(df, **counts):
        r = df.agg(*(x.alias(n) for n, x in counts.items()))
        return r.select(F.expr(f"stack({len(counts)}, {', '.join(f'''{n!r}, cast({n} as long)''' for n in counts)}) as (name, value)"))

    parts = [
        one(s, sessions=F.count("*"), open_sessions=F.count_if(F.col("end_ts").isNull())),
        one(e, evidence=F.count("*"), overrides=F.count_if(F.col("event") == "override")),
        one(c, canaries=F.count("*"), active_canaries=F.count_if(F.col("status") == "active")),
        one(m, modifications=F.count("*"), applied=F.count_if(F.col("status") == "applied"), reverted=F.count_if(F.col("status") == "reverted")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health_channels(e: DataFrame, s: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Three channels. Events: OK with news in the window, WARN with older ones, else INACTIVE. Sessions: OK with one in the window that has ended, WARN if all in it are open, INACTIVE without any in it."""
    def channel(df, name, cond, ts):
        return df.agg(F.lit(name).alias("channel"), F.count_if(cond & in_window(days, as_of, ts)).alias("last_7d"), F.count_if(cond).alias("total"), F.max(F.when(cond, F.col(ts))).alias("last_event"))

    events = channel(e, "dispatch", F.col("event") == "agent_dispatch", "ts").unionByName(channel(e, "override", F.col("event") == "override", "ts"))
    events = events.withColumn("status", F.when(F.col("last_7d") > 0, "OK").when(F.col("total") > 0, "WARN").otherwise("INACTIVE"))
    ended = s.agg(F.count_if(in_window(days, as_of, "start_ts") & F.col("end_ts").isNotNull()).alias("ended"))
    own = channel(s, "session", F.lit(True), "start_ts").crossJoin(F.broadcast(ended))
    return events.unionByName(own.withColumn("status", F.when(F.col("ended") > 0, "OK").when(F.col("last_7d") > 0, "WARN").otherwise("INACTIVE")).drop("ended"))


def signal_coverage(g: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    a = g.groupBy("signal_kind").agg(F.count("*").alias("rows"), F.countDistinct("skill_name").alias("skills"), F.max("observed_at").alias("last"))
    return a.withColumn("status", F.when(F.col("last") > at(as_of) - F.expr(f"interval '{days}' day"), "OK").otherwise("WARN"))


def effectiveness(e: DataFrame, as_of: str, days: int = 30, back: int = 0, normalize: bool = False) -> DataFrame:
    """Dispatches and corrections of each fd- source in a window; only agents that were dispatched."""
    agent = normalize_agent(F.col("source")) if normalize else F.col("source")
    g = e.where(in_window(days, as_of, back=back)).withColumn("agent", agent).where("agent like 'fd-%'").groupBy("agent").agg(
        F.count_if(F.col("event") == "agent_dispatch").alias("dispatches"), F.count_if(F.col("event") == "override").alias("corrections"), F.countDistinct("session_id").alias("sessions"),
    )
    return g.where("dispatches > 0").withColumn("override_rate", F.round(100 * F.col("corrections") / F.greatest("dispatches", F.lit(1)), 6))


def effectiveness_totals(e: DataFrame, overrides: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Sums over all fd- rows of the window, dispatched agents or not, and the excludes in force."""
    g = e.where(in_window(days, as_of)).where("source like 'fd-%'").agg(
        F.count_if(F.col("event") == "agent_dispatch").alias("dispatches"), F.count_if(F.col("event") == "override").alias("corrections"), F.countDistinct("session_id").alias("sessions"),
    )
    g = g.crossJoin(F.broadcast(overrides.agg(F.count_if(F.col("action") == "exclude").alias("active_overrides"))))  # one row each
    return g.withColumn("override_rate", F.when(F.col("dispatches") > 0, F.floor(1000 * F.col("corrections") / F.col("dispatches")) / 10).otherwise(0.0))


def trend_join(e: DataFrame, as_of: str, days: int) -> DataFrame:
    now = effectiveness(e, as_of, days).select("agent", F.col("override_rate").alias("rate"), "dispatches")
    return now.join(effectiveness(e, as_of, days, days).select("agent", F.col("override_rate").alias("prior_rate")), "agent", "left")


def effectiveness_trend(e: DataFrame, as_of: str, days: int) -> DataFrame:
    d = F.col("rate") - F.col("prior_rate")
    t = trend_join(e, as_of, days).withColumn("delta", F.round(d, 6))
    trend = F.when(F.col("prior_rate").isNull(), "new").when(F.col("delta") < -2, "improving").when(F.col("delta") > 2, "declining").otherwise("stable")
    advice = F.when(F.col("rate") > 50, "exclude or tune").when(F.col("delta") > 10, "investigate").otherwise("none")
    return t.select("agent", "rate", "prior_rate", "delta", trend.alias("trend"), advice.alias("recommendation"))


def effectiveness_summary(e: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rates of the two windows (a window without dispatches is divided by one) and their relative change in whole percent toward zero; none if the prior rate is 0."""
    own = e.where(F.col("source").like("fd-%"))
    def c(event, back):
        return F.count_if((F.col("event") == event) & in_window(days, as_of, back=back))

    a = own.agg(c("override", 0).alias("c0"), c("agent_dispatch", 0).alias("d0"), c("override", days).alias("c1"), c("agent_dispatch", days).alias("d1"))
    a = a.select(F.round(100 * F.col("c0") / F.greatest("d0", F.lit(1)), 6).alias("current_rate"), F.round(100 * F.col("c1") / F.greatest("d1", F.lit(1)), 6).alias("prior_rate"))
    x = 100 * (F.col("current_rate") - F.col("prior_rate")) / F.when(F.col("prior_rate") != 0, F.col("prior_rate"))
    a = a.withColumn("change_pct", F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))
    return a.withColumn("label", F.when(F.col("change_pct").isNull(), "stable").when(F.col("change_pct") < 0, "improving").when(F.col("change_pct") > 5, "declining").otherwise("stable"))


def _dispatched(e: DataFrame, as_of: str, days: int) -> DataFrame:
    """Dispatches and corrections of each fd- source in each project that dispatched it."""
    g = e.where(in_window(days, as_of)).where("source like 'fd-%'").groupBy(F.col("source").alias("agent"), "project")
    return g.agg(F.count_if(F.col("event") == "agent_dispatch").alias("d"), F.count_if(F.col("event") == "override").alias("c")).where("d > 0")


def cross_project(e: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Sums over the projects that dispatched an agent; the rate is cut after one place."""
    g = _dispatched(e, as_of, days).groupBy("agent").agg(
        F.array_join(F.sort_array(F.collect_set("project")), ",").alias("projects"), F.countDistinct("project").alias("project_count"), F.sum("d").alias("total_dispatches"), F.sum("c").alias("total_corrections"),
    )
    return g.withColumn("override_rate", F.floor(1000 * F.col("total_corrections") / F.col("total_dispatches")) / 10)


def fleet_union(stores: list[DataFrame], as_of: str, days: int = 30) -> DataFrame:
    """Per project sums put together and grouped anew."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    g = out.where(in_window(days, as_of)).groupBy("project", normalize_agent(F.col("source")).alias("agent")).agg(F.count("*").alias("n"))
    return g.groupBy("agent").agg(F.sum("n").alias("events"), F.count("*").alias("projects"))


def global_exclusion(e: DataFrame, as_of: str, days: int = 30, rate: float = 50, share: float = 0.5) -> DataFrame:
    """Agents in more than half of the projects that dispatched any, whose rate is over 50."""
    n = _dispatched(e, as_of, days).agg(F.countDistinct("project").alias("n"))
    x = cross_project(e, as_of, days).crossJoin(F.broadcast(n)).withColumn("project_share", F.round(F.col("project_count") / F.col("n"), 6))
    return x.where((F.col("project_share") > share) & (F.col("override_rate") > rate)).select("agent", "project_share", "override_rate")


def correction_reasons(e: DataFrame, n: int = 5) -> DataFrame:
    g = e.where("event = 'override'").groupBy(normalize_agent(F.col("source")).alias("agent"), F.coalesce("override_reason", F.lit("")).alias("override_reason")).agg(F.count("*").alias("count"))
    w = Window.partitionBy("agent")
    return g.select("*", F.row_number().over(w.orderBy(F.desc("count"), "override_reason")).alias("rank"), F.sum("count").over(w).alias("total")).where(F.col("rank") <= n)


def top_agents(e: DataFrame, n: int = 10) -> DataFrame:
    return e.groupBy("source").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions")).orderBy(F.desc("events"), "source").limit(n)


def recent_events(e: DataFrame, as_of: str, n: int = 10, chars: int = 120) -> DataFrame:
    """The newest of each source; [Q] marks those in quarantine. The rank filter keeps n a task and source before the shuffle."""
    hidden = F.coalesce(F.col("quarantine_until"), F.lit(0)) > F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("id"))
    r = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return r.select("source", "rank", "ts", F.concat(F.when(hidden, "[Q] ").otherwise(""), "event").alias("event"), F.coalesce("override_reason", F.lit("")).alias("reason"), F.substring("context", 1, chars).alias("context"))


def recent_wrong_contexts(e: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("agent").orderBy(F.desc("ts"), F.desc("id"))
    r = e.where("override_reason = 'agent_wrong'").withColumn("agent", normalize_agent(F.col("source"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    own = F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "context")))
    return r.groupBy("agent").agg(own.alias("x")).select("agent", F.array_join("x.id", ",").alias("ids"), F.array_join("x.context", ",").alias("contexts"))


def tool_patterns(e: DataFrame, as_of: str) -> DataFrame:
    """Counts by tool and kind of event with their total and the advice for the kind."""
    g = quarantine_filter(e, as_of).where("source_kind = 'tool'").groupBy("source", "event").agg(F.count("*").alias("count"))
    advice = e.sparkSession.createDataFrame(list(TOOL_ADVICE.items()), "event string, advice string")
    return g.withColumn("total", F.sum("count").over(Window.partitionBy("source"))).join(F.broadcast(advice), "event", "left")


def tool_baseline(e: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    g = e.where("source_kind = 'tool'").where(in_window(days, as_of)).groupBy("source", "event").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event", "n")))).alias("counts"))


def tool_recurrence(e: DataFrame, applied: DataFrame) -> DataFrame:
    """applied (source, applied_at): events of the tool after the change."""
    t = e.where("source_kind = 'tool'").select("source", "ts")
    return applied.join(t, "source", "left").groupBy("source", "applied_at").agg(F.count_if(F.col("ts") > F.col("applied_at")).alias("recurrences"))


def override_summary(o: DataFrame, canary: DataFrame | None = None) -> DataFrame:
    """Exclusions and proposals with their agents, and the agents whose canary is on alert."""
    def names(action):
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("action") == action, F.col("agent")))), ", ")

    alerts = (o.select(F.col("agent").alias("group_id"), F.lit("").alias("status")).limit(0) if canary is None else canary).where("status = 'alert'")
    alerts = alerts.agg(F.count("*").alias("alerts"), F.array_join(F.sort_array(F.collect_set("group_id")), ", ").alias("alert_agents"))
    return o.agg(F.count_if(F.col("action") == "exclude").alias("excluded"), names("exclude").alias("excluded_agents"), F.count_if(F.col("action") == "propose").alias("proposed"), names("propose").alias("proposed_agents")).crossJoin(F.broadcast(alerts))  # one row each
