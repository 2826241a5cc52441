"""Breakers, rate limit, gates, override states, budgets and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.config import DEFAULT, Thresholds
from gleanline.functions.text import at
from gleanline.operators.filters import in_window


def circuit_breaker(m: DataFrame, as_of: str, days: int = 30, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Groups with too many reverts in the window."""
    return m.where("status = 'reverted'").where(in_window(days, as_of)).groupBy("group_id").agg(F.count("*").alias("reverts")).where(F.col("reverts") >= cfg.breaker_reverts)


def system_breaker(m: DataFrame, as_of: str, days: int = 30, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Trips if half of at least three groups have tripped."""
    g = m.where(in_window(days, as_of)).groupBy("group_id").agg(F.count_if(F.col("status") == "reverted").alias("r"))
    a = g.agg(F.count("*").alias("total"), F.count_if(F.col("r") >= cfg.breaker_reverts).alias("tripped"))
    return a.withColumn("result", F.when((F.col("total") >= 3) & (2 * F.col("tripped") >= F.col("total")), "tripped").otherwise("ok"))


def rate_limit(m: DataFrame, as_of: str, cfg: Thresholds = DEFAULT) -> DataFrame:
    a = m.where(F.col("status").isin("applied", "proposed")).where(in_window(1, as_of)).agg(F.count("*").alias("count"))
    return a.withColumn("exceeded", F.col("count") >= cfg.rate_per_day)


def auto_apply_gate(requests: DataFrame, m: DataFrame, sessions: DataFrame, as_of: str, autonomy: bool = True, cfg: Thresholds = DEFAULT) -> DataFrame:
    """requests (agent, mod_type): the first gate that stops a change, else apply. sessions (agent, sessions) counts an agent's."""
    one = system_breaker(m, as_of, cfg=cfg).select(F.col("result").alias("system")).crossJoin(F.broadcast(rate_limit(m, as_of, cfg).select("exceeded")))
    x = requests.join(circuit_breaker(m, as_of, cfg=cfg).select(F.col("group_id").alias("agent"), "reverts"), "agent", "left").join(sessions, "agent", "left").crossJoin(F.broadcast(one))
    reason = (
        F.when(~F.lit(autonomy), "autonomy_off").when(F.col("system") == "tripped", "system_breaker").when(F.col("mod_type") == "prompt_tuning", "prompt_tuning_needs_review").when(F.col("exceeded"), "rate_limit")
        .when(F.col("reverts").isNotNull(), "circuit_breaker").when(F.coalesce("sessions", F.lit(0)) < cfg.baseline_sessions, "too_few_sessions").otherwise("ok")
    )
    return x.select("agent", "mod_type", F.when(reason == "ok", "apply").otherwise("propose").alias("decision"), reason.alias("reason"))


def override_lifecycle(o: DataFrame, actions: DataFrame) -> DataFrame:
    """The overrides after one action for each agent: propose, approve, revert, blacklist.

    o (agent, action, confidence), actions (agent, verb, confidence, approved_at). An existing proposal stays, an
    approval excludes what was proposed, a revert removes the entry, a blacklisted agent gets none. result says
    what became of the action; agents without one stay as they are.
    """
    x = o.select("agent", F.col("action").alias("was"), F.col("confidence").alias("had")).join(actions, "agent", "full")
    done = (
        F.when(F.col("verb").isNull(), "kept").when((F.col("verb") == "propose") & F.col("was").isNotNull(), "exists").when(F.col("verb") == "propose", "proposed")
        .when((F.col("verb") == "approve") & (F.col("was") == "propose"), "approved").when(F.col("verb") == "approve", "nothing_to_approve")
        .when(F.col("verb").isin("revert", "blacklist") & F.col("was").isNotNull(), F.concat("verb", F.lit("ed"))).otherwise("absent")
    )
    action = F.when(done == "proposed", "propose").when(done == "approved", "exclude").when(done.isin("reverted", "blacklisted"), None).otherwise(F.col("was"))
    return x.select("agent", action.alias("action"), F.when(done == "approved", F.col("confidence")).otherwise(F.col("had")).alias("confidence"), F.when(done == "approved", F.col("approved_at") + F.expr("interval '90' day")).alias("expires_at"), done.alias("result"))


def override_merge(o: DataFrame, new: DataFrame, key: str = "agent") -> DataFrame:
    """Entries with the new ones in place of those of the same key."""
    return o.join(new.select(key), key, "left_anti").unionByName(new)


def latest_state(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the rank filter keeps a row a task and key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__")


def override_status(o: DataFrame, c: DataFrame, m: DataFrame, roster: DataFrame) -> DataFrame:
    last = latest_state(c.select(F.col("group_id").alias("agent"), F.col("status").alias("canary_status"), "id"), ["agent"], ["id"]).drop("id")
    applied = m.where("status = 'applied'").select(F.col("group_id").alias("agent")).distinct().withColumn("recorded", F.lit(True))
    known = roster.select("agent").distinct().withColumn("known", F.lit(True))
    x = o.join(last, "agent", "left").join(applied, "agent", "left").join(known, "agent", "left")
    orphan = F.col("known").isNull()
    nxt = F.when(orphan, "remove").when(F.col("canary_status") == "alert", "revert").when(F.col("action") == "propose", "approve").otherwise("none")
    return x.select("agent", "action", F.coalesce("canary_status", F.lit("none")).alias("canary_status"), F.coalesce("recorded", F.lit(False)).alias("consistent"), orphan.alias("orphan"), nxt.alias("next_action"))


def overlay_budget(o: DataFrame, total: int = 2000, own: int = 500, group: str = "project") -> DataFrame:
    """(group, agent, tokens): a running sum in the order of agents within each project; what is over the budget is out."""
    w = Window.partitionBy(group).orderBy("agent").rowsBetween(Window.unboundedPreceding, 0)
    fits = o.withColumn("fits", F.col("tokens") <= own)
    x = fits.withColumn("running_total", F.sum(F.when(F.col("fits"), F.col("tokens")).otherwise(0)).over(w))
    return x.select(group, "agent", "tokens", "running_total", (F.col("fits") & (F.col("running_total") <= total)).alias("included"))


def overlay_inventory(o: DataFrame, near: int = 400) -> DataFrame:
    g = o.groupBy("agent").agg(F.count_if(F.col("active")).alias("active"), F.count("*").alias("total"), F.sum(F.when(F.col("active"), F.col("tokens")).otherwise(0)).alias("tokens"))
    return g.withColumn("near_budget", F.col("tokens") > near)


def list_ledger(m: DataFrame, limit: int = 25, **equal) -> DataFrame:
    for k, v in equal.items():
        m = m if v is None else m.where(F.col(k) == v)
    return m.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def promotion_lineage(m: DataFrame) -> DataFrame:
    """(id, promoted_from) to the row each was promoted from and whether that one was promoted too."""
    o = m.select(F.col("id").alias("origin_id"), F.col("promoted_from").alias("earlier"))
    return m.where("promoted_from is not null").join(o, F.col("promoted_from") == F.col("origin_id"), "left").select("id", "origin_id", F.when(F.col("origin_id").isNull(), 0).when(F.col("earlier").isNull(), 1).otherwise(2).alias("depth"))


def prune(e: DataFrame, event: str, as_of: str, days: int = 180) -> DataFrame:
    return e.where((F.col("event") != event) | (F.col("ts") > at(as_of) - F.expr(f"interval '{days}' day")))


def reset_scope(tables: dict[str, DataFrame], scope: str) -> dict[str, DataFrame]:
    """The tables with those of the scope (or all but sessions) emptied."""
    return {n: df.limit(0) if n != "sessions" and scope in (n, "all") else df for n, df in tables.items()}


def counts_after_reset(tables: dict[str, DataFrame], scope: str) -> DataFrame:
    """(name, before, after): how many rows each table has, and would have after the reset."""
    out = None
    for n, df in reset_scope(tables, scope).items():
        same = df is tables[n]
        own = tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("before")).withColumn("after", F.col("before") if same else F.lit(0).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out
