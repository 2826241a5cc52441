"""Agent scores, delegation, plan execution and review calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.config import SAFETY_FLOOR, SOURCE_WEIGHTS
from gleanline.functions.text import lenient_bool, lenient_int, normalize_agent
from gleanline.operators.filters import in_window, quarantine_filter

#: Sessions other than bootstrap that a recommendation needs to be passed on.
NON_BOOTSTRAP = 20
#: Why a model is recommended.
REASONS = (
    "weighted_hit_rate in dead zone (0.3-0.6), no change", "low hit rate but safety floor prevents demotion",
    "high weighted hit rate, appropriate tier", "low weighted hit rate, recommend demotion",
)
SCORED = ("agent_dispatch", "verdict_outcome", "override", "disagreement_override")


def _parsed(e: DataFrame) -> DataFrame:
    """e with its context parsed once, as ctx__; what does not parse is null."""
    return e.withColumn("ctx__", F.try_parse_json("context"))


def _field(name: str) -> Column:
    return F.try_variant_get("ctx__", f"$.{name}", "string")


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c), F.lit("unknown"))


def source_weight(c: Column) -> Column:
    out = F.lit(1.0)
    for name, w in SOURCE_WEIGHTS.items():
        out = F.when(c == name, w).otherwise(out)
    return out


def join_session_source(e: DataFrame, s: DataFrame) -> DataFrame:
    """Evidence with the source of its session; of an unknown session bootstrap."""
    own = s.select("session_id", F.col("source").alias("session_source"))
    return e.join(own, "session_id", "left").withColumn("session_source", F.coalesce("session_source", F.lit("bootstrap")))


def _scored(rows: DataFrame, keys: list[str], non_bootstrap: DataFrame) -> DataFrame:
    verdict = F.col("event") == "verdict_outcome"
    hit = verdict & (F.col("status") == "NEEDS_ATTENTION")
    w = source_weight(F.col("session_source"))
    g = rows.groupBy(*keys).agg(
        F.countDistinct("session_id").alias("evidence_sessions"), F.count_if(verdict).alias("verdicts"), F.sum(F.when(verdict, lenient_int(F.col("findings_count"))).otherwise(0)).alias("findings"),
        F.count_if(hit).alias("hits"), F.sum(F.when(verdict, w)).alias("w"), F.sum(F.when(hit, w).otherwise(0.0)).alias("wh"),
    )
    g = g.where("evidence_sessions >= 3 and verdicts > 0 and findings > 0").crossJoin(F.broadcast(non_bootstrap))
    eligible = F.col("n_normal") >= NON_BOOTSTRAP
    whr = F.col("wh") / F.col("w")
    confidence = F.when(F.col("evidence_sessions") >= 5, 0.85).when(F.col("evidence_sessions") >= 3, 0.7).otherwise(0.5)
    low = whr < 0.3
    floor = F.col("agent").isin(*SAFETY_FLOOR)
    model = F.when(whr >= 0.6, "sonnet").when(low & ~floor, "haiku").otherwise("sonnet")
    few = F.concat(F.lit("insufficient non-bootstrap sessions ("), F.col("n_normal").cast("string"), F.lit(f"/{NON_BOOTSTRAP})"))
    reason = F.when(~low & (whr < 0.6), REASONS[0]).when(~eligible, few).when(low & floor, REASONS[1]).when(whr >= 0.6, REASONS[2]).otherwise(REASONS[3])
    return g.select(
        *keys, "evidence_sessions", F.round(F.col("hits") / F.col("verdicts"), 6).alias("hit_rate"), F.round(whr, 6).alias("weighted_hit_rate"), confidence.alias("confidence"),
        model.alias("recommended_model"), eligible.alias("propagation_eligible"), reason.alias("reason"),
    )


def _rows(e: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = join_session_source(e.where(F.col("event").isin(*SCORED)).where("coalesce(source_kind, 'agent') = 'agent'"), s).withColumn("agent", _or_unknown(normalize_agent(F.col("source"))))
    rows = _parsed(rows).select("agent", "session_id", "event", "session_source", _field("status").alias("status"), _field("findings_count").alias("findings_count"), F.trim(_field("phase")).alias("phase"))
    return rows, s.where("coalesce(source, 'normal') <> 'bootstrap'").agg(F.count("*").alias("n_normal"))


def agent_scores(e: DataFrame, s: DataFrame) -> DataFrame:
    rows, n = _rows(e, s)
    return _scored(rows, ["agent"], n)


def agent_phase_scores(e: DataFrame, s: DataFrame) -> DataFrame:
    """As agent_scores for each phase that a row's context names."""
    rows, n = _rows(e, s)
    return _scored(rows.where("phase <> ''"), ["agent", "phase"], n)


def agent_scores_fallback(e: DataFrame, s: DataFrame) -> DataFrame:
    """An agent's own recommendation, or that of its first phase if it has none."""
    own, phase = agent_scores(e, s), agent_phase_scores(e, s)
    first = phase.groupBy("agent").agg(F.min_by(F.struct("recommended_model", "weighted_hit_rate"), "phase").alias("p"))
    x = own.select("agent", F.struct("recommended_model", "weighted_hit_rate").alias("o")).join(first, "agent", "full")
    x = x.select("agent", F.coalesce("o", "p").alias("r"), F.col("o").isNull().alias("from_phase"))
    return x.select("agent", "r.recommended_model", "r.weighted_hit_rate", "from_phase")


#: The source whose delegations are reported.
DELEGATE = "delegate"
#: Delegations under which no rates are told.
LEAST_DELEGATIONS = 3


def _delegations(e: DataFrame, source: str) -> DataFrame:
    """All of the source, in quarantine too."""
    d = _parsed(e.where("event = 'delegation_outcome'").where(F.col("source") == source))
    return d.select("id", "ts", F.coalesce(_field("category"), F.lit("unknown")).alias("category"), _field("tier").alias("tier"), _field("verdict").alias("verdict"), lenient_bool(_field("retry_needed")).alias("retry"), _field("duration_s").try_cast("double").alias("duration_s"))


def _passed() -> Column:
    return F.coalesce(F.col("verdict").isin("pass", "CLEAN"), F.lit(False))


def delegation_overall(e: DataFrame, source: str = DELEGATE) -> DataFrame:
    g = _delegations(e, source).agg(F.count("*").alias("total"), F.count_if(_passed()).alias("p"), F.count_if(F.col("retry")).alias("r"))
    enough = F.col("total") >= LEAST_DELEGATIONS
    return g.select("total", F.when(enough, F.round(F.col("p") / F.col("total"), 6)).alias("pass_rate"), F.when(enough, F.round(F.col("r") / F.col("total"), 6)).alias("retry_rate"), enough.alias("sufficient"))


def delegation_by_category(e: DataFrame, source: str = DELEGATE) -> DataFrame:
    """A missing duration counts as 0; attention where under 70 % pass. No row while there are too few delegations in all."""
    g = _delegations(e, source).groupBy("category").agg(F.count("*").alias("count"), F.count_if(_passed()).alias("p"), F.sum(F.coalesce("duration_s", F.lit(0.0))).alias("d"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("count").alias("total")))).where(F.col("total") >= LEAST_DELEGATIONS)  # one row
    return g.select("category", "count", F.round(F.col("p") / F.col("count"), 6).alias("pass_rate"), F.floor(F.col("d") / F.col("count") + 0.5).cast("long").alias("avg_duration_s"), (F.col("p") / F.col("count") < 0.7).alias("attention"))


def delegation_status(e: DataFrame, source: str = DELEGATE) -> DataFrame:
    """Missing durations are left out here; attention needs three delegations."""
    g = _delegations(e, source).groupBy("category").agg(F.count("*").alias("count"), F.count_if(_passed()).alias("p"), F.avg("duration_s").alias("d"))
    pct = F.floor(100 * F.col("p") / F.col("count") + 0.5).cast("long")
    return g.select("category", "count", pct.alias("pass_pct"), F.round("d", 6).alias("avg_duration_s"), ((100 * F.col("p") / F.col("count") < 70) & (F.col("count") >= 3)).alias("attention"))


def delegation_recent(e: DataFrame, n: int = 5, source: str = DELEGATE) -> DataFrame:
    return _delegations(e, source).orderBy(F.desc("ts"), F.desc("id")).limit(n).select("ts", "category", "tier", "verdict", "duration_s")


def plan_execution_cells(e: DataFrame, as_of: str, min_n: int = 5, days: int = 180) -> DataFrame:
    """Weighted pass rate by author, executor and validator of the retention's days, and over all (nulls), in one grouping-sets pass. Rows without a time stay."""
    own = quarantine_filter(e, as_of).where("event = 'plan_execution_outcome'")
    own = own.where(F.coalesce(in_window(days, as_of), F.lit(True))) if "ts" in e.columns else own
    p = _parsed(own).select(
        *(_or_unknown(_field(f"{k}_model")).alias(k) for k in ("author", "executor", "validator")),
        lenient_bool(_field("pass")).alias("pass"), (lenient_int(_field("escalation_count")) > 0).alias("esc"), source_weight(F.coalesce(_field("session_source"), F.lit("normal"))).alias("w"),
    )
    g = p.groupingSets([["author", "executor", "validator"], []], "author", "executor", "validator").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.when(F.col("pass"), F.col("w")).otherwise(0.0)).alias("wp"), F.count_if("esc").alias("escalated"))
    return g.select("author", "executor", "validator", "n", F.round(F.col("wp") / F.col("w"), 6).alias("weighted_pass_rate"), "escalated", (F.col("n") >= min_n).alias("sufficient"))


def review_phase_calibration(e: DataFrame, as_of: str, min_n: int = 3) -> DataFrame:
    """By phase and complexity; one that is missing or 0 is a group of its own, told as complexity 3."""
    def number(name):
        return _field(name).try_cast("double")

    r = _parsed(quarantine_filter(e, as_of).where("event = 'review_phase_outcome'")).select(_field("phase").alias("phase"), number("complexity").cast("long").alias("complexity"), number("p0").alias("p0"), number("p1").alias("p1"), number("agents").alias("agents"))
    g = r.groupBy("phase", "complexity").agg(F.count("*").alias("total_reviews"), F.count_if(F.coalesce("p0", F.lit(0)) + F.coalesce("p1", F.lit(0)) > 0).alias("bad"), F.avg(F.coalesce("agents", F.lit(0.0))).alias("avg_agents")).where(F.col("total_reviews") >= min_n)
    rate = F.col("bad") / F.col("total_reviews")
    told = F.coalesce(F.when(F.col("complexity") != 0, F.col("complexity")), F.lit(3))
    return g.select("phase", told.cast("long").alias("complexity"), "total_reviews", F.round(rate, 6).alias("p0p1_rate"), F.round("avg_agents", 6).alias("avg_agents"), F.when(rate < 0.05, "skip").when(rate < 0.15, "lighten").otherwise("full").alias("action"))


def review_ready(e: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """The least count over three phases, 0 for one that is missing."""
    phase = _field("phase")
    g = _parsed(quarantine_filter(e, as_of).where("event = 'review_phase_outcome'")).agg(*(F.count_if(phase == p).alias(p) for p in ("brainstorm", "strategy", "plan")))
    return g.select(F.least("brainstorm", "strategy", "plan").alias("count")).withColumn("ready", F.col("count") >= n)


def decomposition_ready(e: DataFrame, as_of: str, n: int = 30) -> DataFrame:
    return quarantine_filter(e, as_of).where("event = 'decomposition_outcome'").agg(F.count("*").alias("count")).withColumn("ready", F.col("count") >= n)
