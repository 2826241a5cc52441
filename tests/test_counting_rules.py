"""Rules that no test of the reference covers, each with figures computed by hand."""

import pytest
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators import agents, audit, canary, intervals, patterns, reports, skills
from gleanline.sources import logs

AS_OF = "2024-02-01 00:00:00"


def at(c="t"):
    return F.col(c).cast("timestamp_ntz")


def evidence(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, session_id string, source string, event string, override_reason string, t string").select("*", at().alias("ts"), F.lit("agent").alias("source_kind"), F.lit("p").alias("project"), F.lit(None).cast("long").alias("quarantine_until"))


def test_both_kinds_of_override_count(spark):
    e = evidence(spark, [("s", "fd-a", "override", "agent_wrong", "2024-01-01"), ("s", "hub:fd-a", "disagreement_override", "severity_miscalibrated", "2024-01-01"), ("s", "fd-a", "disagreement_override", "deprioritized", "2024-01-01"), ("s", "fd-a", "agent_dispatch", None, "2024-01-01"), ("s", "fd-b", "agent_dispatch", None, "2024-01-01")])
    got = {r["agent"]: (r["total"], r["wrong"], r["confidence"]) for r in patterns.override_confidence(e).collect()}
    assert got == {"fd-a": (3, 2, 0.666667), "fd-b": (0, 0, 1.0)}
    # canaries: three sessions before, one event each of four; one session after
    rows = [(f"s{i}", "fd-a", ev, r, "2024-01-01") for i in range(3) for ev, r in (("override", "agent_wrong"), ("disagreement_override", "deprioritized"), ("agent_dispatch", None), ("verdict_outcome", None))] + [("s9", "fd-a", "disagreement_override", "severity_miscalibrated", "2024-01-20")]
    s = spark.createDataFrame([("s0", "2024-01-01", "p"), ("s1", "2024-01-02", "p"), ("s2", "2024-01-03", "q"), ("s9", "2024-01-20", "p")], "session_id string, t string, project string").select("session_id", "project", at().alias("start_ts"))
    c = spark.createDataFrame([(1, "fd-a", "2024-01-10", "active", "p")], "id long, group_id string, t string, status string, project string").select("*", at().alias("applied_at"))
    cfg = canary.DEFAULT.__class__(baseline_sessions=2)
    b = canary.canary_baseline(c, evidence(spark, rows), s, cfg).first()
    assert (b["session_count"], b["override_rate"], b["fp_rate"], b["finding_density"], str(b["window_end"])[:10]) == (3, 2.0, 0.5, 4.0, "2024-01-10")
    assert canary.canary_baseline(c, evidence(spark, rows), s, cfg, by_project=True).first()["session_count"] == 2
    x = canary.canary_samples(c, evidence(spark, rows), s).first()
    assert (x["session_id"], x["override_rate"], x["fp_rate"], x["finding_density"]) == ("s9", 1.0, 1.0, 1.0)


def test_consensus_counts_reasons(spark):
    e = evidence(spark, [("s", "fd-a", "override", "agent_wrong", "2024-01-15"), ("s", "fd-a", "override", "", "2024-01-15"), ("s", "fd-b", "agent_dispatch", "odd", "2024-01-15"), ("t", "fd-a", "agent_dispatch", None, "2024-01-15")])
    e = e.unionByName(e.where("id = 3").withColumns({"source": F.lit("Bash"), "source_kind": F.lit("tool")}))
    g = spark.createDataFrame([("error", 1.0, "2024-01-15"), ("error", 0.5, "2024-01-15")], "signal_kind string, value double, t string").select("*", at().alias("observed_at"))
    p = audit.consensus_trend(e, g, AS_OF).first()
    # 2 of 4 agent rows have a reason; two sessions of two sources each, of three in all
    assert (p["agreement_rate"], p["output_diversity"], p["defect_escape_rate"], p["evidence_n"]) == (0.5, 0.666667, 0.25, 5)


def calibration(spark, rates):
    return spark.createDataFrame([(f"fd-{i}", r, r) for i, r in enumerate(rates)], "agent string, hit_rate double, weighted_hit_rate double")


@pytest.mark.parametrize(("now", "old", "verdict"), [
    ([0.5, 0.4, 0.3], [0.5, 0.4, 0.3], "STABLE"), ([0.5], [0.5], "BOOTSTRAP"), ([], [], "BOOTSTRAP"), ([0.9, 0.1], [0.5, 0.1], "DRIFT"),
    ([0.50, 0.51, 0.52], [0.52, 0.51, 0.50], "DRIFT"), ([0.5, None, 0.4], [0.5, 0.4, 0.4], "STABLE"),
])
def test_drift_verdict(spark, now, old, verdict):
    got = audit.drift_verdict(calibration(spark, now), calibration(spark, old)).first()
    assert got["verdict"] == verdict
    assert None not in [r["weighted_hit_rate"] for r in audit.rank_agents(calibration(spark, now)).collect()]


def contexts(spark, event, rows, source="delegate"):
    return spark.createDataFrame([(i, c, t, source) for i, (c, t) in enumerate(rows)], "id long, context string, t string, source string").select("*", at().alias("ts"), F.lit(event).alias("event"), F.lit("s").alias("session_id"), F.when(F.col("id") == 0, 9999999999).alias("quarantine_until"))


def test_delegations_of_one_source_in_quarantine_too(spark):
    rows = [('{"category":"a","verdict":"pass","duration_s":4}', "2024-01-01"), ('{"category":"a","verdict":"fail","retry_needed":1}', "2024-01-02"), ("not json", "2024-01-03")]
    d = contexts(spark, "delegation_outcome", rows)
    other = contexts(spark, "delegation_outcome", rows, "else")
    o = agents.delegation_overall(d.unionByName(other)).first()
    assert (o["total"], o["pass_rate"], o["retry_rate"], o["sufficient"]) == (3, 0.333333, 0.333333, True)
    assert {r["category"]: (r["pass_rate"], r["avg_duration_s"], r["attention"]) for r in agents.delegation_by_category(d).collect()} == {"a": (0.5, 2, True), "unknown": (0.0, 0, True)}
    few = d.where("id < 2")
    assert agents.delegation_overall(few).first()["pass_rate"] is None and agents.delegation_by_category(few).count() == 0


def test_plan_cells_and_review_groups(spark):
    p = contexts(spark, "plan_execution_outcome", [("{}", "2024-01-01"), ('{"author_model":"x","executor_model":"","pass":"yes"}', "2024-01-01"), ('{"pass":true}', "2023-01-01"), ('{"author_model":"x","validator_model":"v","pass":0,"session_source":"bootstrap","escalation_count":"2.9"}', "2024-01-02")])
    got = {(r["author"], r["executor"], r["validator"]): (r["n"], r["weighted_pass_rate"], r["escalated"]) for r in agents.plan_execution_cells(p, AS_OF).collect()}
    assert got == {("x", "unknown", "unknown"): (1, 1.0, 0), ("x", "unknown", "v"): (1, 0.0, 1), (None, None, None): (2, 0.666667, 1)}
    rows = [('{"phase":"plan","p0":1}', "2024-01-01")] + [('{"phase":"plan","p1":1}', "2024-01-01")] * 3 + [('{"phase":"plan","complexity":0}', "2024-01-01")] * 3 + [('{"phase":"plan","complexity":3,"agents":2}', "2024-01-01")] * 2
    got = sorted((r["complexity"], r["total_reviews"], r["action"]) for r in agents.review_phase_calibration(contexts(spark, "review_phase_outcome", rows), AS_OF).collect())
    assert got == [(3, 3, "full"), (3, 3, "skip")]  # none, and 0; the two of complexity 3 are too few


def test_skill_actions_count_signals(spark):
    g = spark.createDataFrame([("a", f"i{i}", "error", 1.0) for i in range(9)] + [("b", f"j{i}", "tokens", 0.5) for i in range(3)], "skill_name string, invocation_id string, signal_kind string, value double").withColumn("observed_at", F.lit("2024-01-20").cast("timestamp_ntz"))
    got = {r["skill_name"]: (r["invocations"], r["action"]) for r in skills.select_skill_action(g, AS_OF).collect()}
    assert got == {"a": (9, "availability"), "b": (3, "when_to_use_add")}
    many = g.unionByName(g.where("skill_name = 'b'").withColumn("signal_kind", F.lit("latency")).crossJoin(spark.range(6)).drop("id"))
    assert [(r["skill_name"], r["n"], r["speed"]) for r in skills.observed_mix(many).collect()] == [("b", 21, 1.0)]


def test_defects_and_their_context(spark):
    rows = [(1, "f", "fixed", '{"reporter":"r","target":"t"}'), (2, "f", "fixed", '{"z":"x","a":"y"}'), (3, "", "fixed", '{"target":"t"}'), (4, "f", None, '{"target":"t"}'), (5, "f", "fixed", "{}"), (6, "f", "fixed", '{"reporter":"r","target":""}')]
    d = spark.createDataFrame(rows, "id long, finding_id string, resolution string, agents_json string").withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "session_id": F.lit(None).cast("string"), "event_type": F.lit("execution_defect"), "chosen_severity": F.lit("high"), "impact": F.lit(None).cast("string")})
    got = {r["id"]: (r["source"], r["session_id"], r["context"]) for r in logs.execution_defects(d).collect()}
    assert got[1] == ("t", "unknown", '{"finding_id":"f","reporter":"r","target":"t","severity":"high","resolution":"fixed","impact":""}')
    assert {i: v[0] for i, v in got.items()} == {1: "t", 2: "a", 6: "reporter"}


def test_workspaces_and_alerts(spark):
    rows = ["/home/u/.x/projects/-home-u-w/s.jsonl", "projects/w/s/sub/a.jsonl", "/home/u/w/", "w"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(T.workspace_key(F.col("p"))).collect()] == ["-home-u-w", "w", "-home-u-w", "-w"]
    o = spark.createDataFrame([("a", "exclude")], "agent string, action string")
    c = spark.createDataFrame([("x", "alert"), ("b", "alert"), ("y", "active")], "group_id string, status string")
    r = reports.override_summary(o, c).first()
    assert (r["excluded_agents"], r["proposed"], r["alerts"], r["alert_agents"]) == ("a", 0, 2, "b, x") and reports.override_summary(o).first()["alerts"] == 0


def test_dyadic_nodes_cover_an_interval_once(spark):
    rows = [(a, a + n) for a in (0, 1, 5, 1000, -7) for n in (0, 1, 2, 7, 64, 521)] + [(3, 2), (None, 4)]
    d = spark.createDataFrame(rows, "a long, b long").select("*", intervals.nodes_of(F.col("a"), F.col("b")).alias("n"))
    for r in d.collect():
        cells = sorted(c for x in r["n"] or [] for c in range(x["node"] << x["level"], (x["node"] + 1) << x["level"]))
        assert cells == (list(range(r["a"], r["b"] + 1)) if r["a"] is not None else [])
        if cells:
            assert len(r["n"]) <= 2 * max(1, len(cells).bit_length())
    few = spark.createDataFrame([(0, 99)], "a long, b long").select(intervals.nodes_of(F.col("a"), F.col("b"), 3).alias("n")).first()["n"]
    assert sum(1 << x["level"] for x in few) == 100 and max(x["level"] for x in few) == 2
    over = spark.createDataFrame([(13,)], "c long").select(intervals.nodes_over(F.col("c"), 4).alias("n")).first()["n"]
    assert [tuple(x) for x in over] == [(0, 13), (1, 6), (2, 3), (3, 1)]


def test_items_open_for_ten_years(spark):
    """An item's rows grow with the logarithm of its age, and the latest open one is found."""
    items = spark.createDataFrame([("old", "2014-01-01", None), ("mid", "2018-01-01", "2024-01-05"), ("late", "2023-12-31", "2024-01-03")], "id string, s string, c string").select("id", F.lit("p").alias("project"), at("s").alias("started_at"), at("c").alias("closed_at"), F.lit("open").alias("status"), at("s").alias("updated_at"))
    inv = spark.createDataFrame([("a", "2013-01-01"), ("b", "2016-05-05"), ("c", "2020-01-01"), ("d", "2024-01-02"), ("e", "2024-01-04"), ("f", "2024-01-20")], "invocation_id string, t string").select("invocation_id", at().alias("ts"), F.lit("p").alias("project"), F.lit("s").alias("session_id"), F.lit("k").alias("skill_name"))
    got = {r["invocation_id"]: r["bead_id"] for r in skills.bead_asof(inv, items).collect()}
    assert got == {"b": "old", "c": "mid", "d": "late", "e": "mid", "f": "old"}
    week = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (7 * 86400))
    n = items.where("id = 'old'").select(F.size(intervals.nodes_of(week("started_at") + 1, F.lit(2820).cast("long")))).first()[0]
    assert n <= 2 * 10
