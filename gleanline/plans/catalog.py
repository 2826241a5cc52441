"""Every query: an operator over the views, and what it must equal as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.config import Thresholds
from gleanline.functions import text as T
from gleanline.operators import agents, audit, canary, filters, patterns, reports, safety, sketches, skills
from gleanline.plans.fixtures import AS_OF, LEDGER_AS_OF, Fixtures, with_views
from gleanline.sources import logs, tables, verdicts
from gleanline.sources.versions import BatchTables, VersionedTable, shared_folder
from gleanline.streaming import canaries, cursor
from gleanline.streaming import sessions as live

N = "regexp_replace(source, '^(hub:review:|hub:)(fd-)', '\\2')"
E30 = "ts > TIMESTAMP '2024-01-01 00:00:00'"
O30 = "observed_at > TIMESTAMP '2024-01-01 00:00:00'"
A14 = "ts > TIMESTAMP '2024-01-17 00:00:00'"
P14 = "ts > TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-17 00:00:00'"

#: Common parts of the expected results.
PARTS = {
    "vis": "SELECT *, " + N + " AS agent FROM evidence WHERE coalesce(quarantine_until, 0) <= 1706659200",
    "nev": "SELECT *, " + N + " AS agent FROM evidence",
    "grp": """SELECT agent AS source, event, coalesce(override_reason, '') AS override_reason, count(*) AS event_count, count(DISTINCT session_id) AS session_count,
      count(DISTINCT project) AS project_count FROM vis GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "pat": """SELECT *, CASE CAST(session_count >= 3 AS INT) + CAST(project_count >= 2 AS INT) + CAST(event_count >= 5 AS INT) WHEN 3 THEN 'ready' WHEN 0 THEN 'emerging' ELSE 'growing' END AS classification FROM grp""",
    "wrongp": """SELECT agent, count(*) AS total, count(*) FILTER (override_reason IN ('agent_wrong', 'severity_miscalibrated')) AS wrong,
      CAST(floor(100.0 * count(*) FILTER (override_reason IN ('agent_wrong', 'severity_miscalibrated')) / count(*)) AS BIGINT) AS wrong_pct
      FROM vis WHERE source_kind = 'agent' AND event IN ('override', 'disagreement_override') GROUP BY 1""",
    "elig": """SELECT a.agent, coalesce(w.total, 0) AS total, coalesce(w.wrong, 0) AS wrong, w.wrong_pct,
      CASE WHEN NOT regexp_matches(a.agent, '^fd-[a-z][a-z0-9-]*$') THEN 'invalid_agent_name' WHEN b.pattern_key IS NOT NULL THEN 'blacklisted' WHEN coalesce(w.total, 0) = 0 THEN 'no_override_events'
           WHEN w.wrong_pct < 80 THEN concat('agent_wrong_pct=', w.wrong_pct) ELSE 'eligible' END AS status
      FROM (SELECT DISTINCT agent FROM nev WHERE source_kind = 'agent') a LEFT JOIN wrongp w USING (agent) LEFT JOIN blacklist b ON b.pattern_key = a.agent""",
    "inv": """SELECT source_event_id AS invocation_id, session_id, source AS skill_name, ts, project FROM evidence WHERE source_kind = 'skill' AND event = 'skill_invocation' AND source_event_id IS NOT NULL""",
    "pend": "SELECT * FROM inv WHERE invocation_id NOT IN (SELECT invocation_id FROM skill_signals WHERE signal_kind = 'bead_close')",
    "asof_all": """SELECT i.*, w.id AS bead_id, w.started_at, w.status, w.closed_at, w.updated_at, row_number() OVER (PARTITION BY i.invocation_id ORDER BY w.started_at DESC, w.id DESC) AS r,
      lead(w.started_at) OVER (PARTITION BY i.invocation_id ORDER BY w.started_at DESC, w.id DESC) AS second
      FROM pend i JOIN work_items w ON w.project = i.project AND w.started_at <= i.ts AND (w.closed_at IS NULL OR w.closed_at > i.ts)""",
    "asofj": "SELECT invocation_id, session_id, skill_name, project, ts, bead_id, started_at, status, closed_at, updated_at FROM asof_all WHERE r = 1 AND (second IS NULL OR floor(epoch(started_at)) - floor(epoch(second)) > 60)",
    "eff": "SELECT source AS agent, count(*) FILTER (event = 'agent_dispatch') AS d, count(*) FILTER (event = 'override') AS c, count(DISTINCT session_id) AS s FROM evidence WHERE source LIKE 'fd-%' AND " + E30 + " GROUP BY 1 HAVING count(*) FILTER (event = 'agent_dispatch') > 0",
    "effn": "SELECT source AS agent, round(100.0 * count(*) FILTER (event = 'override') / count(*) FILTER (event = 'agent_dispatch'), 6) AS rate FROM evidence WHERE source LIKE 'fd-%' AND " + A14 + " GROUP BY 1 HAVING count(*) FILTER (event = 'agent_dispatch') > 0",
    "effp": "SELECT source AS agent, round(100.0 * count(*) FILTER (event = 'override') / count(*) FILTER (event = 'agent_dispatch'), 6) AS rate FROM evidence WHERE source LIKE 'fd-%' AND " + P14 + " GROUP BY 1 HAVING count(*) FILTER (event = 'agent_dispatch') > 0",
    "disp": "SELECT source AS agent, project, count(*) FILTER (event = 'agent_dispatch') AS d, count(*) FILTER (event = 'override') AS c FROM evidence WHERE source LIKE 'fd-%' AND " + E30 + " GROUP BY 1, 2 HAVING count(*) FILTER (event = 'agent_dispatch') > 0",
    "cross_p": "SELECT agent, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, count(DISTINCT project) AS project_count, CAST(sum(d) AS BIGINT) AS total_dispatches, CAST(sum(c) AS BIGINT) AS total_corrections, floor(1000.0 * sum(c) / sum(d)) / 10 AS override_rate FROM disp GROUP BY 1",
    "scored": """SELECT n.agent, n.session_id, n.event, json_extract_string(n.context, '$.phase') AS phase, json_extract_string(n.context, '$.status') = 'NEEDS_ATTENTION' AS hit, coalesce(TRY_CAST(json_extract_string(n.context, '$.findings_count') AS BIGINT), 0) AS f,
      coalesce(s.source, 'bootstrap') AS ss, CASE coalesce(s.source, 'bootstrap') WHEN 'bootstrap' THEN 0.5 WHEN 'self-building' THEN 0.7 ELSE 1.0 END::DOUBLE AS w
      FROM nev n LEFT JOIN sessions s ON s.session_id = n.session_id WHERE n.source_kind = 'agent' AND n.event IN ('agent_dispatch', 'verdict_outcome', 'override', 'disagreement_override')""",
    "normal_n": "SELECT count(*) AS n FROM sessions WHERE coalesce(source, 'normal') <> 'bootstrap'",
    "cal": """SELECT agent, ph AS phase, es AS evidence_sessions, round(h * 1.0 / v, 6) AS hit_rate, round(x, 6) AS weighted_hit_rate, CASE WHEN es >= 5 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence,
      CASE WHEN x < 0.3 AND agent NOT IN ('fd-architecture', 'fd-correctness', 'fd-safety', 'fd-quality') THEN 'haiku' ELSE 'sonnet' END AS recommended_model, (SELECT n FROM normal_n) >= 20 AS propagation_eligible,
      CASE WHEN x >= 0.3 AND x < 0.6 THEN 'weighted_hit_rate in dead zone (0.3-0.6), no change' WHEN (SELECT n FROM normal_n) < 20 THEN concat('insufficient non-bootstrap sessions (', (SELECT n FROM normal_n), '/20)')
           WHEN x < 0.3 AND agent IN ('fd-architecture', 'fd-correctness', 'fd-safety', 'fd-quality') THEN 'low hit rate but safety floor prevents demotion' WHEN x >= 0.6 THEN 'high weighted hit rate, appropriate tier' ELSE 'low weighted hit rate, recommend demotion' END AS reason
      FROM (SELECT agent, ph, count(DISTINCT session_id) AS es, count(*) FILTER (event = 'verdict_outcome') AS v, sum(f) FILTER (event = 'verdict_outcome') AS f, count(*) FILTER (event = 'verdict_outcome' AND hit) AS h,
        coalesce(sum(w) FILTER (event = 'verdict_outcome' AND hit), 0) / sum(w) FILTER (event = 'verdict_outcome') AS x
        FROM (SELECT *, NULL AS ph FROM scored UNION ALL SELECT *, phase AS ph FROM scored WHERE phase <> '') GROUP BY agent, ph) WHERE es >= 3 AND v > 0 AND f > 0""",
    "deleg": """SELECT id, ts, coalesce(json_extract_string(context, '$.category'), 'unknown') AS category, json_extract_string(context, '$.tier') AS tier, json_extract_string(context, '$.verdict') AS verdict,
      coalesce(json_extract_string(context, '$.retry_needed') = 'true', false) AS retry, TRY_CAST(json_extract_string(context, '$.duration_s') AS DOUBLE) AS dur FROM ctx WHERE event = 'delegation_outcome' AND source = 'delegate'""",
    "means": "SELECT skill_name, signal_kind, sum(pow(0.5, greatest(1706659200 - floor(epoch(observed_at)), 0) / 86400.0 / 14) * value) / sum(pow(0.5, greatest(1706659200 - floor(epoch(observed_at)), 0) / 86400.0 / 14)) AS value FROM skill_signals WHERE " + O30 + " GROUP BY 1, 2",
    "info": "SELECT signal_kind, stddev_pop(value) AS sigma, CASE WHEN stddev_pop(value) < 1e-6 THEN 0 ELSE least(stddev_pop(value) / 0.15, 1) END::DOUBLE AS iw FROM means GROUP BY 1",
    "gw": "SELECT * FROM (VALUES ('tokens', 'speed', 1.0::DOUBLE), ('error', 'precision', 1.0), ('no_redirect', 'precision', 0.5), ('bead_close', 'completeness', 1.0)) t(signal_kind, goal, weight)",
    "gv": "SELECT m.skill_name AS skill, g.goal, CASE WHEN sum(g.weight * i.iw) > 0 THEN sum(g.weight * i.iw * m.value) / sum(g.weight * i.iw) ELSE sum(g.weight * m.value) / sum(g.weight) END AS value FROM means m JOIN gw g USING (signal_kind) JOIN info i USING (signal_kind) GROUP BY 1, 2",
    "qual": "SELECT skill_name, count(DISTINCT invocation_id) AS invocations FROM inv WHERE " + E30 + " GROUP BY 1 HAVING count(DISTINCT invocation_id) >= 10",
    "sc": """SELECT q.skill_name AS skill, q.invocations AS invocations_30d, round(coalesce(sum(v.value * CASE v.goal WHEN 'speed' THEN coalesce(o.speed, 1.0/3) WHEN 'precision' THEN coalesce(o.precision, 1.0/3) ELSE coalesce(o.completeness, 1.0/3) END)
        / sum(CASE v.goal WHEN 'speed' THEN coalesce(o.speed, 1.0/3) WHEN 'precision' THEN coalesce(o.precision, 1.0/3) ELSE coalesce(o.completeness, 1.0/3) END), 0), 6) AS score,
      round(max(v.value) FILTER (v.goal = 'speed'), 6) AS speed, round(max(v.value) FILTER (v.goal = 'precision'), 6) AS precision, round(max(v.value) FILTER (v.goal = 'completeness'), 6) AS completeness,
      CASE WHEN max(o.skill_name) IS NULL THEN 'uniform' ELSE 'classified' END AS goal_source
      FROM qual q LEFT JOIN gv v ON v.skill = q.skill_name LEFT JOIN goals o ON o.skill_name = q.skill_name GROUP BY 1, 2""",
    "gvs": "SELECT m.skill_name AS skill, g.goal, sum(g.weight * m.value) / sum(g.weight) AS value FROM means m JOIN gw g USING (signal_kind) GROUP BY 1, 2",
    "scs0": """SELECT q.skill_name AS skill, q.invocations AS invocations_30d, round(coalesce(sum(v.value * CASE v.goal WHEN 'speed' THEN coalesce(o.speed, 1.0/3) WHEN 'precision' THEN coalesce(o.precision, 1.0/3) ELSE coalesce(o.completeness, 1.0/3) END)
        / sum(CASE v.goal WHEN 'speed' THEN coalesce(o.speed, 1.0/3) WHEN 'precision' THEN coalesce(o.precision, 1.0/3) ELSE coalesce(o.completeness, 1.0/3) END), 0), 6) AS score,
      round(max(v.value) FILTER (v.goal = 'speed'), 6) AS speed, round(max(v.value) FILTER (v.goal = 'precision'), 6) AS precision, round(max(v.value) FILTER (v.goal = 'completeness'), 6) AS completeness,
      CASE WHEN max(o.skill_name) IS NULL THEN 'uniform' ELSE 'classified' END AS goal_source
      FROM qual q LEFT JOIN gvs v ON v.skill = q.skill_name LEFT JOIN goals o ON o.skill_name = q.skill_name GROUP BY 1, 2""",
    "smean": "SELECT skill_name, signal_kind, round(avg(value), 6) AS mean FROM skill_signals WHERE " + O30 + " GROUP BY 1, 2",
    "ags": "SELECT agent, session_id, count(*) AS ev, count(*) FILTER (event IN ('override', 'disagreement_override')) AS o, count(*) FILTER (event IN ('override', 'disagreement_override') AND override_reason IN ('agent_wrong', 'severity_miscalibrated')) AS w FROM nev GROUP BY 1, 2",
    "ags2": "SELECT a.*, s.start_ts FROM ags a JOIN sessions s USING (session_id)",
    "lastn": "SELECT * FROM (SELECT c.id AS canary_id, c.applied_at, a.*, row_number() OVER (PARTITION BY c.id ORDER BY a.start_ts DESC, a.session_id DESC) AS rank FROM canary c JOIN ags2 a ON a.agent = c.group_id AND a.start_ts < c.applied_at) WHERE rank <= 20",
    "basel": "SELECT canary_id, count(*) AS session_count, round(sum(o) * 1.0 / count(*), 6) AS override_rate, round(CASE WHEN sum(o) > 0 THEN sum(w) * 1.0 / sum(o) ELSE 0 END, 6) AS fp_rate, round(sum(ev) * 1.0 / count(*), 6) AS finding_density, min(start_ts) AS window_start, max(applied_at) AS window_end FROM lastn GROUP BY 1 HAVING count(*) >= 15",
    "samp": "SELECT c.id AS canary_id, a.session_id, a.o::DOUBLE AS override_rate, round(CASE WHEN a.o > 0 THEN a.w * 1.0 / a.o ELSE 0 END, 6) AS fp_rate, a.ev::DOUBLE AS finding_density FROM canary c JOIN ags2 a ON a.agent = c.group_id AND a.start_ts >= c.applied_at WHERE c.status = 'active'",
    "summ": """SELECT c.*, b.override_rate AS bo, b.fp_rate AS bf, b.finding_density AS bd, c.applied_at + INTERVAL 14 DAY AS exp, coalesce(n, 0) AS sample_count, avg_override_rate, avg_fp_rate, avg_finding_density FROM canary c LEFT JOIN basel b ON b.canary_id = c.id
      LEFT JOIN (SELECT canary_id, count(*) AS n, round(avg(override_rate), 6) AS avg_override_rate, round(avg(fp_rate), 6) AS avg_fp_rate, round(avg(finding_density), 6) AS avg_finding_density FROM samp GROUP BY 1) s ON s.canary_id = c.id""",
    "bad": "SELECT *, coalesce(abs(avg_override_rate - bo) >= 0.1 AND avg_override_rate > bo * 1.2, false) AS x, coalesce(abs(avg_fp_rate - bf) >= 0.1 AND avg_fp_rate > bf * 1.2, false) AS y, coalesce(abs(avg_finding_density - bd) >= 0.1 AND avg_finding_density < bd * 0.8, false) AS z FROM summ",
    "scs": """SELECT DISTINCT m.modification_id, m.skill_name, g.invocation_id, g.signal_kind, b.mean AS baseline_value, g.value AS canary_value, round(g.value - b.mean, 6) AS delta FROM skill_signals g JOIN skill_mods m USING (skill_name)
      JOIN smean b ON b.skill_name = g.skill_name AND b.signal_kind = g.signal_kind WHERE g.observed_at > m.applied_at""",
    "now_h": "SELECT * FROM history WHERE calibrated_at = (SELECT max(calibrated_at) FROM history)",
    "old_h": "SELECT * FROM history WHERE calibrated_at = (SELECT max(calibrated_at) FROM history WHERE calibrated_at <= TIMESTAMP '2024-01-21 00:00:00')",
    "drift0": """SELECT agent, round(a.weighted_hit_rate - b.weighted_hit_rate, 6) AS delta_hit_rate, a.r - b.r AS delta_rank FROM (SELECT *, row_number() OVER (ORDER BY weighted_hit_rate DESC, agent) AS r FROM now_h WHERE agent IN (SELECT agent FROM old_h)) a
      JOIN (SELECT *, row_number() OVER (ORDER BY weighted_hit_rate DESC, agent) AS r FROM old_h WHERE agent IN (SELECT agent FROM now_h)) b USING (agent)""",
    "dr": "SELECT *, CASE WHEN abs(delta_hit_rate) >= 0.2 OR abs(delta_rank) >= 5 THEN 'high' WHEN delta_hit_rate <> 0 OR delta_rank <> 0 THEN 'low' ELSE 'none' END AS severity FROM drift0",
    "coh0": """SELECT DISTINCT r.skill_name, r.session_id, o.session_id AS other, o.tokens AS other_tokens FROM (SELECT DISTINCT skill_name, session_id FROM inv) r JOIN sessions s ON s.session_id = r.session_id
      JOIN sessions o ON o.project = s.project AND abs(floor(epoch(s.start_ts)) - floor(epoch(o.start_ts))) <= 604800""",
    "coh": "SELECT c.* FROM coh0 c LEFT JOIN (SELECT DISTINCT skill_name, session_id AS other FROM inv) x USING (skill_name, other) WHERE x.skill_name IS NULL",
    "disag": """SELECT id, ts, coalesce(session_id, 'unknown') AS session_id, source, 'disagreement_override' AS event, CASE coalesce(dismissal_reason, '') WHEN 'agent_wrong' THEN 'agent_wrong' WHEN 'deprioritized' THEN 'deprioritized' WHEN 'already_fixed' THEN 'stale_finding' WHEN 'not_applicable' THEN 'not_applicable'
        WHEN '' THEN CASE WHEN resolution = 'accepted' AND impact = 'severity_overridden' THEN 'severity_miscalibrated' ELSE '' END ELSE '' END AS override_reason, dismissal_reason AS raw_override_reason,
        concat('{"finding_id":"', finding_id, '","agent_severity":"', sev, '","chosen_severity":"', chosen_severity, '","resolution":"', resolution, '","impact":"', impact, '","dismissal_reason":"', coalesce(dismissal_reason, ''), '"}') AS context
      FROM (SELECT *, 'fd-safety' AS source, json_extract_string(agents_json, '$."fd-safety"') AS sev FROM reviews UNION ALL SELECT *, 'fd-quality', json_extract_string(agents_json, '$."fd-quality"') FROM reviews UNION ALL SELECT *, 'reporter', json_extract_string(agents_json, '$.reporter') FROM reviews UNION ALL SELECT *, 'target', json_extract_string(agents_json, '$.target') FROM reviews) WHERE event_type = 'disagreement' AND finding_id <> '' AND resolution <> '' AND chosen_severity <> '' AND sev <> chosen_severity""",
    "vdocs": """SELECT concat(agent, '-', day(ts)) AS name, ts, id, CASE WHEN id % 2 = 0 THEN session_id ELSE 'sweep' END AS session_id,
        concat('{"status":"', status, '"', CASE WHEN findings_count > 0 THEN concat(',"findings_count":', findings_count) ELSE '' END, CASE WHEN id % 2 = 0 THEN concat(',"session_id":"', session_id, '"') ELSE '' END, '}') AS body,
        concat('{"status":"', status, '","findings_count":', findings_count, ',"model_used":"unknown"}') AS context FROM verdicts""",
    "defects": """SELECT id, ts, session_id, target AS source, 'execution_defect' AS event, '' AS override_reason, '' AS raw_override_reason,
        concat('{"finding_id":"', finding_id, '","reporter":"', coalesce(json_extract_string(agents_json, '$.reporter'), ''), '","target":"', target, '","severity":"', chosen_severity, '","resolution":"', resolution, '","impact":"', impact, '"}') AS context
      FROM (SELECT *, coalesce(json_extract_string(agents_json, '$.target'), list_sort(json_keys(agents_json))[1]) AS target FROM reviews) WHERE event_type = 'execution_defect' AND finding_id <> '' AND target <> ''""",
    "goal_of": """SELECT *, CASE bucket WHEN 'audit' THEN 0.1 WHEN 'search' THEN 0.7 WHEN 'orchestration' THEN 0.15 ELSE 0.2 END::DOUBLE AS speed, CASE bucket WHEN 'audit' THEN 0.3 WHEN 'search' THEN 0.2 WHEN 'orchestration' THEN 0.45 ELSE 0.6 END::DOUBLE AS precision,
      CASE bucket WHEN 'audit' THEN 0.6 WHEN 'search' THEN 0.1 WHEN 'orchestration' THEN 0.4 ELSE 0.2 END::DOUBLE AS completeness
      FROM (SELECT skill_name, text, CASE WHEN regexp_matches(lower(text), 'audit|review|verify|coverage|gate|lint|check') THEN 'audit' WHEN regexp_matches(lower(text), 'search|retriev|lookup|recall|find|query|index') THEN 'search'
        WHEN regexp_matches(lower(text), 'sequenc|orchestrat|phase|lifecycle|workflow|pipeline|dispatch|brainstorm|ship') THEN 'orchestration' ELSE 'default' END AS bucket FROM skill_docs)""",
    "lt": "SELECT *, TIMESTAMP '2001-08-01 00:00:00' AS now FROM modifications",
}

#: A text in DuckDB without escapes and controls, cut.
SANE = r"substr(regexp_replace(regexp_replace(text, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), 1, 500)"


def _redacted(of: str) -> str:
    """The nine forms of secrets in DuckDB."""
    space = r"[ \t\r\f\x0b]"
    for pattern, to, how in (
        (rf"""(api[_-]?key|apikey|api[_-]?secret){space}*[:=]{space}*[''"][^''"\n]{{8,}}[''"]""", r"\1=[REDACTED:api_key]", "gi"),
        (rf"(bearer|token|auth){space}+[A-Za-z0-9_\\.\-]{{20,}}", r"\1 [REDACTED:token]", "gi"),
        ("AKIA[0-9A-Z]{16}", "[REDACTED:aws_key]", "g"),
        ("gh[ps]_[A-Za-z0-9]{36,}", "[REDACTED:github_token]", "g"),
        ("github_pat_[A-Za-z0-9_]{22,}", "[REDACTED:github_token]", "g"),
        (r"sk-ant-[A-Za-z0-9\\\-]{20,}", "[REDACTED:anthropic_key]", "g"),
        ("sk-[A-Za-z0-9]{20,}", "[REDACTED:openai_key]", "g"),
        (r"[a-zA-Z]+://[^:\n]+:[^@\n]+@[^/ \t\r\n\f\x0b]+", "[REDACTED:connection_string]", "g"),
        (rf"""(password|passwd|pwd|secret){space}*[:=]{space}*[''"][^''"\n]{{4,}}[''"]""", r"\1=[REDACTED:password]", "gi"),
    ):
        of = f"regexp_replace({of}, '{pattern}', '{to}', '{how}')"
    return of


SIG = "skill_name, session_id, invocation_id"
GRP = "agent, event_count, session_count, project_count"


def _json(name: str) -> str:
    return f"json_extract_string(value, '$.{name}')"


def _base(f: Fixtures):
    return canary.canary_baseline(f.canary, f.evidence, f.sessions)


def _summary(f: Fixtures):
    made = canary.create_canary(f.canary, _base(f))
    return canary.canary_summary(made, canary.canary_samples(f.canary, f.evidence, f.sessions))


def _scores(f: Fixtures, as_of: str = AS_OF, days: int = 30):
    return skills.skill_scores(f.evidence, f.skill_signals, f.goals, as_of, days)


def _pend(f: Fixtures):
    return skills.pending_evidence(f.evidence, f.skill_signals, "bead_close")


def _now(f: Fixtures):
    return audit.snapshot_as_of(f.history, AS_OF, 0)


def _old(f: Fixtures):
    return audit.snapshot_as_of(f.history, AS_OF, 10)


def _scs(f: Fixtures):
    return canary.skill_canary_samples(f.skill_mods, f.skill_signals, skills.skill_signal_means(f.skill_signals, AS_OF))


def _upserted_goals(f: Fixtures):
    columns = ["skill_name", "speed", "precision", "completeness", "classified_from", "ts"]
    old = f.goals.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select(*columns)
    ts = F.when(F.length("text") % 2 == 0, "2024-01-31 00:00:00").otherwise("2023-12-01 00:00:00").cast("timestamp_ntz")
    new = f.skill_docs.select(F.regexp_replace("skill_name", "doc", "skill").alias("skill_name"), T.goal_bucket(F.col("text")).alias("g"), ts.alias("ts")).select("skill_name", "g.speed", "g.precision", "g.completeness", F.col("g.bucket").alias("classified_from"), "ts")
    table = VersionedTable(old.sparkSession, shared_folder(old.sparkSession, "goals"))
    table.put(old, 0)
    tables.upsert_into(table, new, ["skill_name"], "ts")
    return table.read()


def _folder(f: Fixtures, name: str) -> str:
    return shared_folder(f.evidence.sparkSession, name)


def _scanned_items(f: Fixtures):
    """Items as JSON lines in a folder a project, some cut off, read again."""
    spark, at = f.evidence.sparkSession, _folder(f, "items")
    line = F.to_json(F.struct("id", "status", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_at"), F.date_format("closed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("closed_at")))
    f.work_items.select("project", F.when(F.substring("id", -1, 1) == "7", F.substring(line, 1, 20)).otherwise(line).alias("value")).write.partitionBy("project").text(at)
    good = logs.read_work_items(spark, at).groupBy("project", "status").agg(F.count("*").alias("items"), F.max("started_at").alias("last"))
    bad = logs.bad_work_items(spark, at).select(F.regexp_extract("path", "project=([^/]+)", 1).alias("project")).groupBy("project").agg(F.lit("bad line").alias("status"), F.count("*").alias("items"), F.lit(None).cast("timestamp_ntz").alias("last"))
    return good.unionByName(bad)


def _scanned_fleet(f: Fixtures):
    spark, at = f.evidence.sparkSession, _folder(f, "fleet")
    f.evidence.select("id", "source", F.col("project").alias("p"), F.lit("data").alias("a"), F.lit("db").alias("b")).write.partitionBy("p", "a", "b").parquet(at)
    return logs.read_fleet(spark, f"{at}/*/*/*").groupBy(F.regexp_replace("project", "^p=", "").alias("project")).agg(F.count("*").alias("events"), F.countDistinct("source").alias("sources"))


def _scanned_overrides(f: Fixtures):
    spark, out = f.evidence.sparkSession, None
    for version in (1, 2):  # a document of a later version gives nothing
        at = _folder(f, "overrides")
        entries = F.collect_list(F.struct("agent", "action", "confidence", F.lit("why").alias("reason")))
        f.overrides.agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("overrides"))).alias("value")).write.text(at)
        read = logs.read_overrides(spark, at).withColumn("version", F.lit(version))
        out = read if out is None else out.unionByName(read)
    return out


def _swept(f: Fixtures):
    """The last document of each agent against what had been recorded in the middle of the month."""
    body = F.concat(F.lit('{"status":"'), "status", F.lit('"'), F.when(F.col("findings_count") > 0, F.concat(F.lit(',"findings_count":'), F.col("findings_count").cast("string"))).otherwise(""), F.when(F.col("id") % 2 == 0, F.concat(F.lit(',"session_id":"'), "session_id", F.lit('"'))).otherwise(""), F.lit("}"))
    docs = f.verdicts.select(F.concat("agent", F.lit("-"), F.date_format("ts", "d")).alias("name"), "ts", "id", body.alias("body"))
    last = lambda df: df.groupBy("name").agg(F.max_by("body", F.struct("ts", "id")).alias("body")).withColumn("content_hash", F.sha2("body", 256))
    return verdicts.verdict_evidence(last(docs), last(docs.where("hour(ts) < 20")), "sweep").select("name", "content_hash", "session_id", "source", "context")


def _closed_sessions(f: Fixtures):
    """The sessions' starts and stops as a stream of files, some of them twice."""
    spark, at = f.sessions.sparkSession, _folder(f, "sessions")
    event = lambda kind, ts: F.struct(F.lit(kind).alias("event"), F.col(ts).cast("timestamp").alias("ts"))
    twice = F.when(F.col("session_id").like("%1-%"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = f.sessions.select("session_id", F.explode(F.array(event(live.START, "start_ts"), event(live.STOP, "end_ts"))).alias("e"), twice.alias("twice"))
    rows.select("session_id", "e.*", F.explode("twice")).drop("col").where("ts is not null").write.parquet(f"{at}/in")
    live.start_session_close(spark.readStream.schema("session_id string, event string, ts timestamp").parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return live.read_sessions(spark, f"{at}/out")


def _watched_canaries(f: Fixtures):
    """Stops of sessions as a stream, the last of them at the time of reference; what became of the canaries."""
    spark, at = f.sessions.sparkSession, _folder(f, "canaries")
    last = f.sessions.limit(1).select(F.lit("none").alias("session_id"), F.lit(AS_OF).cast("timestamp_ntz").alias("start_ts"), F.lit(AS_OF).cast("timestamp_ntz").alias("ts"))
    f.sessions.select("session_id", "start_ts", F.coalesce("end_ts", "start_ts").alias("ts")).unionByName(last).write.parquet(f"{at}/in")
    made = canary.create_canary(f.canary, _base(f))
    canaries.start_canaries(spark.readStream.schema("session_id string, start_ts timestamp_ntz, ts timestamp_ntz").parquet(f"{at}/in"), made, f.evidence, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return BatchTables(spark, f"{at}/out").read("verdicts", canaries.VERDICTS).select("canary_id", "agent", "verdict", "reason", "sample_count")


LOG_COLUMNS = ("invocation_id", "session_id", "skill_name", "ts", "success", "project", "event")

#: key: (operator over the views, expected result)
CATALOG = {
    # patterns
    "classified_patterns": (lambda f: patterns.classified_patterns(f.evidence, AS_OF), "SELECT * FROM pat"),
    # with minima that some groups miss
    "pattern_gaps": (lambda f: patterns.pattern_gaps(f.evidence, AS_OF, Thresholds(min_sessions=30, min_projects=2, min_events=60)), """SELECT source, event, override_reason, event_count, session_count, project_count, greatest(60 - event_count, 0) AS missing_events, greatest(30 - session_count, 0) AS missing_sessions, greatest(2 - project_count, 0) AS missing_projects
        FROM grp WHERE CAST(session_count >= 30 AS INT) + CAST(project_count >= 2 AS INT) + CAST(event_count >= 60 AS INT) IN (1, 2)"""),
    "agent_wrong_pct": (lambda f: patterns.agent_wrong_pct(f.evidence, AS_OF), "SELECT * FROM wrongp"),
    "routing_eligible": (lambda f: patterns.routing_eligible(f.evidence, f.blacklist, AS_OF), "SELECT * FROM elig"),
    "routing_candidates": (lambda f: patterns.routing_candidates(f.evidence, f.blacklist, f.overrides, AS_OF), f"SELECT {GRP}, e.wrong_pct FROM pat p JOIN elig e ON e.agent = p.source WHERE classification = 'ready' AND event = 'override' AND override_reason = 'agent_wrong' AND status = 'eligible' AND agent NOT IN (SELECT agent FROM overrides)"),
    "overlay_candidates": (lambda f: patterns.overlay_candidates(f.evidence, f.overrides, AS_OF), """SELECT source AS agent, CAST(sum(event_count) AS BIGINT) AS event_count, max(session_count) AS session_count, max(project_count) AS project_count, CAST(floor(100.0 * sum(CASE WHEN override_reason = 'agent_wrong' THEN event_count ELSE 0 END) / sum(event_count)) AS BIGINT) AS wrong_pct
        FROM pat WHERE event = 'override' AND source LIKE 'fd-%' AND source NOT IN (SELECT agent FROM overrides) GROUP BY 1 HAVING bool_or(classification = 'ready') AND floor(100.0 * sum(CASE WHEN override_reason = 'agent_wrong' THEN event_count ELSE 0 END) / sum(event_count)) BETWEEN 40 AND 79"""),
    "override_confidence": (lambda f: patterns.override_confidence(f.evidence), "SELECT agent, total, wrong, CASE WHEN total > 0 THEN round(wrong * 1.0 / total, 6) ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT agent, count(*) FILTER (event IN ('override', 'disagreement_override')) AS total, count(*) FILTER (event IN ('override', 'disagreement_override') AND override_reason IN ('agent_wrong', 'severity_miscalibrated')) AS wrong FROM nev WHERE source_kind = 'agent' GROUP BY 1)"),
    "blacklist_anti": (lambda f: patterns.blacklist_anti(patterns.classified_patterns(f.evidence, AS_OF), f.blacklist), "SELECT * FROM pat WHERE source NOT IN (SELECT pattern_key FROM blacklist)"),
    "override_anti": (lambda f: patterns.override_anti(patterns.agent_wrong_pct(f.evidence, AS_OF), f.overrides), "SELECT * FROM wrongp WHERE agent NOT IN (SELECT agent FROM overrides)"),
    "same_session_proposals": (lambda f: patterns.same_session_proposals(f.evidence.withColumn("event", F.when(F.col("id") % 7 == 0, "propose").otherwise(F.col("event"))), f.evidence.where("id % 5 = 0").select("session_id", F.col("source").alias("agent")).distinct()),
        "SELECT a.*, p.agent IS NOT NULL AS blocked FROM (SELECT DISTINCT session_id, source AS agent FROM evidence WHERE id % 5 = 0) a LEFT JOIN (SELECT DISTINCT session_id, source AS agent FROM evidence WHERE id % 7 = 0) p USING (session_id, agent)"),
    # filters
    "quarantine_filter": (lambda f: filters.quarantine_filter(f.evidence, AS_OF).select("id", "event"), "SELECT id, event FROM vis"),
    "source_kind_filter": (lambda f: filters.source_kind_filter(f.evidence, "tool").select("id", "source"), "SELECT id, source FROM evidence WHERE source_kind = 'tool'"),
    "window_filter": (lambda f: filters.window_filter(f.evidence, AS_OF, 14).select("id", "ts"), f"SELECT id, ts FROM evidence WHERE {A14}"),
    "hook_allowlist": (lambda f: filters.hook_allowlist(f.evidence, kinds=("agent", "skill")).groupBy("source_kind").count(), "SELECT source_kind, count(*) AS count FROM evidence WHERE source_kind IN ('agent', 'skill') GROUP BY 1"),
    "valid_names": (lambda f: f.evidence.select("source").distinct().select("source", T.is_agent_name(F.col("source")).alias("agent"), T.is_tool_name(F.col("source")).alias("tool"), T.is_skill_name(F.col("source")).alias("skill")), "SELECT DISTINCT source, regexp_matches(source, '^fd-[a-z][a-z0-9-]*$') AS agent, regexp_matches(source, '^[A-Za-z][A-Za-z0-9_-]*$') AS tool, regexp_matches(source, '^[a-z][a-z0-9-]*(:[a-z][a-z0-9-]*)?$') AS skill FROM evidence"),
    "cross_cutting_flag": (lambda f: f.ev0.select("agent").distinct().withColumn("flag", T.is_cross_cutting(F.col("agent"))), "SELECT DISTINCT agent, agent IN ('fd-architecture', 'fd-quality', 'fd-safety', 'fd-correctness') AS flag FROM ev0"),
    "dark_sessions": (lambda f: filters.dark_sessions(f.sessions, AS_OF), "SELECT session_id, start_ts FROM sessions WHERE end_ts IS NULL AND start_ts < TIMESTAMP '2024-01-30 00:00:00'"),
    "session_source": (lambda f: filters.session_source(f.sessions.select("session_id", (F.col("tokens") % 5 == 0).alias("marker"), F.when(F.col("tokens") % 3 == 0, "tune canary").alias("title"), F.array(F.when(F.col("tokens") % 7 == 0, "a/overlay.md").otherwise("b.py")).alias("changed_files")), own="(?i)canary|overlay").select("session_id", "source"), "SELECT session_id, CASE WHEN tokens % 5 = 0 THEN 'bootstrap' WHEN tokens % 3 = 0 OR tokens % 7 = 0 THEN 'self-building' ELSE 'normal' END AS source FROM sessions"),
    # reports
    "evidence_overview": (lambda f: reports.evidence_overview(f.evidence), "SELECT source, count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, max(ts) AS last_seen FROM evidence GROUP BY 1"),
    "event_breakdown": (lambda f: reports.event_breakdown(f.evidence), "SELECT source, event, coalesce(override_reason, '') AS reason, count(*) AS count FROM evidence GROUP BY 1, 2, 3"),
    "weekly_timeline": (lambda f: reports.weekly_timeline(f.evidence, AS_OF), "SELECT source, strftime(ts, '%Y-W%W') AS week, count(*) AS count, repeat('█', least(count(*), 40)) AS bar FROM evidence WHERE ts > TIMESTAMP '2023-12-06 00:00:00' GROUP BY 1, 2"),
    "evidence_health": (lambda f: reports.evidence_health(f.evidence, f.sessions, AS_OF), "SELECT count(*) AS events, count(*) FILTER (event = 'override') AS overrides, count(*) FILTER (event = 'agent_dispatch') AS dispatches, count(*) FILTER (ts > TIMESTAMP '2024-01-24 00:00:00') AS recent, round(100.0 * count(*) FILTER (event = 'override') / count(*), 6) AS override_pct, (SELECT count(*) FROM sessions WHERE end_ts IS NULL AND start_ts < TIMESTAMP '2024-01-30 00:00:00') AS dark FROM evidence"),
    "status_counts": (lambda f: reports.status_counts(f.evidence, f.sessions, f.canary, f.modifications), """SELECT 'sessions' AS name, count(*) AS value FROM sessions UNION ALL SELECT 'open_sessions', count(*) FROM sessions WHERE end_ts IS NULL UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'overrides', count(*) FROM evidence WHERE event = 'override' UNION ALL SELECT 'canaries', count(*) FROM canary
        UNION ALL SELECT 'active_canaries', count(*) FROM canary WHERE status = 'active' UNION ALL SELECT 'modifications', count(*) FROM modifications UNION ALL SELECT 'applied', count(*) FROM modifications WHERE status = 'applied' UNION ALL SELECT 'reverted', count(*) FROM modifications WHERE status = 'reverted'"""),
    "health_channels": (lambda f: reports.health_channels(f.evidence, f.sessions, AS_OF), """SELECT *, CASE WHEN last_7d > 0 THEN 'OK' WHEN total > 0 THEN 'WARN' ELSE 'INACTIVE' END AS status FROM (SELECT 'dispatch' AS channel, count(*) FILTER (ts > TIMESTAMP '2024-01-24') AS last_7d, count(*) AS total, max(ts) AS last_event FROM evidence WHERE event = 'agent_dispatch'
        UNION ALL SELECT 'override', count(*) FILTER (ts > TIMESTAMP '2024-01-24'), count(*), max(ts) FROM evidence WHERE event = 'override')
        UNION ALL SELECT 'session', count(*) FILTER (start_ts > TIMESTAMP '2024-01-24'), count(*), max(start_ts), CASE WHEN count(*) FILTER (start_ts > TIMESTAMP '2024-01-24' AND end_ts IS NOT NULL) > 0 THEN 'OK' WHEN count(*) FILTER (start_ts > TIMESTAMP '2024-01-24') > 0 THEN 'WARN' ELSE 'INACTIVE' END FROM sessions"""),
    "signal_coverage": (lambda f: reports.signal_coverage(f.skill_signals, AS_OF), "SELECT signal_kind, count(*) AS rows, count(DISTINCT skill_name) AS skills, max(observed_at) AS last, CASE WHEN max(observed_at) > TIMESTAMP '2024-01-24' THEN 'OK' ELSE 'WARN' END AS status FROM skill_signals GROUP BY 1"),
    "effectiveness_agents": (lambda f: reports.effectiveness(f.evidence, AS_OF), "SELECT agent, d AS dispatches, c AS corrections, s AS sessions, round(100.0 * c / d, 6) AS override_rate FROM eff"),
    "effectiveness_totals": (lambda f: reports.effectiveness_totals(f.evidence, f.overrides, AS_OF), f"""SELECT d AS dispatches, c AS corrections, n AS sessions, (SELECT count(*) FROM overrides WHERE action = 'exclude') AS active_overrides, CASE WHEN d > 0 THEN floor(1000.0 * c / d) / 10 ELSE 0 END::DOUBLE AS override_rate
        FROM (SELECT count(*) FILTER (event = 'agent_dispatch') AS d, count(*) FILTER (event = 'override') AS c, count(DISTINCT session_id) AS n FROM evidence WHERE source LIKE 'fd-%' AND {E30})"""),
    "trend_join": (lambda f: reports.trend_join(f.evidence, AS_OF, 14).drop("dispatches"), "SELECT n.agent, n.rate, p.rate AS prior_rate FROM effn n LEFT JOIN effp p USING (agent)"),
    "effectiveness_trend": (lambda f: reports.effectiveness_trend(f.evidence, AS_OF, 14), "SELECT n.agent, n.rate, p.rate AS prior_rate, round(n.rate - p.rate, 6) AS delta, CASE WHEN p.rate IS NULL THEN 'new' WHEN round(n.rate - p.rate, 6) < -2 THEN 'improving' WHEN round(n.rate - p.rate, 6) > 2 THEN 'declining' ELSE 'stable' END AS trend, CASE WHEN n.rate > 50 THEN 'exclude or tune' WHEN round(n.rate - p.rate, 6) > 10 THEN 'investigate' ELSE 'none' END AS recommendation FROM effn n LEFT JOIN effp p USING (agent)"),
    "effectiveness_summary": (lambda f: reports.effectiveness_summary(f.evidence, AS_OF, 14), f"""SELECT current_rate, prior_rate, CAST(trunc(100 * (current_rate - prior_rate) / nullif(prior_rate, 0)) AS BIGINT) AS change_pct, CASE WHEN trunc(100 * (current_rate - prior_rate) / nullif(prior_rate, 0)) < 0 THEN 'improving' WHEN trunc(100 * (current_rate - prior_rate) / nullif(prior_rate, 0)) > 5 THEN 'declining' ELSE 'stable' END AS label
        FROM (SELECT round(100.0 * count(*) FILTER (event = 'override' AND {A14}) / greatest(count(*) FILTER (event = 'agent_dispatch' AND {A14}), 1), 6) AS current_rate, round(100.0 * count(*) FILTER (event = 'override' AND {P14}) / greatest(count(*) FILTER (event = 'agent_dispatch' AND {P14}), 1), 6) AS prior_rate FROM evidence WHERE source LIKE 'fd-%')"""),
    "cross_project": (lambda f: reports.cross_project(f.evidence, AS_OF), "SELECT * FROM cross_p"),
    "fleet_union": (lambda f: reports.fleet_union([f.evidence.where("project < 'p3'"), f.evidence.where("project >= 'p3'")], AS_OF), f"SELECT agent, count(*) AS events, count(DISTINCT project) AS projects FROM nev WHERE {E30} GROUP BY 1"),
    "global_exclusion": (lambda f: reports.global_exclusion(f.evidence, AS_OF, rate=10), "SELECT agent, round(project_count * 1.0 / (SELECT count(DISTINCT project) FROM disp), 6) AS project_share, override_rate FROM cross_p WHERE project_count * 1.0 / (SELECT count(DISTINCT project) FROM disp) > 0.5 AND override_rate > 10"),
    "correction_reasons": (lambda f: reports.correction_reasons(f.evidence), "SELECT * FROM (SELECT agent, override_reason, count, row_number() OVER (PARTITION BY agent ORDER BY count DESC, override_reason) AS rank, CAST(sum(count) OVER (PARTITION BY agent) AS BIGINT) AS total FROM (SELECT agent, coalesce(override_reason, '') AS override_reason, count(*) AS count FROM nev WHERE event = 'override' GROUP BY 1, 2)) WHERE rank <= 5"),
    "top_agents": (lambda f: reports.top_agents(f.evidence), "SELECT source, count(*) AS events, count(DISTINCT session_id) AS sessions FROM evidence GROUP BY 1 ORDER BY events DESC, source LIMIT 10"),
    "recent_events": (lambda f: reports.recent_events(f.evidence, AS_OF), "SELECT source, rank, ts, concat(CASE WHEN coalesce(quarantine_until, 0) > 1706659200 THEN '[Q] ' ELSE '' END, event) AS event, coalesce(override_reason, '') AS reason, substr(context, 1, 120) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS rank FROM evidence) WHERE rank <= 10"),
    "recent_wrong_contexts": (lambda f: reports.recent_wrong_contexts(f.evidence), "SELECT agent, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, string_agg(context, ',' ORDER BY rank) AS contexts FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, id DESC) AS rank FROM nev WHERE override_reason = 'agent_wrong') WHERE rank <= 10 GROUP BY 1"),
    "tool_patterns": (lambda f: reports.tool_patterns(f.evidence, AS_OF), f"SELECT source, event, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS total, CASE event {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.TOOL_ADVICE.items())} END AS advice FROM vis WHERE source_kind = 'tool' GROUP BY 1, 2"),
    "tool_baseline": (lambda f: reports.tool_baseline(f.evidence, AS_OF).select("source", F.to_json("counts").alias("counts")), "SELECT source, concat('{', string_agg(concat('\"', event, '\":', n), ',' ORDER BY event), '}') AS counts FROM (SELECT source, event, count(*) AS n FROM evidence WHERE source_kind = 'tool' AND ts > TIMESTAMP '2024-01-24' GROUP BY 1, 2) GROUP BY 1"),
    "tool_recurrence": (lambda f: reports.tool_recurrence(f.evidence, f.evidence.where("source_kind = 'tool'").groupBy("source").agg((F.min("ts") + F.expr("interval '10' day")).alias("applied_at"))), "SELECT a.source, a.applied_at, count(*) FILTER (e.ts > a.applied_at) AS recurrences FROM (SELECT source, min(ts) + INTERVAL 10 DAY AS applied_at FROM evidence WHERE source_kind = 'tool' GROUP BY 1) a JOIN evidence e ON e.source = a.source AND e.source_kind = 'tool' GROUP BY 1, 2"),
    "override_summary": (lambda f: reports.override_summary(f.overrides, f.canary), "SELECT count(*) FILTER (action = 'exclude') AS excluded, coalesce(string_agg(agent, ', ' ORDER BY agent) FILTER (action = 'exclude'), '') AS excluded_agents, count(*) FILTER (action = 'propose') AS proposed, coalesce(string_agg(agent, ', ' ORDER BY agent) FILTER (action = 'propose'), '') AS proposed_agents, (SELECT count(*) FROM canary WHERE status = 'alert') AS alerts, (SELECT coalesce(string_agg(DISTINCT group_id, ', ' ORDER BY group_id), '') FROM canary WHERE status = 'alert') AS alert_agents FROM overrides"),
    # agents
    "join_session_source": (lambda f: agents.join_session_source(f.evidence, f.sessions.where("session_id not like '%5-%'")).select("id", "session_id", "session_source"), "SELECT id, e.session_id, coalesce(s.source, 'bootstrap') AS session_source FROM evidence e LEFT JOIN (SELECT * FROM sessions WHERE session_id NOT LIKE '%5-%') s ON s.session_id = e.session_id"),
    "agent_scores": (lambda f: agents.agent_scores(f.evidence, f.sessions), "SELECT * EXCLUDE (phase) FROM cal WHERE phase IS NULL"),
    "agent_phase_scores": (lambda f: agents.agent_phase_scores(f.evidence, f.sessions), "SELECT * FROM cal WHERE phase IS NOT NULL"),
    "agent_scores_fallback": (lambda f: agents.agent_scores_fallback(f.evidence, f.sessions), "SELECT agent, coalesce(max(recommended_model) FILTER (phase IS NULL), arg_min(recommended_model, phase)) AS recommended_model, coalesce(max(weighted_hit_rate) FILTER (phase IS NULL), arg_min(weighted_hit_rate, phase)) AS weighted_hit_rate, NOT bool_or(phase IS NULL) AS from_phase FROM cal GROUP BY 1"),
    "delegation_overall": (lambda f: agents.delegation_overall(f.ctx), "SELECT count(*) AS total, round(count(*) FILTER (verdict IN ('pass', 'CLEAN')) * 1.0 / count(*), 6) AS pass_rate, round(count(*) FILTER (retry) * 1.0 / count(*), 6) AS retry_rate, count(*) >= 3 AS sufficient FROM deleg"),
    "delegation_by_category": (lambda f: agents.delegation_by_category(f.ctx), "SELECT category, count(*) AS count, round(count(*) FILTER (verdict IN ('pass', 'CLEAN')) * 1.0 / count(*), 6) AS pass_rate, CAST(floor(sum(coalesce(dur, 0)) / count(*) + 0.5) AS BIGINT) AS avg_duration_s, count(*) FILTER (verdict IN ('pass', 'CLEAN')) * 1.0 / count(*) < 0.7 AS attention FROM deleg GROUP BY 1"),
    "delegation_status": (lambda f: agents.delegation_status(f.ctx), "SELECT category, count(*) AS count, CAST(floor(100.0 * count(*) FILTER (verdict IN ('pass', 'CLEAN')) / count(*) + 0.5) AS BIGINT) AS pass_pct, round(avg(dur), 6) AS avg_duration_s, 100.0 * count(*) FILTER (verdict IN ('pass', 'CLEAN')) / count(*) < 70 AND count(*) >= 3 AS attention FROM deleg GROUP BY 1"),
    "delegation_recent": (lambda f: agents.delegation_recent(f.ctx), "SELECT ts, category, tier, verdict, dur AS duration_s FROM deleg ORDER BY ts DESC, id DESC LIMIT 5"),
    "plan_execution_cells": (lambda f: agents.plan_execution_cells(f.ctx, AS_OF), """SELECT author, executor, validator, count(*) AS n, round(sum(CASE WHEN p THEN w ELSE 0 END) / sum(w), 6) AS weighted_pass_rate, count(*) FILTER (esc) AS escalated, count(*) >= 5 AS sufficient
        FROM (SELECT coalesce(nullif(json_extract_string(context, '$.author_model'), ''), 'unknown') AS author, coalesce(nullif(json_extract_string(context, '$.executor_model'), ''), 'unknown') AS executor, coalesce(nullif(json_extract_string(context, '$.validator_model'), ''), 'unknown') AS validator, json_extract_string(context, '$.pass') = 'true' AS p, CAST(json_extract_string(context, '$.escalation_count') AS INT) > 0 AS esc,
          CASE json_extract_string(context, '$.session_source') WHEN 'bootstrap' THEN 0.5 WHEN 'self-building' THEN 0.7 ELSE 1.0 END::DOUBLE AS w FROM ctx WHERE event = 'plan_execution_outcome' AND coalesce(quarantine_until, 0) <= 1706659200) GROUP BY GROUPING SETS ((author, executor, validator), ())"""),
    "review_phase_calibration": (lambda f: agents.review_phase_calibration(f.ctx, AS_OF), """SELECT phase, CASE WHEN coalesce(complexity, 0) = 0 THEN 3 ELSE complexity END AS complexity, count(*) AS total_reviews, round(count(*) FILTER (p0 > 0) * 1.0 / count(*), 6) AS p0p1_rate, round(avg(coalesce(a, 0)), 6) AS avg_agents, CASE WHEN count(*) FILTER (p0 > 0) * 1.0 / count(*) < 0.05 THEN 'skip' WHEN count(*) FILTER (p0 > 0) * 1.0 / count(*) < 0.15 THEN 'lighten' ELSE 'full' END AS action
        FROM (SELECT json_extract_string(context, '$.phase') AS phase, CAST(json_extract_string(context, '$.complexity') AS BIGINT) AS complexity, CAST(json_extract_string(context, '$.p0') AS INT) AS p0, CAST(json_extract_string(context, '$.agents') AS INT) AS a FROM ctx WHERE event = 'review_phase_outcome' AND coalesce(quarantine_until, 0) <= 1706659200) t GROUP BY t.phase, t.complexity HAVING count(*) >= 3"""),
    "review_ready": (lambda f: agents.review_ready(f.ctx, AS_OF), "SELECT least(count(*) FILTER (p = 'brainstorm'), count(*) FILTER (p = 'strategy'), count(*) FILTER (p = 'plan')) AS count, least(count(*) FILTER (p = 'brainstorm'), count(*) FILTER (p = 'strategy'), count(*) FILTER (p = 'plan')) >= 20 AS ready FROM (SELECT json_extract_string(context, '$.phase') AS p FROM ctx WHERE event = 'review_phase_outcome' AND coalesce(quarantine_until, 0) <= 1706659200)"),
    "decomposition_ready": (lambda f: agents.decomposition_ready(f.ctx, AS_OF), "SELECT count(*) AS count, count(*) >= 30 AS ready FROM ctx WHERE event = 'decomposition_outcome' AND coalesce(quarantine_until, 0) <= 1706659200"),
    # skills
    "pending_evidence": (_pend, "SELECT * FROM pend"),
    "pending_limit": (lambda f: skills.pending_evidence(f.evidence, f.skill_signals, "bead_close", 20), "SELECT * FROM pend ORDER BY ts, invocation_id LIMIT 20"),
    "signal_error": (lambda f: skills.signal_error(_pend(f)), f"SELECT {SIG}, 'error' AS signal_kind, 1.0::DOUBLE AS value, 1.0::DOUBLE AS raw_value, ts AS observed_at, '{{\"default\": true}}' AS metadata FROM pend"),
    "bead_asof": (lambda f: skills.bead_asof(_pend(f), f.work_items), "SELECT * FROM asofj"),
    "bead_tie_gap": (lambda f: _pend(f).join(skills.bead_asof(_pend(f), f.work_items), "invocation_id", "left_anti").select("invocation_id"), "SELECT invocation_id FROM pend WHERE invocation_id NOT IN (SELECT invocation_id FROM asofj)"),
    "signal_bead_close": (lambda f: skills.signal_bead_close(skills.bead_asof(_pend(f), f.work_items)), f"SELECT {SIG}, 'bead_close' AS signal_kind, v AS value, v AS raw_value, ts AS observed_at, bead_id AS metadata FROM (SELECT *, CASE WHEN status IN ('closed', 'done') AND (closed_at IS NULL OR closed_at <= ts + INTERVAL 7 DAY) THEN 1.0 WHEN status = 'deferred' AND coalesce(closed_at, updated_at) <= ts + INTERVAL 7 DAY THEN 0.0 END::DOUBLE AS v FROM asofj) WHERE v IS NOT NULL"),
    "no_redirect": (lambda f: skills.no_redirect(f.called, f.turns), """SELECT c.skill_name, c.session_id, c.invocation_id, 'no_redirect' AS signal_kind, CASE WHEN n IS NULL THEN 1.0 ELSE round(1 - least(1.0, m * 1.0 / n), 6) END::DOUBLE AS value, m::DOUBLE AS raw_value, c.ts AS observed_at, CAST(n AS VARCHAR) AS metadata
        FROM called c LEFT JOIN (SELECT session_id, count(*) AS n, sum(m) AS m FROM (SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY line) AS r, CAST(regexp_matches(text, '(?i)/clear\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bwait\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bstop\\b') AS INT)
          + CAST(regexp_matches(text, '(?i)\\bactually\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\binstead\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bredo\\b') AS INT) + CAST(regexp_matches(text, '(?i)that''s wrong') AS INT)
          + CAST(regexp_matches(text, '(?i)\\bdon''t\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bundo\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bno,') AS INT) AS m FROM turns WHERE type = 'user' AND line > 0 AND text IS NOT NULL) WHERE r <= 5 GROUP BY 1) s ON s.session_id = c.session_id"""),
    "session_token_cost": (lambda f: skills.session_token_cost(f.turns), "SELECT session_id, CAST(sum(input_tokens + coalesce(cache_creation_tokens, 0)) AS BIGINT) AS tokens FROM turns WHERE type = 'assistant' GROUP BY 1"),
    "token_cohort": (lambda f: skills.token_cohort(f.evidence, f.sessions), "SELECT * FROM coh"),
    "signal_tokens": (lambda f: skills.signal_tokens(_pend(f), f.evidence, f.sessions), """SELECT p.skill_name, p.session_id, p.invocation_id, 'tokens' AS signal_kind, round(1 - 1 / (1 + exp(-(s.tokens - m) / CASE WHEN d = 0 THEN 1 ELSE d END)), 6) AS value, s.tokens::DOUBLE AS raw_value, p.ts AS observed_at, CAST(n AS VARCHAR) AS metadata FROM pend p
        JOIN (SELECT skill_name, session_id, count(*) AS n, quantile_cont(other_tokens, 0.5) AS m, stddev_pop(other_tokens) AS d FROM coh GROUP BY 1, 2 HAVING count(*) >= 3) c USING (skill_name, session_id) JOIN sessions s ON s.session_id = p.session_id"""),
    "dark_skills": (lambda f: skills.dark_skills(f.evidence, f.skill_signals.where("skill_name <> 'plug:skill5'")), "SELECT count(DISTINCT skill_name) AS dark_skills FROM inv WHERE skill_name NOT IN (SELECT skill_name FROM skill_signals WHERE skill_name <> 'plug:skill5')"),
    "goals_coverage": (lambda f: skills.goals_coverage(f.evidence, f.goals), "SELECT count(*) AS classified, count(*) FILTER (classified_from = 'observed') AS observed, (SELECT count(DISTINCT skill_name) FROM inv) AS seen FROM goals"),
    "skill_signal_means": (lambda f: skills.skill_signal_means(f.skill_signals, AS_OF), "SELECT * FROM smean"),
    "skill_invocations": (lambda f: skills.skill_invocations(f.skill_signals, AS_OF), f"SELECT skill_name, count(DISTINCT invocation_id) AS invocations FROM skill_signals WHERE {O30} GROUP BY 1"),
    "qualifying_skills": (lambda f: skills.qualifying_skills(f.evidence, AS_OF), "SELECT * FROM qual"),
    "recency_means": (lambda f: skills.recency_means(f.skill_signals, AS_OF).withColumn("value", F.round("value", 6)), "SELECT skill_name, signal_kind, round(value, 6) AS value FROM means"),
    "signal_info_weights": (lambda f: skills.signal_info_weights(skills.recency_means(f.skill_signals, AS_OF)).select("signal_kind", F.round("sigma", 6).alias("sigma"), F.round("info_weight", 6).alias("info_weight")), "SELECT signal_kind, round(sigma, 6) AS sigma, round(iw, 6) AS info_weight FROM info"),
    "skill_goal_values": (lambda f: skills.skill_goal_values(skills.recency_means(f.skill_signals, AS_OF)).withColumn("value", F.round("value", 6)), "SELECT skill, goal, round(value, 6) AS value FROM gv"),
    "skill_scores": (_scores, "SELECT * FROM sc"),
    "skill_leaderboard": (lambda f: skills.skill_leaderboard(_scores(f), 5).select("skill", "score"), "SELECT skill, score FROM sc ORDER BY score DESC, skill LIMIT 5"),
    "score_delta": (lambda f: skills.score_delta(_scores(f), skills.skill_scores(f.evidence, f.skill_signals, f.goals, AS_OF, static=True).where("skill <> 'plug:skill2'")), "SELECT a.skill, a.score, b.score AS prior_score, round(a.score - b.score, 6) AS delta FROM sc a LEFT JOIN (SELECT * FROM scs0 WHERE skill <> 'plug:skill2') b USING (skill)"),
    "observed_mix": (lambda f: skills.observed_mix(f.skill_signals.where("skill_name < 'plug:skill6' or observed_at < '2024-01-02'").unionByName(f.skill_signals.where("signal_kind = 'tokens'").withColumn("signal_kind", F.lit("latency")))).select("skill_name", "n", *(F.round(k, 6).alias(k) for k in skills.GOALS)), "SELECT skill_name, count(*) AS n, round(coalesce(sum(value) FILTER (goal = 'speed'), 0) / sum(value) FILTER (goal IS NOT NULL), 6) AS speed, round(coalesce(sum(value) FILTER (goal = 'precision'), 0) / sum(value) FILTER (goal IS NOT NULL), 6) AS precision, round(sum(value) FILTER (goal = 'completeness') / sum(value) FILTER (goal IS NOT NULL), 6) AS completeness FROM (SELECT * FROM skill_signals WHERE skill_name < 'plug:skill6' OR observed_at < TIMESTAMP '2024-01-02' UNION ALL SELECT * REPLACE ('latency' AS signal_kind) FROM skill_signals WHERE signal_kind = 'tokens') LEFT JOIN gw USING (signal_kind) GROUP BY 1 HAVING count(*) >= 20 AND sum(value) FILTER (goal IS NOT NULL) > 0"),
    "refine_goals": (lambda f: skills.refine_goals(f.goals, f.skill_signals), """SELECT o.skill_name, round(CASE WHEN n IS NULL THEN o.speed ELSE 0.3 * m.speed + 0.7 * o.speed END, 6) AS speed, round(CASE WHEN n IS NULL THEN o.precision ELSE 0.3 * m.precision + 0.7 * o.precision END, 6) AS precision, round(CASE WHEN n IS NULL THEN o.completeness ELSE 0.3 * m.completeness + 0.7 * o.completeness END, 6) AS completeness, CASE WHEN n IS NULL THEN classified_from ELSE 'observed' END AS classified_from
        FROM goals o LEFT JOIN (SELECT skill_name, count(*) AS n, sum(value) FILTER (goal = 'speed') / sum(value) AS speed, sum(value) FILTER (goal = 'precision') / sum(value) AS precision, sum(value) FILTER (goal = 'completeness') / sum(value) AS completeness FROM skill_signals JOIN gw USING (signal_kind) GROUP BY 1 HAVING count(*) >= 20) m USING (skill_name)"""),
    "goal_bucket": (lambda f: f.skill_docs.select("skill_name", T.goal_bucket(F.col("text")).alias("g")).select("skill_name", "g.*"), "SELECT skill_name, bucket, speed, precision, completeness FROM goal_of"),
    "reclassify_incremental": (lambda f: skills.reclassify_incremental(f.skill_docs, f.skill_docs.where("length(text) % 2 = 0").select("skill_name", F.sha2("text", 256).alias("skill_md_hash"))), "SELECT skill_name, speed, precision, completeness, sha256(text) AS doc_hash, bucket AS classified_from FROM goal_of WHERE length(text) % 2 <> 0"),
    "select_skill_action": (lambda f: skills.select_skill_action(f.skill_signals, AS_OF), f"""SELECT skill_name, invocations, round(greatest(e, r, t), 6) AS deficit, CASE WHEN greatest(e, r, t) >= 0.2 THEN CASE WHEN e >= r AND e >= t THEN 'skill_md_body_rewrite' WHEN r >= t THEN 'tighten_description' ELSE 'when_to_use_add' END WHEN invocations < 10 THEN 'availability' ELSE 'tighten_description' END AS action
        FROM (SELECT i.skill_name, i.invocations, 1 - coalesce(max(mean) FILTER (signal_kind = 'error'), 1) AS e, 1 - coalesce(max(mean) FILTER (signal_kind = 'no_redirect'), 1) AS r, 1 - coalesce(max(mean) FILTER (signal_kind = 'tokens'), 1) AS t FROM (SELECT skill_name, count(DISTINCT invocation_id) AS invocations FROM skill_signals WHERE {O30} GROUP BY 1) i LEFT JOIN smean USING (skill_name) GROUP BY 1, 2)"""),
    # canaries
    "join_agent_sessions": (lambda f: canary.join_agent_sessions(f.sessions, f.evidence, "fd-safety").select("session_id", "start_ts"), "SELECT session_id, start_ts FROM sessions WHERE session_id IN (SELECT session_id FROM nev WHERE agent = 'fd-safety')"),
    "last_n_sessions": (lambda f: canary.last_n_sessions(f.canary, f.evidence, f.sessions).select("canary_id", "session_id", "rank"), "SELECT canary_id, session_id, rank FROM lastn"),
    "canary_baseline": (_base, "SELECT * FROM basel"),
    "create_canary": (lambda f: canary.create_canary(f.canary, _base(f)).select("id", "window_expires_at", "cohort_key", "baseline_override_rate"), "SELECT id, applied_at + INTERVAL 14 DAY AS window_expires_at, concat(group_id, ':*') AS cohort_key, b.override_rate AS baseline_override_rate FROM canary LEFT JOIN basel b ON b.canary_id = id"),
    "canary_samples": (lambda f: canary.canary_samples(f.canary, f.evidence, f.sessions), "SELECT * FROM samp"),
    "canary_summary": (lambda f: _summary(f).select("id", "sample_count", "avg_override_rate", "avg_fp_rate", "avg_finding_density"), "SELECT id, sample_count, avg_override_rate, avg_fp_rate, avg_finding_density FROM summ"),
    "canary_ready": (lambda f: canary.canary_ready(_summary(f), AS_OF).select("id"), "SELECT id FROM summ WHERE status = 'active' AND (sample_count >= window_uses OR exp <= TIMESTAMP '2024-01-31')"),
    "canary_verdicts": (lambda f: canary.canary_verdicts(_summary(f), AS_OF), """SELECT canary_id, agent, verdict, CASE WHEN verdict = 'alert' THEN concat_ws('; ', CASE WHEN x THEN 'override_rate' END, CASE WHEN y THEN 'fp_rate' END, CASE WHEN z THEN 'finding_density' END) ELSE '' END AS reason, sample_count, avg_override_rate, avg_fp_rate, avg_finding_density
        FROM (SELECT *, id AS canary_id, group_id AS agent, CASE WHEN status <> 'active' THEN status WHEN bo IS NULL THEN 'monitoring' WHEN NOT (sample_count >= window_uses OR exp <= TIMESTAMP '2024-01-31') THEN 'monitoring' WHEN sample_count = 0 THEN 'expired_unused' WHEN x OR y OR z THEN 'alert' ELSE 'passed' END AS verdict FROM bad)"""),
    "canary_overlap": (lambda f: canary.canary_overlap(f.canary, f.ev0.select("agent").distinct()), "SELECT DISTINCT agent, CASE WHEN agent IN (SELECT group_id FROM canary WHERE status = 'active') THEN 'BLOCK' WHEN (SELECT count(*) FROM canary WHERE status = 'active') > 0 THEN 'WARN' ELSE 'OK' END AS decision, CASE WHEN agent IN (SELECT group_id FROM canary WHERE status = 'active') THEN '' ELSE coalesce((SELECT string_agg(DISTINCT group_id, ', ' ORDER BY group_id) FROM canary WHERE status = 'active'), '') END AS reason FROM ev0"),
    "skill_canary_samples": (_scs, "SELECT * FROM scs"),
    "skill_canary_progress": (lambda f: canary.skill_canary_progress(_scs(f)), "SELECT skill_name, count(DISTINCT invocation_id) AS samples, round(avg(delta), 6) AS mean_delta FROM scs GROUP BY 1"),
    "skill_canary_verdicts": (lambda f: canary.skill_canary_verdicts(_scs(f)), """SELECT modification_id, invocations, CASE WHEN invocations < 3 THEN 'pending' WHEN d AND b > 0 AND (b - v) / b >= 0.1 THEN 'reverted' ELSE 'ok' END AS verdict FROM (SELECT modification_id, count(DISTINCT invocation_id) AS invocations FROM scs GROUP BY 1)
        JOIN (SELECT modification_id, bool_or(b > 0 AND (b - v) / b >= 0.2) AS d, sum(b) AS b, sum(v) AS v FROM (SELECT modification_id, signal_kind, avg(baseline_value) AS b, avg(canary_value) AS v FROM scs GROUP BY 1, 2) GROUP BY 1) USING (modification_id)"""),
    # safety
    "circuit_breaker": (lambda f: safety.circuit_breaker(f.modifications, LEDGER_AS_OF), "SELECT group_id, count(*) AS reverts FROM lt WHERE status = 'reverted' AND ts > now - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 3"),
    "system_breaker": (lambda f: safety.system_breaker(f.modifications, LEDGER_AS_OF), "SELECT count(*) AS total, count(*) FILTER (r >= 3) AS tripped, CASE WHEN count(*) >= 3 AND 2 * count(*) FILTER (r >= 3) >= count(*) THEN 'tripped' ELSE 'ok' END AS result FROM (SELECT group_id, count(*) FILTER (status = 'reverted') AS r FROM lt WHERE ts > now - INTERVAL 30 DAY GROUP BY 1)"),
    "rate_limit": (lambda f: safety.rate_limit(f.modifications, LEDGER_AS_OF), "SELECT count(*) AS count, count(*) >= 5 AS exceeded FROM lt WHERE status IN ('applied', 'proposed') AND ts > now - INTERVAL 1 DAY"),
    "auto_apply_gate": (lambda f: safety.auto_apply_gate(f.modifications.select(F.col("group_id").alias("agent"), F.when(F.col("id") % 3 == 0, "prompt_tuning").otherwise("routing").alias("mod_type")).distinct(), f.modifications, f.modifications.groupBy(F.col("group_id").alias("agent")).agg(F.count("*").alias("sessions")), LEDGER_AS_OF),
        """SELECT agent, mod_type, CASE WHEN reason = 'ok' THEN 'apply' ELSE 'propose' END AS decision, reason FROM (SELECT r.agent, r.mod_type, CASE WHEN (SELECT count(*) >= 3 AND 2 * count(*) FILTER (r >= 3) >= count(*) FROM (SELECT group_id, count(*) FILTER (status = 'reverted') AS r FROM lt WHERE ts > now - INTERVAL 30 DAY GROUP BY 1)) THEN 'system_breaker' WHEN mod_type = 'prompt_tuning' THEN 'prompt_tuning_needs_review'
          WHEN (SELECT count(*) >= 5 FROM lt WHERE status IN ('applied', 'proposed') AND ts > now - INTERVAL 1 DAY) THEN 'rate_limit' WHEN b.group_id IS NOT NULL THEN 'circuit_breaker' WHEN s.n < 15 THEN 'too_few_sessions' ELSE 'ok' END AS reason
          FROM (SELECT DISTINCT group_id AS agent, CASE WHEN id % 3 = 0 THEN 'prompt_tuning' ELSE 'routing' END AS mod_type FROM modifications) r LEFT JOIN (SELECT group_id FROM lt WHERE status = 'reverted' AND ts > now - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 3) b ON b.group_id = r.agent JOIN (SELECT group_id AS agent, count(*) AS n FROM modifications GROUP BY 1) s USING (agent))"""),
    "override_lifecycle": (lambda f: safety.override_lifecycle(f.overrides, f.ev0.select("agent").distinct().select("agent", F.when(F.col("agent") == "fd-game-design", "approve").when(F.col("agent") == "fd-performance", "revert").otherwise("propose").alias("verb"), F.lit(0.9).alias("confidence"), F.lit(AS_OF).cast("timestamp_ntz").alias("approved_at"))),
        """SELECT agent, CASE WHEN agent = 'fd-game-design' THEN 'exclude' WHEN agent = 'fd-performance' THEN NULL ELSE 'propose' END AS action, CASE WHEN agent = 'fd-game-design' THEN 0.9 WHEN agent = 'fd-performance' THEN 0.5 END::DOUBLE AS confidence, CASE WHEN agent = 'fd-game-design' THEN TIMESTAMP '2024-04-30 00:00:00' END AS expires_at,
          CASE WHEN agent = 'fd-game-design' THEN 'approved' WHEN agent = 'fd-performance' THEN 'reverted' ELSE 'proposed' END AS result FROM (SELECT DISTINCT agent FROM ev0)"""),
    "override_merge": (lambda f: safety.override_merge(f.overrides, f.ev0.where("agent in ('fd-safety', 'fd-performance')").select("agent", F.lit("exclude").alias("action"), F.lit(1.0).alias("confidence")).distinct()), "SELECT * FROM overrides WHERE agent NOT IN ('fd-safety', 'fd-performance') UNION ALL SELECT DISTINCT agent, 'exclude', 1.0::DOUBLE FROM ev0 WHERE agent IN ('fd-safety', 'fd-performance')"),
    "latest_state": (lambda f: safety.latest_state(f.modifications, ["group_id"], ["ts", "id"]), "SELECT id, group_id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, id DESC) AS r FROM modifications) WHERE r = 1"),
    "override_status": (lambda f: safety.override_status(f.overrides, f.canary, f.modifications, f.ev0.where("agent <> 'fd-performance'").select("agent")), "SELECT o.agent, o.action, coalesce(c.status, 'none') AS canary_status, o.agent IN (SELECT group_id FROM modifications WHERE status = 'applied') AS consistent, o.agent = 'fd-performance' AS orphan, CASE WHEN o.agent = 'fd-performance' THEN 'remove' WHEN c.status = 'alert' THEN 'revert' WHEN o.action = 'propose' THEN 'approve' ELSE 'none' END AS next_action FROM overrides o LEFT JOIN (SELECT group_id, arg_max(status, id) AS status FROM canary GROUP BY 1) c ON c.group_id = o.agent"),
    "overlay_budget": (lambda f: safety.overlay_budget(f.overlays), "SELECT project, agent, tokens, running_total, tokens <= 500 AND running_total <= 2000 AS included FROM (SELECT *, CAST(sum(CASE WHEN tokens <= 500 THEN tokens ELSE 0 END) OVER (PARTITION BY project ORDER BY agent) AS BIGINT) AS running_total FROM overlays)"),
    "overlay_inventory": (lambda f: safety.overlay_inventory(f.overlays), "SELECT agent, count(*) FILTER (active) AS active, count(*) AS total, CAST(sum(CASE WHEN active THEN tokens ELSE 0 END) AS BIGINT) AS tokens, sum(CASE WHEN active THEN tokens ELSE 0 END) > 400 AS near_budget FROM overlays GROUP BY 1"),
    "list_ledger": (lambda f: safety.list_ledger(f.modifications, status="applied"), "SELECT * FROM modifications WHERE status = 'applied' ORDER BY ts DESC, id DESC LIMIT 25"),
    "promotion_lineage": (lambda f: safety.promotion_lineage(f.modifications.select("id", F.when(F.col("id") % 4 == 0, F.col("id") / 2).cast("long").alias("promoted_from"))), "SELECT a.id, b.id AS origin_id, CASE WHEN b.id IS NULL THEN 0 WHEN b.id % 4 <> 0 THEN 1 ELSE 2 END AS depth FROM modifications a LEFT JOIN modifications b ON b.id = a.id // 2 WHERE a.id % 4 = 0"),
    "prune_retention": (lambda f: safety.prune(f.ctx, "plan_execution_outcome", AS_OF, 14).groupBy("event").count(), f"SELECT event, count(*) AS count FROM ctx WHERE event <> 'plan_execution_outcome' OR {A14} GROUP BY 1"),
    "reset_scope": (lambda f: safety.counts_after_reset({"sessions": f.sessions, "evidence": f.evidence, "canary": f.canary, "modifications": f.modifications}, "evidence"), """SELECT 'sessions' AS name, count(*) AS before, count(*) AS after FROM sessions UNION ALL SELECT 'evidence', count(*), 0 FROM evidence
        UNION ALL SELECT 'canary', count(*), count(*) FROM canary UNION ALL SELECT 'modifications', count(*), count(*) FROM modifications"""),
    # audit
    "snapshot_as_of": (_old, "SELECT * FROM old_h"),
    "rank_agents": (lambda f: audit.rank_agents(_now(f)).select("agent", "rank"), "SELECT agent, row_number() OVER (ORDER BY weighted_hit_rate DESC, agent) AS rank FROM now_h"),
    "shared_agents": (lambda f: audit.shared_agents(_now(f), _old(f)), "SELECT agent FROM now_h INTERSECT SELECT agent FROM old_h"),
    "drift_join": (lambda f: audit.drift_join(_now(f), _old(f)).select("agent", "now_rate", "old_rate"), "SELECT a.agent, a.weighted_hit_rate AS now_rate, b.weighted_hit_rate AS old_rate FROM now_h a JOIN old_h b USING (agent)"),
    "drift_audit": (lambda f: audit.drift_audit(_now(f), _old(f)), "SELECT * FROM dr"),
    "drift_verdict": (lambda f: audit.drift_verdict(_now(f), _old(f)), "SELECT n, correlation, CASE WHEN correlation IS NULL THEN 'BOOTSTRAP' WHEN correlation < 0.7 OR high > 0 THEN 'DRIFT' ELSE 'STABLE' END AS verdict FROM (SELECT count(*) AS n, CASE WHEN count(*) >= 2 THEN round(1 - 6.0 * sum(delta_rank * delta_rank) / (count(*) * (count(*) * count(*) - 1)), 6) END AS correlation, count(*) FILTER (severity = 'high') AS high FROM dr)"),
    "consensus_trend": (lambda f: audit.consensus_trend(f.evidence, f.skill_signals, AS_OF), "SELECT '2024-Q1' AS cycle, round(1 - count(*) FILTER (source_kind = 'agent' AND override_reason <> '') * 1.0 / count(*) FILTER (source_kind = 'agent'), 6) AS agreement_rate, round((SELECT avg(k) FROM (SELECT count(DISTINCT source) AS k FROM evidence GROUP BY session_id)) / count(DISTINCT source), 6) AS output_diversity, round(1 - (SELECT avg(value) FROM skill_signals WHERE signal_kind = 'error'), 6) AS defect_escape_rate, count(*) AS evidence_n FROM evidence"),
    # sources and sinks
    "ingest_audit_log": (lambda f: logs.parse_audit(f.audit_log).select(*LOG_COLUMNS), f"""SELECT substr(sha1(concat_ws('|', {_json('ts')}, {_json('session_id')}, {_json('name')})), 1, 16) AS invocation_id, {_json('session_id')} AS session_id, {_json('name')} AS skill_name, CAST({_json('ts')} AS TIMESTAMP) AS ts, coalesce({_json('exit_code')} = '0', true) AS success, '' AS project, 'skill_invocation' AS event FROM (SELECT * FROM audit_log WHERE json_valid(value)) WHERE {_json('tool')} = 'Skill'"""),
    "ingest_tooltime": (lambda f: logs.parse_tooltime(f.tool_log).select(*LOG_COLUMNS), f"""SELECT substr(sha1(concat_ws('|', {_json('ts')}, regexp_replace({_json('id')}, '-\\d+$', ''), {_json('skill')})), 1, 16) AS invocation_id, regexp_replace({_json('id')}, '-\\d+$', '') AS session_id, {_json('skill')} AS skill_name, CAST({_json('ts')} AS TIMESTAMP) AS ts, {_json('error')} IS NULL AS success, '' AS project, 'skill_invocation' AS event FROM tool_log WHERE {_json('tool')} = 'Skill'"""),
    "ingest_route_candidates": (lambda f: logs.parse_routes(f.route_log).select("invocation_id", "session_id", "skill_name", "ts", "project"), f"""SELECT concat({_json('route_id')}, '#', i, ':', c) AS invocation_id, {_json('route_id')} AS session_id, c AS skill_name, CAST({_json('timestamp')} AS TIMESTAMP) AS ts, string_split({_json('cwd')}, '/')[-1] AS project FROM route_log CROSS JOIN (VALUES (0, 'plug:a'), (1, 'plug:b')) t(i, c)"""),
    # the audit log goes before the tool-time log, which counts where there is no other
    "scan_multi_log": (lambda f: logs.select_source(f.audit_log, f.tool_log).select("skill_name", F.lit("both").alias("have")).unionByName(logs.select_source(None, f.tool_log).select("skill_name", F.lit("tooltime").alias("have"))).groupBy("have", "skill_name").count(),
        f"SELECT 'both' AS have, {_json('name')} AS skill_name, count(*) AS count FROM (SELECT * FROM audit_log WHERE json_valid(value)) WHERE {_json('tool')} = 'Skill' GROUP BY 2 UNION ALL SELECT 'tooltime', {_json('skill')}, count(*) FROM tool_log WHERE {_json('tool')} = 'Skill' GROUP BY 2"),
    "ingest_agent_dispatch": (lambda f: logs.dispatch_events(f.evidence.select("session_id", "ts", F.when(F.col("id") % 3 == 0, "Task").otherwise("Read").alias("tool_name"), F.when(F.col("id") % 2 == 0, F.col("source")).alias("subagent"))), "SELECT session_id, ts, CASE WHEN id % 2 = 0 THEN source ELSE 'unknown' END AS source, 'agent_dispatch' AS event FROM evidence WHERE id % 3 = 0"),
    "ingest_kernel_events": (lambda f: logs.kernel_events(f.bus, 50, 100), "SELECT id, ts, session_id, concat('kernel-', source) AS source, type AS event FROM (SELECT * FROM bus WHERE id > 50 ORDER BY id LIMIT 100) WHERE source <> '' AND type <> ''"),
    "ingest_disagreements": (lambda f: logs.disagreements(f.reviews), "SELECT * FROM disag"),
    "ingest_execution_defects": (lambda f: logs.execution_defects(f.reviews), "SELECT * FROM defects"),
    "ingest_review_router": (lambda f: logs.review_evidence(f.reviews, 100).groupBy("event", "override_reason").count(), "SELECT event, override_reason, count(*) AS count FROM defects WHERE id > 100 GROUP BY 1, 2 UNION ALL SELECT event, override_reason, count(*) FROM disag WHERE id > 100 GROUP BY 1, 2"),
    "stream_cursor_sources": (lambda f: cursor.pages(f.reviews, 100), "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS page FROM reviews WHERE id > 100"),
    "stream_session_close": (_closed_sessions, """SELECT session_id, start_ts, end_ts, end_ts IS NULL AND floor(epoch_us(start_ts) / 1000) + 86400000 < (SELECT floor(max(greatest(epoch_us(start_ts), coalesce(epoch_us(end_ts), 0))) / 1000) FROM sessions) - 3600000 AS dark FROM sessions"""),
    "stream_canary": (_watched_canaries, """SELECT id AS canary_id, group_id AS agent, verdict, CASE WHEN verdict = 'alert' THEN concat_ws('; ', CASE WHEN x THEN 'override_rate' END, CASE WHEN y THEN 'fp_rate' END, CASE WHEN z THEN 'finding_density' END) ELSE '' END AS reason, sample_count
        FROM (SELECT *, CASE WHEN sample_count = 0 THEN 'expired_unused' WHEN x OR y OR z THEN 'alert' ELSE 'passed' END AS verdict FROM bad WHERE status = 'active' AND bo IS NOT NULL AND (sample_count >= window_uses OR exp <= TIMESTAMP '2024-01-31'))"""),
    "ingest_winning_mutations": (lambda f: logs.winning_mutations(f.mutations, 10, 100), "SELECT id, created_at AS ts, session_id, concat('lab:', task_type) AS source, 'winning_mutation' AS event, quality_signal, 'pattern' AS source_kind FROM mutations WHERE is_new_best = 1 AND id > 10 ORDER BY id LIMIT 100"),
    "ingest_verdicts": (_swept, """SELECT l.name, sha256(l.b.body) AS content_hash, l.b.session_id AS session_id, regexp_replace(l.name, '^(hub:review:|hub:)(fd-)', '\\2') AS source, l.b.context AS context
        FROM (SELECT name, arg_max(v, (ts, id)) AS b FROM vdocs v GROUP BY 1) l LEFT JOIN (SELECT name, arg_max(body, (ts, id)) AS body FROM vdocs WHERE hour(ts) < 20 GROUP BY 1) r USING (name) WHERE r.body IS DISTINCT FROM l.b.body"""),
    "verdict_changes": (lambda f: tables.verdict_changes(f.verdicts).select("id", "agent", "content_hash", "changed"), "SELECT id, agent, content_hash, content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY agent ORDER BY ts, id) AS changed FROM verdicts"),
    "ingest_outcome_events": (lambda f: logs.typed_outcomes(f.verdicts.select("session_id", "ts", F.concat(F.lit("e"), F.col("id").cast("string")).alias("epic"), F.col("findings_count").alias("predicted_children"), F.when(F.col("id") % 5 > 0, F.col("findings_count") + 1).alias("actual_children"), F.when(F.col("id") % 3 == 0, F.lit(2)).alias("replan_count")), "decomposition_outcome")
        .unionByName(logs.typed_outcomes(f.verdicts.select("session_id", "ts", F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), F.col("findings_count").alias("agent_count")), "reaction_dispatched"))
        .unionByName(logs.typed_outcomes(f.verdicts.select("session_id", "ts", F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), F.col("findings_count").alias("hearsay_count"), (F.col("id") % 2 == 0).alias("minority_preserved")), "reaction_outcome"))
        .unionByName(logs.typed_outcomes(f.verdicts.select("session_id", "ts", F.col("agent").alias("source"), F.lit("agent_wrong").alias("override_reason"), F.col("status").alias("correction")), "override")),
        """SELECT session_id, ts, 'decomposition' AS source, 'decomposition_outcome' AS event, '' AS override_reason, concat('{"epic":"e', id, '","predicted_children":', findings_count, ',"actual_children":', findings_count + 1, ',"completion_rate":0.0,"replan_count":', CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END, ',"intent_survival":1.0,"complexity":3,"baseline_typical":5}') AS context FROM verdicts WHERE id % 5 > 0
        UNION ALL SELECT session_id, ts, 'reaction', 'reaction_dispatched', '', concat('{"review_id":"r', id, '","input_path":"","agents_dispatched":0,"reactions_produced":0,"reactions_empty":0,"reactions_errors":0,"convergence_before":0.0,"agent_count":', findings_count, ',"fixative_injections":0}') FROM verdicts
        UNION ALL SELECT session_id, ts, 'reaction', 'reaction_outcome', '', concat('{"review_id":"r', id, '","convergence_after":0.0,"sycophancy_flags":"[]","discourse_health":"{}","hearsay_count":', findings_count, ',"independent_count":0,"contested_count":0,"minority_preserved":', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, '}') FROM verdicts
        UNION ALL SELECT session_id, ts, agent, 'override', 'agent_wrong', concat('{"correction":"', status, '","note":""}') FROM verdicts"""),
    "scan_work_items": (_scanned_items, """SELECT project, status, count(*) AS items, max(started_at) AS last FROM work_items WHERE substr(id, -1, 1) <> '7' GROUP BY 1, 2
        UNION ALL SELECT project, 'bad line', count(*), NULL FROM work_items WHERE substr(id, -1, 1) = '7' GROUP BY 1"""),
    "scan_fleet": (_scanned_fleet, "SELECT project, count(*) AS events, count(DISTINCT source) AS sources FROM evidence GROUP BY 1"),
    "scan_overrides": (_scanned_overrides, "SELECT agent, action, confidence, 'why' AS reason, 1 AS version FROM overrides"),
    "distinct_sketches": (lambda f: sketches.against_exact(f.evidence, ["project"]), "SELECT project, count(*) AS events, count(DISTINCT session_id) AS exact, true AS within FROM evidence GROUP BY 1"),
    "session_seq": (lambda f: tables.session_seq(f.evidence.select("id", "session_id", "ts")), "SELECT id, session_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS seq FROM evidence"),
    "append_evidence": (lambda f: tables.prepare_evidence(f.evidence.withColumn("context", F.when(F.col("id") % 9 == 0, "please ignore previous instructions").otherwise(F.col("context"))), None, AS_OF).select("id", "seq", "context", "rejected", "quarantine_until"), "SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS seq, CASE WHEN id % 9 = 0 THEN '' ELSE context END AS context, id % 9 = 0 AS rejected, CAST(1706659200 + 172800 AS BIGINT) AS quarantine_until FROM evidence"),
    "append_signals": (lambda f: tables.new_rows(f.skill_signals, f.skill_signals.where("value > 0.5"), ["invocation_id", "signal_kind"]).select("invocation_id", "signal_kind"), "SELECT invocation_id, signal_kind FROM skill_signals WHERE value <= 0.5"),
    # over files: two versions of the table of goals, the second made of the first and of what documents say now
    "upsert_goals": (_upserted_goals, """SELECT skill_name, speed, precision, completeness, classified_from, ts FROM (SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY ts DESC, new DESC) AS r FROM (
        SELECT skill_name, speed, precision, completeness, classified_from, TIMESTAMP '2024-01-01 00:00:00' AS ts, 0 AS new FROM goals
        UNION ALL SELECT replace(skill_name, 'doc', 'skill'), speed, precision, completeness, bucket, CASE WHEN length(text) % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2023-12-01 00:00:00' END, 1 FROM goal_of)) WHERE r = 1"""),
    "skills_commands_union": (lambda f: logs.first_wins(f.skill_docs.select("skill_name", F.lit(0).alias("kind")).unionByName(f.goals.select("skill_name", F.lit(1).alias("kind"))).unionByName(f.skill_docs.select("skill_name", F.lit(2).alias("kind"))), "skill_name", ["kind"]), "SELECT skill_name, min(kind) AS kind FROM (SELECT skill_name, 0 AS kind FROM skill_docs UNION ALL SELECT skill_name, 1 FROM goals) GROUP BY 1"),
    # scalar functions
    "normalize_agent": (lambda f: f.evidence.select("source", T.normalize_agent(F.col("source")).alias("agent")).distinct(), "SELECT DISTINCT source, agent FROM nev"),
    "redact_secrets": (lambda f: f.secret_text.select("doc_id", T.redact(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("h"), F.regexp_count("t", F.lit("REDACTED")).alias("n")), f"SELECT doc_id, md5(t) AS h, CAST(len(regexp_extract_all(t, 'REDACTED')) AS INT) AS n FROM (SELECT doc_id, {_redacted('text')} AS t FROM secret_text)"),
    "sanitize_text": (lambda f: f.secret_text.select("doc_id", T.sanitize(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("h"), T.rejected(F.col("t")).alias("rejected")), f"SELECT doc_id, md5(t) AS h, regexp_matches(lower(t), '<system>|<instructions>|ignore previous|you are now|disregard|system:') AS rejected FROM (SELECT doc_id, {_redacted(SANE)} AS t FROM secret_text)"),
    "to_iso": (lambda f: f.evidence.select("id", T.to_iso(F.col("ts")).alias("iso")), "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM evidence"),
    "write_calibration": (lambda f: tables.merge_calibration(_scores(f).select("skill", "score"), f.goals.select(F.lit("skills").alias("section"), F.col("skill_name").alias("name"), F.lit(3).alias("schema_version"), F.lit("old").alias("body")).unionByName(f.ev0.select(F.lit("agents").alias("section"), F.col("agent").alias("name"), F.lit(2).alias("schema_version"), F.lit("kept").alias("body")).distinct())).select("section", "name", "schema_version", F.round(F.get_json_object("body", "$.score").cast("double"), 6).alias("score")),
        "SELECT 'skills' AS section, skill AS name, 3 AS schema_version, score FROM sc UNION ALL SELECT DISTINCT 'agents', agent, 3, NULL FROM ev0"),
    "append_trend": (lambda f: tables.append_trend(audit.consensus_trend(f.evidence, f.skill_signals, AS_OF).select("cycle", "evidence_n"), f.modifications.select(T.quarter_label(F.col("ts")).alias("cycle")).groupBy("cycle").agg(F.count("*").alias("evidence_n")).unionByName(f.sessions.select(F.lit("2024-Q1").alias("cycle"), F.lit(0).cast("long").alias("evidence_n")).distinct())),
        "SELECT concat(year(ts), '-Q', quarter(ts)) AS cycle, count(*) AS evidence_n FROM modifications GROUP BY 1 UNION ALL SELECT '2024-Q1', (SELECT count(*) FROM evidence)"),
    "token_estimate": (lambda f: f.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) * 1.3) AS BIGINT) AS tokens FROM documents"),
    "week_label": (lambda f: f.modifications.select("id", T.week_label(F.col("ts")).alias("week")), "SELECT id, strftime(ts, '%Y-W%W') AS week FROM modifications"),
    "quarter_label": (lambda f: f.modifications.select("id", T.quarter_label(F.col("ts")).alias("q")), "SELECT id, concat(year(ts), '-Q', quarter(ts)) AS q FROM modifications"),
    "invocation_hash": (lambda f: f.evidence.select("id", T.invocation_hash(F.col("project"), F.col("session_id"), F.col("source")).alias("h")), "SELECT id, substr(sha1(concat_ws('|', project, session_id, source)), 1, 16) AS h FROM evidence"),
    "doc_hash": (lambda f: f.documents.select("doc_id", T.doc_hash(F.col("text")).alias("h")), "SELECT doc_id, sha256(text) AS h FROM documents"),
    "frontmatter_split": (lambda f: f.documents.select("doc_id", F.concat(F.lit("---\nname: "), "source", F.lit("\n---\n"), "text").alias("t")).select("doc_id", T.frontmatter(F.col("t")).alias("front"), T.body(F.col("t")).alias("body")), "SELECT doc_id, concat('name: ', source) AS front, substr(text, 1, 2048) AS body FROM documents"),
    "workspace_key": (lambda f: f.pages.select("page_id", T.workspace_key(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/home/u/.agent/projects/w"), (F.col("page_id") % 7).cast("string"), F.lit("/s.jsonl"))).otherwise(F.concat(F.lit("/"), "url", F.lit("/")))).alias("k")), "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('w', page_id % 7) ELSE concat('-', replace(trim(url, '/'), '/', '-')) END AS k FROM pages"),
    "sigmoid_goodness": (lambda f: f.sessions.select("session_id", F.round(T.sigmoid_goodness(F.col("tokens"), F.lit(500.0), F.lit(200.0)), 6).alias("v")), "SELECT session_id, round(1 - 1 / (1 + exp(-(tokens - 500.0) / 200.0)), 6) AS v FROM sessions"),
    "ema_blend": (lambda f: f.goals.select("skill_name", F.round(T.ema(F.col("speed"), F.col("precision")), 6).alias("v")), "SELECT skill_name, round(0.3 * precision + 0.7 * speed, 6) AS v FROM goals"),
    "lenient_bool_int": (lambda f: f.ev0.select("event_id", T.lenient_bool(F.element_at(F.array(F.lit("yes"), F.lit("0"), F.lit("TRUE"), F.lit("")), (F.col("k") % 4 + 1).cast("int"))).alias("b"), T.lenient_int(F.col("value").cast("string")).alias("i")), "SELECT event_id, k % 4 IN (0, 2) AS b, CAST(trunc(value) AS BIGINT) AS i FROM ev0"),
}

CATALOG["json_extract"] = (lambda f: f.ctx.select("id", F.get_json_object("context", "$.category").alias("v")), "SELECT id, json_extract_string(context, '$.category') AS v FROM ctx")
CATALOG["sem_in_sessions"] = (lambda f: f.evidence.join(f.sessions.where("source = 'normal'").select("session_id"), "session_id", "left_semi").select("id"), "SELECT id FROM evidence WHERE session_id IN (SELECT session_id FROM sessions WHERE source = 'normal')")
CATALOG["tune_candidates"] = (lambda f: skills.tune_candidates(f.skill_signals, f.goals.where("speed < 0.3"), AS_OF).select("skill_name"), f"""SELECT i.skill_name FROM (SELECT skill_name, count(DISTINCT invocation_id) AS n FROM skill_signals WHERE {O30} GROUP BY 1 HAVING count(DISTINCT invocation_id) >= 10) i
    JOIN (SELECT skill_name, round(max(CASE WHEN signal_kind = 'bead_close' THEN 0 ELSE 1 - mean END), 6) AS d FROM smean GROUP BY 1) s USING (skill_name) WHERE d >= 0.2 AND skill_name NOT IN (SELECT skill_name FROM goals WHERE speed < 0.3)""")


def _query(build):
    def run(spark, sf_dir):
        return build(Fixtures(spark, sf_dir))

    return run


QUERIES = {name: _query(build) for name, (build, _) in CATALOG.items()}
ORACLE_SQL = {name: with_views(sql, PARTS) for name, (_, sql) in CATALOG.items()}
