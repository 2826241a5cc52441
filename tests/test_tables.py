"""Tables by day and bucket, sketches, verdict sweeps and scans over files."""

import os

import pytest
from pyspark.sql import functions as F

from gleanline.operators import sketches
from gleanline.sources import days


def stamps(spark, rows):
    return spark.createDataFrame(rows, "id long, event string, t string").selectExpr("id", "event", "cast(t as timestamp_ntz) ts")


def test_prune_by_day_touches_the_boundary_only(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = [(i, "plan_execution_outcome", f"2024-01-{1 + i // 4:02d} {6 * (i % 4):02d}:00:00") for i in range(80)]
    days.write_by_day(stamps(spark, rows + [(900, "other", "2023-01-01 00:00:00"), (901, "plan_execution_outcome", None)]), path)

    def files():
        return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}

    before = files()
    # the bound is the 8th of January at noon
    assert days.prune_by_day(spark, path, "plan_execution_outcome", "2024-01-18 12:00:00", 10) == {"dropped": 7, "rewritten": 1}
    after = files()
    same = {f for f in before if before[f] == after.get(f)}
    assert all("day=2024-01-0" in f and f.split("day=")[1][:10] <= "2024-01-08" for f in set(before) - same) and len({f.split("/")[1] for f in set(after) - same}) == 1
    kept = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert kept == [*range(31, 80), 900, 901]
    assert days.prune_by_day(spark, path, "plan_execution_outcome", "2024-01-18 12:00:00", 10) == {"dropped": 0, "rewritten": 0}
    assert days.prune_by_day(spark, path, "absent", "2024-01-18 12:00:00", 10) == {"dropped": 0, "rewritten": 0}


def test_bucketed_append(spark, tmp_path):
    path, name = str(tmp_path / "t"), f"bucketed_{os.getpid()}"
    schema = "id string, event string, ts TIMESTAMP_NTZ"
    t = days.BucketedTable(spark, name, path, schema, "id", buckets=4)
    some = lambda ids, day: spark.createDataFrame([(f"k{i}", "x", f"2024-01-{day:02d} 10:00:00") for i in ids], "id string, event string, t string").selectExpr("id", "event", "cast(t as timestamp_ntz) ts")
    t.append(some(range(20), 1))
    t.append(some([*range(100, 130), 100], 2))
    t.append(some(range(10, 40), 1))  # ten of them are there
    assert t.read().count() == 70 and t.read().select("id").distinct().count() == 70
    spark.sql(f"DROP TABLE {name}")  # a new session: the files are found
    t = days.BucketedTable(spark, name, path, schema, "id", buckets=4)
    t.append(some(range(45), 1))
    assert t.read().count() == 75
    # the target is neither shuffled nor read beyond the day
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = t.fresh(some(range(60), 1))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert fresh.count() == 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("FileScan") :]
    target = plan[plan.rindex("Sort", 0, plan.index("Bucketed: true")) :] if "Bucketed: true" in plan else ""
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan and "day" in scan and "2024-01-01" in plan
    assert "Exchange" not in target
    spark.sql(f"DROP TABLE {name}")


def test_sketches_merge_in_any_grouping(spark):
    rows = spark.range(40_000).selectExpr("concat('p', id % 3) project", "concat('a', id % 5) source", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 9) ts", "concat('s', id % 7001) session_id")
    s = sketches.daily_sketches(rows)
    for keys in (["project"], ["source"], ["day"], ["project", "source"]):
        exact = {tuple(r[k] for k in keys): r["n"] for r in rows.withColumn("day", F.to_date("ts")).groupBy(*keys).agg(F.countDistinct("session_id").alias("n")).collect()}
        for r in sketches.merged(s, keys).collect():
            n = exact[tuple(r[k] for k in keys)]
            assert abs(r["estimate"] - n) <= 2 * sketches.error() * n
    assert sketches.merged(s, []).first()["events"] == 40_000
    assert sketches.against_exact(rows, ["project"]).where("not within").count() == 0
    assert sketches.merged(sketches.daily_sketches(rows.limit(0)), ["project"]).count() == 0


@pytest.mark.parametrize("lg_k", [10, 14])
def test_stated_error_shrinks(lg_k):
    assert sketches.error(lg_k) == pytest.approx(2.08 / 2 ** (lg_k / 2))


def test_verdicts_are_swept_once_for_each_content(spark, tmp_path):
    import json

    from gleanline.sources import verdicts
    from gleanline.sources.versions import BatchTables

    at, root = tmp_path / "v", str(tmp_path / "out")
    at.mkdir()

    def put(name, **doc):
        (at / f"{name}.json").write_text(json.dumps(doc))

    def run(session="sweep"):
        n = verdicts.sweep(spark, str(at), root, session)
        rows = BatchTables(spark, root).read("evidence", verdicts.EVIDENCE).collect()
        return n, sorted((r["source"], r["session_id"], r["context"]) for r in rows)

    put("fd-a", status="CLEAN", findings_count=2, model="m", phase="plan", session_id="own")
    put("fd-b")
    put("synthesis", status="CLEAN")
    (at / "broken.json").write_text("{no")
    (at / "note.txt").write_text("{}")
    a1 = ("fd-a", "own", '{"status":"CLEAN","findings_count":2,"model_used":"m","phase":"plan"}')
    b1 = ("fd-b", "sweep", '{"status":"UNKNOWN","findings_count":0,"model_used":"unknown"}')
    assert run() == (2, [a1, b1]) and run() == (0, [a1, b1])
    put("fd-b", status="NEEDS_ATTENTION", session_id="")  # the name again, with other content
    b2 = ("fd-b", "later", '{"status":"NEEDS_ATTENTION","findings_count":0,"model_used":"unknown"}')
    assert run("later") == (1, sorted([a1, b1, b2])) and run("later")[0] == 0
    put("fd-b")  # and back: other than what was recorded last
    assert run()[0] == 1
    (at / "broken.json").write_text('{"status":"CLEAN"}')  # not recorded while it was broken
    assert run()[0] == 1


def test_typed_outcomes_have_defaults(spark):
    from gleanline.sources import logs

    d = spark.createDataFrame([("s", "e", "3", 4, None), (None, "e", "1", 1, None), ("s", "e", "x", 1, 2)], "session_id string, epic string, predicted_children string, actual_children int, replan_count int").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = logs.typed_outcomes(d, "decomposition_outcome").collect()
    assert [(r["source"], r["context"]) for r in got] == [("decomposition", '{"epic":"e","predicted_children":3,"actual_children":4,"completion_rate":0.0,"replan_count":0,"intent_survival":1.0,"complexity":3,"baseline_typical":5}')]
    own = logs.typed_outcomes(spark.createDataFrame([("s", None, "stale_finding")], "session_id string, source string, override_reason string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "override").first()
    assert (own["source"], own["override_reason"], own["context"]) == ("unknown", "stale_finding", '{"correction":"","note":""}')


def test_bad_lines_are_kept(spark, tmp_path):
    from gleanline.sources import logs

    folder = tmp_path / "project=p1"
    folder.mkdir()
    (folder / "a.json").write_text('{"id":"1","status":"open","started_at":"2024-01-01T00:00:00"}\n{"id":"2"}\n{broken\n\n{"id":"3","status":"done"}\n')
    good = logs.read_work_items(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["project"]) for r in good) == [("1", "p1"), ("3", "p1")]
    assert sorted(r["line"] for r in logs.bad_work_items(spark, str(tmp_path)).collect()) == ['{"id":"2"}', "{broken"]
