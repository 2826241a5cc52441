"""Streams with state, exactly-once tables and the cursor source: restarts, late and repeated events, replayed batches."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gleanline.sources import logs
from gleanline.sources.versions import BatchTables, VersionedTable, claim
from gleanline.streaming import cursor, ingest, sessions

EVENTS = "session_id string, event string, ts timestamp"


def times(rows):
    return [(s, sessions.START if k == "a" else sessions.STOP, f"2024-01-{d:02d} {h:02d}:00:00") for s, k, d, h in rows]


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes one file of events and drains the stream over all of them."""

    def run(rows, **more):
        if rows:
            spark.createDataFrame(times(rows), "session_id string, event string, ts string").selectExpr("session_id", "event", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        q = sessions.start_session_close(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **more)
        q.awaitTermination()
        return {r["session_id"]: (str(r["start_ts"])[8:13], str(r["end_ts"])[8:13] if r["end_ts"] else None, r["dark"]) for r in sessions.read_sessions(spark, str(tmp_path / "out")).collect()}

    return run


def test_sessions_over_restarts(spark, feed, tmp_path):
    assert feed([("x", "a", 1, 0), ("x", "b", 1, 5), ("y", "a", 1, 1), ("z", "b", 1, 2)]) == {"x": ("01 00", "01 05", False), "y": ("01 01", None, False)}
    # a second start and a second stop change nothing; the stop before its start is met by it; an earlier time counts if it comes within the bound
    got = feed([("x", "a", 1, 6), ("x", "b", 1, 7), ("z", "a", 1, 6), ("w", "a", 1, 6), ("w", "a", 1, 5)])
    assert got == {"x": ("01 00", "01 05", False), "y": ("01 01", None, False), "z": ("01 06", "01 02", False), "w": ("01 05", None, False)}
    # 24 hours of event time later y and w are dark, what was stopped is not
    got = feed([("v", "a", 3, 0)])
    assert {s for s, r in got.items() if r[2]} == {"y", "w"}
    # behind the watermark: dropped; an event of no session: left out
    got = feed([("late", "a", 1, 3), ("v", "b", 3, 1)])
    assert "late" not in got and got["v"] == ("03 00", "03 01", False)
    assert feed([]) == got  # nothing new
    assert BatchTables(spark, str(tmp_path / "out")).last() >= 3


def test_stop_after_dark_closes(feed):
    feed([("s", "a", 1, 0)])
    assert feed([("t", "a", 4, 0)])["s"][2]
    assert feed([("s", "b", 4, 1)], late="1 hour")["s"] == ("01 00", "04 01", False)


def test_sessions_keep_no_state(spark, tmp_path):
    """A session costs a row of a grouping, however many there are; the last millisecond of the bound is not dark yet."""
    end = F.timestamp_millis(F.lit(1_704_067_200_000 + 25 * 3_600_000).cast("long"))
    rows = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(sessions.START).alias("event"), F.timestamp_millis(1_704_067_200_000 + F.col("id") - 1).alias("ts"))
    rows.unionByName(spark.range(1).select(F.lit("s9").alias("session_id"), F.lit(sessions.STOP).alias("event"), end.alias("ts"))).write.parquet(str(tmp_path / "in"))
    q = sessions.start_session_close(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert not any(p["stateOperators"] for p in q.recentProgress)
    got = sessions.read_sessions(spark, str(tmp_path / "out"))
    assert got.count() == 3000 and [r["session_id"] for r in got.where("dark").collect()] == ["s0"]


def test_batch_tables_are_exactly_once(spark, tmp_path):
    t = BatchTables(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "v long")
    assert t.read("a", "v long").count() == 0 and t.last() == -1
    one.write.parquet(str(tmp_path / "t/a/batch=0"))  # a run that died before its mark
    assert t.read("a", "v long").count() == 0
    assert t.add(0, {"a": one.union(one), "b": one}) and not t.add(0, {"a": one.union(one).union(one), "b": one})
    for n in (1, 2, 3):
        assert t.add(n, {"a": one, "b": one})
    assert t.read("a", "v long").count() == 5 and t.read("b", "v long").count() == 4 and t.last() == 3
    assert len(os.listdir(tmp_path / "t/_batches")) <= 3


def test_versions_lose_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    row = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert t.read() is None and t.put(row(1), 0) and not t.put(row(9), 0)
    other = VersionedTable(spark, str(tmp_path / "v"))
    met = []

    def change(now):
        if not met:  # another writer comes between reading and putting
            met.append(1)
            assert other.update(lambda df: df.union(row(2))) == 2
        return now.union(row(3))

    assert t.update(change) == 3 and sorted(r["v"] for r in t.read().collect()) == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):  # a writer that dies leaves the version before
        t.update(lambda df: 1 // 0)
    row(7).write.parquet(str(tmp_path / "v/data-dead"))
    assert t.version() == 3 and t.read().count() == 3 and t.read(1).count() == 1
    assert t.forget(keep=1) == 3 and t.read().count() == 3 and t.version() == 3
    assert claim(spark, str(tmp_path / "c"), "x") and not claim(spark, str(tmp_path / "c"), "y")


def numbered(spark, ids, at, mode="append"):
    rows = spark.createDataFrame([(i, f"s{i % 5}", "phase" if i % 9 else "", "view") for i in ids], "id long, session_id string, source string, type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.repartition(3).write.mode(mode).parquet(at)


def test_cursor_pages_over_a_restart(spark, tmp_path):
    path, root, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    numbered(spark, range(0, 700, 2), path)
    seen = []

    def evidence(df):
        n = df.count()
        seen.append(n)
        if len(seen) == 3 and not died:
            died.append(1)
            raise ValueError("the machine goes")
        return logs.kernel_events(df, -1)

    died = []
    with pytest.raises(StreamingQueryException):
        cursor.drain(spark, path, evidence, root, cp)
    tables = BatchTables(spark, root)
    assert tables.read("cursor", cursor.CURSOR).agg(F.max("cursor")).first()[0] == 398
    assert cursor.drain(spark, path, evidence, root, cp) == 698 and max(seen) == 100
    numbered(spark, range(700, 760), path)
    assert cursor.drain(spark, path, evidence, root, cp) == 759 == cursor.drain(spark, path, evidence, root, cp)
    got = [r["id"] for r in tables.read("evidence", "id long, source string").select("id").collect()]
    want = [i for i in [*range(0, 700, 2), *range(700, 760)] if i % 9]
    assert sorted(got) == want  # none lost, none twice
    marks = tables.read("cursor", cursor.CURSOR).orderBy("batch").collect()
    assert [m["rows"] for m in marks] == [100, 100, 100, 50, 60]
    # the pages as a query
    paged = cursor.pages(spark.read.parquet(path).where("id < 700")).groupBy("page").agg(F.max("id").alias("cursor"), F.count("*").alias("rows")).orderBy("page").collect()
    assert [(p["cursor"], p["rows"]) for p in paged] == [(m["cursor"], m["rows"]) for m in marks[:4]]
    assert cursor.pages(spark.read.parquet(path), after=10_000).count() == 0


def test_dedup_within_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "invocation_id string, ts timestamp"

    def put(rows):
        spark.createDataFrame(rows, "invocation_id string, t string").selectExpr("invocation_id", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(path)

    def run():
        s = ingest.dedup(spark.readStream.schema(schema).parquet(path))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["invocation_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00")])
    assert run() == ["a", "b"]
    put([("a", "2024-01-01 20:00:00"), ("c", "2024-01-01 02:00:00")])  # a repeat in another run, within a day
    assert run() == ["a", "b", "c"]
    put([("d", "2024-01-05 00:00:00")])
    assert run() == ["a", "b", "c", "d"]
    put([("a", "2024-01-05 01:00:00"), ("e", "2024-01-01 00:00:00")])  # its key has been let go; a row behind the watermark is dropped
    assert run() == ["a", "a", "b", "c", "d"]


def test_quarantine_needs_no_state(spark, tmp_path):
    at = str(tmp_path / "e")
    spark.createDataFrame([(1, 0), (2, 1706745600), (3, None)], "id long, quarantine_until long").write.parquet(at)
    assert sorted(r["id"] for r in ingest.read_visible(spark, at, "2024-01-31 00:00:00").collect()) == [1, 3]
    assert ingest.read_visible(spark, at, "2024-02-01 00:00:00").count() == 3


@pytest.fixture()
def watched(spark):
    """Two canaries of one agent with baselines, one of another without, and sessions of which the later ones go wrong."""
    evidence, ended = [], []
    for i in range(40):
        s = f"s{i:02d}"
        ended.append((s, f"2024-01-{1 + i // 2:02d} {12 * (i % 2):02d}:00:00"))
        bad = i >= 24
        for j in range(3 if bad else 4):
            event = "override" if bad and j == 0 else "disagreement_override" if bad and j == 1 else "agent_dispatch"
            evidence.append((10 * i + j, s, "hub:fd-a", event, "agent_wrong" if event != "agent_dispatch" else None))
        if i % 20 == 3:
            evidence.append((10 * i + 9, s, "fd-b", "agent_dispatch", None))
    e = spark.createDataFrame(evidence, "id long, session_id string, source string, event string, override_reason string")
    s = spark.createDataFrame(ended, "session_id string, t string").selectExpr("session_id", "cast(t as timestamp_ntz) start_ts", "cast(t as timestamp_ntz) + interval 1 hour ts")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    c = spark.createDataFrame([(1, "fd-a", 10, "active"), (2, "fd-a", 1000, "active"), (3, "fd-b", 20, "active"), (4, "fd-a", 5, "reverted")], "id long, group_id string, window_uses int, status string").withColumn("applied_at", at("2024-01-13 00:00:00"))
    from gleanline.operators import canary

    return canary.create_canary(c, canary.canary_baseline(c, e, s)), e, s


def test_canaries_as_a_stream(spark, tmp_path, watched):
    from gleanline.operators import canary
    from gleanline.streaming import canaries as live

    made, e, s = watched

    def run(name, cuts, **more):
        path, root = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
        for low, high in zip([0, *cuts], cuts, strict=False):
            s.where(f"session_id >= 's{low:02d}' and session_id < 's{high:02d}'").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(s.schema).parquet(path)
            live.start_canaries(stream, made, e, root, str(tmp_path / f"cp-{name}"), **more).awaitTermination()
        t = BatchTables(spark, root)
        samples = sorted(tuple(r) for r in t.read("samples", live.SAMPLES).drop("batch").collect())
        verdicts = {r["canary_id"]: r["verdict"] for r in t.read("verdicts", live.VERDICTS).collect()}
        return root, samples, verdicts

    # all at once: what the batch operators give
    root, samples, verdicts = run("one", [40])
    want = sorted(tuple(r) for r in canary.canary_samples(made, e, s).select("canary_id", "session_id", *canary.METRICS).collect())
    summary = canary.canary_summary(made, canary.canary_samples(made, e, s))
    batch = {r["canary_id"]: r["verdict"] for r in canary.canary_verdicts(summary, "2024-01-20 13:00:00").collect()}
    assert samples == want and len(samples) == 2 * 16 and verdicts == {1: "alert"} == {i: v for i, v in batch.items() if v not in ("monitoring", "reverted")}
    # session by session over restarts: a canary is judged when its ten uses are there, and sampled no more
    root, samples, verdicts = run("many", [20, 30, 34, 37, 40])
    assert verdicts == {1: "alert"} and sum(i == 1 for i, *_ in samples) == 10 and sum(i == 2 for i, *_ in samples) == 16
    assert {r["id"]: r["status"] for r in live.read_canaries(spark, made, root).collect()} == {1: "alert", 2: "active", 3: "active", 4: "reverted"}
    # a batch that is run again, with the same number, changes nothing
    last = BatchTables(spark, root).last()
    assert not live._batch(s, last, made, e, root, live.DEFAULT)
    assert len(BatchTables(spark, root).read("samples", live.SAMPLES).collect()) == len(samples)
    # time runs out: judged with what is there; the one without baseline stays
    later = s.limit(1).withColumn("session_id", F.lit("none")).withColumn("ts", F.lit("2024-02-20 00:00:00").cast("timestamp_ntz"))
    assert live._batch(later, last + 1, made, e, root, live.DEFAULT)
    got = {r["canary_id"]: (r["verdict"], r["reason"]) for r in BatchTables(spark, root).read("verdicts", live.VERDICTS).collect()}
    assert got == {1: ("alert", "override_rate; fp_rate; finding_density"), 2: ("alert", "override_rate; fp_rate; finding_density")}
