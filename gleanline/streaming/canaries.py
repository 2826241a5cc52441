"""Canaries as a stream: at each stop of a session samples are taken, ready canaries are judged and their state changes.

A micro-batch adds to three tables at once and exactly once (BatchTables): samples, verdicts, and the canaries' new state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanline.config import DEFAULT, Thresholds
from gleanline.operators.canary import METRICS, canary_ready, canary_samples, canary_summary, canary_verdicts
from gleanline.sources.versions import BatchTables

SAMPLES = "canary_id long, session_id string, " + ", ".join(f"{m} double" for m in METRICS)
VERDICTS = "canary_id long, agent string, verdict string, reason string, sample_count long, " + ", ".join(f"avg_{m} double" for m in METRICS) + ", decided_at timestamp_ntz"


def read_canaries(spark: SparkSession, canaries: DataFrame, root: str) -> DataFrame:
    """canaries with the state that the stream has given them: a verdict other than monitoring is final."""
    told = BatchTables(spark, root).read("verdicts", VERDICTS).groupBy(F.col("canary_id").alias("id")).agg(F.min_by("verdict", "batch").alias("told"))
    return canaries.join(told, "id", "left").withColumn("status", F.coalesce("told", "status")).drop("told")


def _batch(stops: DataFrame, n: int, canaries: DataFrame, evidence: DataFrame, root: str, cfg: Thresholds) -> bool:
    spark = stops.sparkSession
    tables = BatchTables(spark, root)
    if n <= tables.last():
        return False
    own = read_canaries(spark, canaries, root)
    ended = stops.groupBy("session_id").agg(F.min("start_ts").alias("start_ts"))
    as_of = stops.agg(F.max("ts").cast("string").alias("t")).first()["t"]
    if as_of is None:
        return False
    before = tables.read("samples", SAMPLES).drop("batch")
    new = canary_samples(own, evidence.join(ended.select("session_id"), "session_id", "left_semi"), ended).join(before.select("canary_id", "session_id"), ["canary_id", "session_id"], "left_anti").persist()
    ready = canary_ready(canary_summary(own, before.unionByName(new)), as_of)
    verdicts = canary_verdicts(ready, as_of, cfg).where("verdict <> 'monitoring'").withColumn("decided_at", F.lit(as_of).cast("timestamp_ntz"))
    columns = [c.split()[0] for c in VERDICTS.split(", ")]
    done = tables.add(n, {"samples": new, "verdicts": verdicts.select(*columns)})
    new.unpersist()
    return done


def start_canaries(stops: DataFrame, canaries: DataFrame, evidence: DataFrame, root: str, checkpoint: str, cfg: Thresholds = DEFAULT, trigger: dict | None = None) -> StreamingQuery:
    """stops: a stream (session_id, start_ts, ts) of sessions that ended at ts. canaries: rows of create_canary.

    A session is sampled once for each canary that is active when it stops, its evidence being there by then. A canary
    with its uses or its time is judged in the batch that brings it there; time is that of the batch's last stop.
    """

    def batch(df: DataFrame, n: int) -> None:
        _batch(df.persist(), n, canaries, evidence, root, cfg)
        df.unpersist()

    return stops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
