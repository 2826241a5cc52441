"""Sessions as a stream: the first start and the first stop count, and one that is not stopped becomes dark.

Each micro-batch adds once to two tables what it tells of its sessions and how far event time has come; reading folds
them. So a session costs a row of a grouping and no state: it is dark when event time has passed its start by dark_hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanline.sources.versions import BatchTables

START, STOP = "session_start", "session_end"
CHANGE = "session_id string, start_us long, end_us long"
#: Of a micro-batch: what begins at or before late_us is late after it, what began before dark_ms and is not stopped is dark.
CLOCK = "late_us long, dark_ms long"
HOUR_MS = 3_600_000


def session_changes(events: DataFrame, late_us: int | None = None) -> DataFrame:
    """Of a micro-batch (session_id, event, ts): each session's least time of a start and of a stop, whatever came first, without what is late.

    A stop is told without its start too, which may have been told long before.
    """
    us = F.unix_micros("ts")
    own = events if late_us is None else events.where(us > late_us)
    return own.groupBy("session_id").agg(F.min(F.when(F.col("event") == START, us)).alias("start_us"), F.min(F.when(F.col("event") == STOP, us)).alias("end_us"))


def clock(events: DataFrame, late: str, dark_hours: int) -> DataFrame:
    """One row: the greatest time of a micro-batch, late behind it, in whole milliseconds as Spark's watermarks are."""
    ms = F.unix_millis(F.max("ts") - F.expr(f"interval {late}"))
    return events.agg((ms * 1000).alias("late_us"), (ms - dark_hours * HOUR_MS).alias("dark_ms"))


def start_session_close(events: DataFrame, root: str, checkpoint: str, late: str = "1 hour", dark_hours: int = 24, trigger: dict | None = None) -> StreamingQuery:
    """Adds the changes of a stream (session_id, event, ts) of start and stop events to the tables under root, each micro-batch exactly once.

    Repeated events change nothing. Events later than late behind the greatest time of the batches before are dropped, rows
    without session or time too.
    """

    def batch(df: DataFrame, n: int) -> None:
        tables = BatchTables(df.sparkSession, root)
        late_us = tables.read("session_clock", CLOCK).where(F.col("batch") < n).agg(F.max("late_us")).first()[0]
        tables.add(n, {"session_changes": session_changes(df, late_us), "session_clock": clock(df, late, dark_hours)})

    own = events.where("session_id is not null and ts is not null").where(F.col("event").isin(START, STOP)).select("session_id", "event", F.col("ts").cast("timestamp").alias("ts"))
    return own.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, start_ts, end_ts, dark) of the sessions that have a start; one that is stopped is not dark, even if the stop came after it was."""
    tables = BatchTables(spark, root)
    g = tables.read("session_changes", CHANGE).groupBy("session_id").agg(F.min("start_us").alias("s"), F.min("end_us").alias("e")).where("s is not null")
    x = g.crossJoin(F.broadcast(tables.read("session_clock", CLOCK).agg(F.max("dark_ms").alias("dark_ms"))))  # one row
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    dark = F.col("e").isNull() & F.coalesce(F.floor(F.col("s") / 1000) < F.col("dark_ms"), F.lit(False))
    return x.select("session_id", time(F.col("s")).alias("start_ts"), time(F.col("e")).alias("end_ts"), dark.alias("dark"))
