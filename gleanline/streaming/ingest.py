"""Structured Streaming twins of the ingest paths: all that is new, once, and then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from gleanline.operators.filters import visible
from gleanline.sources.logs import parse_audit, parse_routes, parse_tooltime
from gleanline.sources.tables import new_rows

PARSERS = {"audit": parse_audit, "tooltime": parse_tooltime, "routes": parse_routes}


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def start_ingest(spark: SparkSession, path: str, fmt: str, target: str, checkpoint: str, since: str | None = None) -> StreamingQuery:
    """Drains a folder of log files into target, a Parquet table.

    A run drops rows at or before the greatest time stored when it began (or before since, a backfill's own bound), and
    invocations that are stored. A batch that is run again therefore adds nothing.
    """

    before = _stored(spark, target)
    top = before.agg(F.max("ts")).first()[0] if since is None and before is not None else None

    def batch(df: DataFrame, _: int) -> None:
        rows = PARSERS[fmt](df)
        have = _stored(spark, target)
        if since is not None:
            rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        elif top is not None:
            rows = rows.where(F.col("ts") > F.lit(str(top)).cast("timestamp_ntz"))
        if have is None:
            rows.dropDuplicates(["invocation_id"]).write.mode("append").parquet(target)
        else:
            new_rows(rows, have, ["invocation_id"]).write.mode("append").parquet(target)

    return spark.readStream.format("text").load(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup(stream: DataFrame, key: str = "invocation_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Repeated events of a stream, dropped while the watermark holds their keys."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def start_cursor_source(stream: DataFrame, to_evidence, target: str, checkpoint: str) -> StreamingQuery:
    """A stream of numbered events through to_evidence(df, after_id), beyond what target has.

    The checkpoint passes a whole batch, so to_evidence must take all of it and not a page.
    """

    def batch(df: DataFrame, _: int) -> None:
        have = _stored(df.sparkSession, target)
        after = have.agg(F.max("id")).first()[0] if have is not None else None
        to_evidence(df, -1 if after is None else after).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_visible(spark: SparkSession, target: str, as_of: str) -> DataFrame:
    """Quarantine needs no state: rows are stored with their time and read when it has come."""
    return spark.read.parquet(target).where(visible(as_of))


def session_bounds(events: DataFrame) -> DataFrame:
    """(session_id, start_ts, end_ts) of start and stop events: the first of each. Batch, or stream in update mode."""
    return events.groupBy("session_id").agg(F.min(F.when(F.col("event") == "session_start", F.col("ts"))).alias("start_ts"), F.min(F.when(F.col("event") == "session_end", F.col("ts"))).alias("end_ts"))
