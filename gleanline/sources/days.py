"""Evidence in folders by event and day, so that retention drops whole days and an append reads only the days that it touches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.sources.versions import names, remove

#: More days than these are not told one by one: all of the target is read then.
MOST_DAYS = 4000
BUCKETS = 16


def write_by_day(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows in folders event=<event>/day=<date>; a row without time is in the day __HIVE_DEFAULT_PARTITION__."""
    out = df.withColumn("day", F.to_date("ts"))
    out.repartition("event", "day").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event", "day").parquet(path)


def prune_by_day(spark: SparkSession, path: str, event: str, as_of: str, days: int = 180) -> dict[str, int]:
    """Removes rows of the event from days before as_of, by folders: older days are deleted unread, the day of the bound is written anew.

    {dropped, rewritten}: how many folders of each kind. Other events and younger days are not touched.
    """
    bound = datetime.fromisoformat(as_of) - timedelta(days=days)
    own = f"{path.rstrip('/')}/event={event}"
    at = [n for n in names(spark, own) if n.startswith("day=") and n[4:5].isdigit()]
    gone = [n for n in at if n[4:] < bound.date().isoformat()]
    for n in gone:
        remove(spark, f"{own}/{n}")
    edge = f"day={bound.date().isoformat()}"
    rewritten = 0
    if edge in at:
        rows = spark.read.option("basePath", path).parquet(f"{own}/{edge}")
        old = rows.where(F.col("ts") <= F.lit(str(bound)).cast("timestamp_ntz"))
        if not old.isEmpty():
            kept = rows.where((F.col("ts") > F.lit(str(bound)).cast("timestamp_ntz")) | F.col("ts").isNull())
            rewritten = 1
            if kept.isEmpty():
                remove(spark, f"{own}/{edge}")
            else:
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event", "day").parquet(path)
    return {"dropped": len(gone), "rewritten": rewritten}


class BucketedTable:
    """A Parquet table in buckets of a key and folders of days: an append meets the rows of its days only, and these are not shuffled.

    The key must tell the time (an invocation's hash does), so that a repeated row is of the same day. name is the
    table's in the session's catalogue; the files at path are the table, and a new session finds them.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: str, key: str, ts: str = "ts", buckets: int = BUCKETS):
        self.spark, self.name, self.key, self.ts = spark, name, key, ts
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, day DATE) USING parquet PARTITIONED BY (day) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.buckets = buckets
        if names(spark, path):
            spark.catalog.recoverPartitions(name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, df: DataFrame) -> DataFrame:
        """The rows of df that the table does not have, each key once."""
        new = df.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("day", F.to_date(self.ts))
        days = [r["day"] for r in new.select("day").distinct().limit(MOST_DAYS + 1).collect()]
        have = self.read()
        if len(days) <= MOST_DAYS:
            have = have.where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False)))
        return new.join(have.select(self.key), self.key, "left_anti")

    def append(self, df: DataFrame) -> None:
        columns = self.read().columns
        self.fresh(df).select(*columns).repartition(self.buckets, self.key).write.mode("append").format("parquet").partitionBy("day").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)
