"""Tables with a growing id as a stream of pages: the offset is the greatest id that was read.

Each micro-batch is admitted the next page of ids, so many at most, however long the backlog. Workers read the page from
the files whose id range meets it; pages, offsets and the checkpoint are Spark's.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from gleanline.sources.versions import BatchTables

#: Ids of a page.
PAGE = 100


def _files(path: str, ids: tuple[int, int | None]):
    """The row groups of a folder of Parquet files whose ids may be in (first, last], by their statistics."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    low, high = ids
    keep = ds.field("id") > low if high is None else (ds.field("id") > low) & (ds.field("id") <= high)
    return ds.dataset(own, filesystem=system, format="parquet"), keep


class _Page(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.page = schema, options["path"], int(options.get("page", PAGE))
        self.after = int(options.get("after", -1))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        """The greatest id of the next page; the same as before if nothing is new."""
        at = self.after if self.at is None else self.at
        data, keep = _files(self.path, (at, None))
        least: list[int] = []  # of the new ids the page's, as a heap of their negatives
        for b in data.to_batches(columns=["id"], filter=keep):
            for i in b.column(0).to_pylist():
                if len(least) < self.page:
                    heapq.heappush(least, -i)
                elif -i > least[0]:
                    heapq.heapreplace(least, -i)
        self.at = -least[0] if least else at
        return {"id": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """After a restart Spark may plan a page that was begun; reading goes on behind it."""
        self.at = max(end["id"], self.at if self.at is not None else end["id"])
        return [_Page(start["id"], end["id"])]

    def read(self, partition: _Page) -> Iterator:
        """The page's rows as Arrow batches, in the order of their ids."""
        from pyspark.sql.pandas.types import to_arrow_schema

        data, keep = _files(self.path, (partition.first, partition.last))
        rows = data.to_table(columns=self.schema.fieldNames(), filter=keep).sort_by("id")
        yield from rows.cast(to_arrow_schema(self.schema), safe=False).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class CursorSource(DataSource):
    """Options: path of Parquet files with a column id, page, after (the id behind which a new stream begins)."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return self.options["ddl"]

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(schema, self.options)


CURSOR = "cursor long, rows long"


def drain(spark: SparkSession, path: str, to_evidence: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, page: int = PAGE, timeout_s: float = 600) -> int:
    """All that is new in the files at path through to_evidence, page by page, into the tables evidence and cursor under root.

    A page's rows and the cursor become visible together and once. A run that was cut off goes on with the page that
    was not marked. The cursor reached.
    """
    tables = BatchTables(spark, root)
    spark.dataSource.register(CursorSource)
    kinds = spark.read.parquet(path).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    reached = tables.read("cursor", CURSOR).agg(F.max("cursor")).first()[0]

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        mark = df.agg(F.max("id").alias("cursor"), F.count("*").alias("rows")).where("rows > 0")
        tables.add(n, {"evidence": to_evidence(df), "cursor": mark})
        df.unpersist()

    stream = spark.readStream.format("cursor").option("path", path).option("ddl", fields).option("page", page).option("after", -1 if reached is None else reached).load()
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    top = tables.read("cursor", CURSOR).agg(F.max("cursor")).first()[0]
    return -1 if top is None else top


def pages(df: DataFrame, after: int = -1, page: int = PAGE) -> DataFrame:
    """(id, page): the page from 0 in which a cursor behind after meets each id, as drain() takes them.

    Ids are numbered over ranges, so no task sees all of them: a range's first number is the sum of the counts before.
    """
    own = df.where(F.col("id") > after).select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("part"))
    counts = own.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    numbered = own.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("id"))).join(F.broadcast(before.select("part", "before")), "part")
    return numbered.select("id", F.floor((F.col("nth") + F.col("before") - 1) / page).cast("long").alias("page"))
