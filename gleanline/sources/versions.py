"""Tables in plain folders that change as a whole: several at once for a micro-batch, or one by versions with a pointer.

Files are written first and become visible by one small marker, made last and never over another. A writer that dies
leaves files that no reader sees. The marker is made by an exclusive create, which is atomic on a local disk and on HDFS;
an object store needs a connector whose create without overwrite is.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's own files: under spark.checkpoint.dir, which a cluster's machines share; on one machine under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is no such folder."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def claim(spark: SparkSession, path: str, body: str = "") -> bool:
    """Makes a file with that body; false, and nothing changed, if it is there already."""
    p, fs = _path(spark, path)
    if fs.getUri().getScheme() == "file":
        own = fs.makeQualified(p).toUri().getPath()
        os.makedirs(os.path.dirname(own), exist_ok=True)
        half = f"{own}.{uuid.uuid4().hex}.tmp"
        with open(half, "w", encoding="utf-8") as f:
            f.write(body)
        try:
            os.link(half, own)  # the whole file appears at once, or not at all
        except FileExistsError:
            return False
        finally:
            os.unlink(half)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(body.encode()))
    out.close()
    return True


def body_of(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


class BatchTables:
    """Tables under one root to which a micro-batch adds at once and exactly once.

    A batch's rows of a table are its folder batch=<id>, written anew if the batch is run again before it was marked, and
    left alone after. Readers see the batches up to the last marked one. One root belongs to one checkpoint.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> int:
        return max((int(n) for n in names(self.spark, f"{self.root}/_batches") if n.isdigit()), default=-1)

    def add(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Whether the batch was new. A marker of two batches ago is not needed any more."""
        if batch <= self.last():
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        if not claim(self.spark, f"{self.root}/_batches/{batch}"):
            return False
        if batch > 1:
            remove(self.spark, f"{self.root}/_batches/{batch - 2}")
        return True

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of marked batches, with their batch."""
        if not any(n.startswith("batch=") for n in names(self.spark, f"{self.root}/{name}")):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}").where(F.col("batch") <= self.last())


class VersionedTable:
    """A table that is replaced as a whole. Version n is the folder that the file _versions/<n> names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        return max((int(n) for n in names(self.spark, f"{self.path}/_versions") if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or that one; nothing before the first."""
        n = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{body_of(self.spark, f'{self.path}/_versions/{n}').strip()}") if n else None

    def put(self, df: DataFrame, after: int) -> bool:
        """df as the version that follows after; false if another writer made that one meanwhile, and then nothing has changed."""
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{data}")
        if claim(self.spark, f"{self.path}/_versions/{after + 1}", data):
            return True
        remove(self.spark, f"{self.path}/{data}")
        return False

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
        """Puts change(newest version), made again from the newer one as long as others come before. The version made."""
        for _ in range(tries):
            n = self.version()
            if self.put(change(self.read(n) if n else None), n):
                return n + 1
        raise RuntimeError(f"{self.path}: {tries} other versions were made meanwhile")

    def forget(self, keep: int = 2) -> int:
        """Removes all but the newest versions, and files of writers that died; how many folders. Not while others write."""
        own = sorted((int(n) for n in names(self.spark, f"{self.path}/_versions") if n.isdigit()), reverse=True)[:keep]
        held = {body_of(self.spark, f"{self.path}/_versions/{n}").strip() for n in own}
        gone = [n for n in names(self.spark, self.path) if n.startswith("data-") and n not in held]
        for n in gone:
            remove(self.spark, f"{self.path}/{n}")
        for n in names(self.spark, f"{self.path}/_versions"):
            if n.isdigit() and int(n) not in own:
                remove(self.spark, f"{self.path}/_versions/{n}")
        return len(gone)
