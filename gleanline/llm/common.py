"""What the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, one of this machine if all run on it."""
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if configured is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        set_dir = sc.getCheckpointDir()
    return configured or set_dir


def keep(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no more than a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def files(uri: str):
    """The file system of a folder and the folder's path in it: local, hdfs, s3 and what else pyarrow reads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder, and that table's path: for what is large, or needed for a while only."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(path: str) -> None:
    """Removes a table of store() that nothing will read again."""
    system, own = files(path)
    system.delete_dir(own)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it Python workers get so many rows at a time at most; it holds for what is computed within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, longer by as many underscores as it takes to be none of df's columns in either case."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name += "_"
    return name


def bounded_sample(df: DataFrame, share: float, most: int) -> DataFrame:
    """About that share of the different rows of df, by a hash of all their columns.

    Most of them at most: a guard that only binds if rows are far more than share says. Then which are left is open.
    """
    order = F.xxhash64(F.lit("sample"), *(F.col(f"`{c}`") for c in df.columns))
    return df.where(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20)).distinct().limit(most)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
