"""From raw documents to packed training sequences, each stage over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm import langid, nearcopies, packing, secrets, toxicity
from gleanline.llm.common import free_name, keep, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last category of the classifier chain is under its threshold; learned from their labelled part."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).where(~F.col("toxic")).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language; those without any letter go. If no row says its language, all stay."""
    model = langid.learn(docs)
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns) if model.languages else docs


#: Numbers of documents made here are from this one on.
MADE = 1 << 62


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the least doc_id, those without one last.

    Texts decide, not ids: rows that share a doc_id and have different texts are different documents. Rows alike in
    both are one, of which the first by all columns stays. A null text and one without a word are copies of nothing.
    """
    own = free_name(docs, "own_id")
    made = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(MADE))
    shared = keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(own)))
    lone = docs.withColumn(own, F.when(F.col("doc_id") < MADE, F.col("doc_id")).otherwise(made))
    rows = lone if shared.isEmpty() else lone.join(shared.withColumnRenamed(own, f"{own}2"), F.col(own) == F.col(f"{own}2"), "left").withColumn(own, F.when(F.col(f"{own}2").isNull(), F.col(own)).otherwise(made)).drop(f"{own}2")
    groups = keep(nearcopies.near_copy_components(rows, id_col=own).distinct())
    members = groups.join(groups.where("doc_id <> component_id").select("component_id").distinct(), "component_id").withColumnRenamed("doc_id", own)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", own))
    first = rows.select(own, "doc_id").join(members, own).groupBy("component_id").agg(order[own].alias("first"))
    gone = members.join(first, "component_id").where(F.col(own) != F.col("first")).select(own)
    kept = rows.join(gone, own, "left_anti")
    again = keep(rows.groupBy(own).count().where("count > 1").select(own))
    once = kept.join(again, own, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return once
    least = kept.join(again, own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(least.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and its place there."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The first two stages are learned models and the last needs a tokenizer: no SQL. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
