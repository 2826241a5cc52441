"""Verdict documents swept into evidence: each content of an agent's file once, however often the file's name is used again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions.text import normalize_agent
from gleanline.sources.versions import BatchTables

EVIDENCE = "session_id string, source string, event string, override_reason string, context string, source_kind string"
MARKS = "name string, content_hash string"


def read_verdict_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body, content_hash) of the JSON files of a folder: the file's stem, its text and the digest of its bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("content_hash")).where("name not like '.%'")


def verdict_evidence(docs: DataFrame, recorded: DataFrame, session_id: str) -> DataFrame:
    """Evidence of the documents (name, body, content_hash) whose content is not what recorded (name, content_hash) has of that name.

    The document's own session goes before that of the sweep. Missing: status UNKNOWN, 0 findings, model unknown, no
    phase. What does not parse and the synthesis give nothing.
    """
    new = docs.where("name <> 'synthesis'").join(recorded.select("name", "content_hash"), ["name", "content_hash"], "left_anti")
    x = new.withColumn("v__", F.try_parse_json("body")).where("v__ is not null")
    field = lambda n: F.try_variant_get("v__", f"$.{n}", "string")
    filled = lambda n, default: F.coalesce(field(n), F.lit(default))
    phase = field("phase")
    context = F.to_json(F.struct(filled("status", "UNKNOWN").alias("status"), F.coalesce(field("findings_count").try_cast("long"), F.lit(0)).alias("findings_count"), filled("model", "unknown").alias("model_used"), F.when(phase != "", phase).alias("phase")))
    own = field("session_id")
    return x.select("name", "content_hash", F.coalesce(F.when(own != "", own), F.lit(session_id)).alias("session_id"), normalize_agent(F.col("name")).alias("source"), F.lit("verdict_outcome").alias("event"), F.lit("").alias("override_reason"), context.alias("context"), F.lit("agent").alias("source_kind"))


def sweep(spark: SparkSession, path: str, root: str, session_id: str) -> int:
    """Adds what is new in the folder to the tables evidence and marks under root, together and once; how many documents it was."""
    tables = BatchTables(spark, root)
    recorded = tables.read("marks", MARKS).groupBy("name").agg(F.max_by("content_hash", "batch").alias("content_hash"))
    new = verdict_evidence(read_verdict_files(spark, path), recorded, session_id).persist()
    n = new.count()
    if n:
        tables.add(tables.last() + 1, {"evidence": new.select(*(c.split()[0] for c in EVIDENCE.split(", "))), "marks": new.select("name", "content_hash")})
    new.unpersist()
    return n
