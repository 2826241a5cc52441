"""Logs, transcripts and documents to rows. Lines that do not parse are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions.text import invocation_hash

AUDIT = "ts string, session_id string, tool string, name string, duration_ms long, exit_code int"
TOOLTIME = "v int, id string, ts string, event string, tool string, project string, error string, source string, skill string"
ROUTES = "event string, route_id string, timestamp string, query_hash string, cwd string, candidates array<struct<id:string,score:double,selected_by:string,required_by:array<string>>>"
BLOCKS = "array<struct<type:string,name:string,text:string,input:struct<skill:string>>>"
COLUMNS = ("invocation_id", "session_id", "skill_name", "ts", "success", "project", "event", "context")


def read_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value and path of each line; plain or gzip by the file's name."""
    return spark.read.text(paths).withColumn("path", F.col("_metadata.file_path"))


def select_source(audit: DataFrame | None, tooltime: DataFrame | None) -> DataFrame:
    """The rows of the audit log if there is one, else of the tool-time log."""
    return parse_audit(audit) if audit is not None else parse_tooltime(tooltime)


def _json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad__"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok")).where("ok").select("r.*")


def _time(c):
    return F.try_to_timestamp(F.regexp_replace(c, "T(.*?)Z?$", " $1")).cast("timestamp_ntz")


def parse_audit(lines: DataFrame) -> DataFrame:
    """Skill calls with a name and a time; a missing exit code counts as success."""
    r = _json(lines, AUDIT).where("tool = 'Skill' and name <> '' and ts <> ''")
    return r.select(invocation_hash(F.col("ts"), F.col("session_id"), F.col("name")).alias("invocation_id"), "session_id", F.col("name").alias("skill_name"), _time(F.col("ts")).alias("ts"), F.coalesce(F.col("exit_code") == 0, F.lit(True)).alias("success"), F.lit("").alias("project"), F.lit("skill_invocation").alias("event"), F.to_json(F.struct("duration_ms", "exit_code")).alias("context"))


def parse_tooltime(lines: DataFrame) -> DataFrame:
    r = _json(lines, TOOLTIME).where("tool = 'Skill' and skill <> '' and ts <> ''").withColumn("session_id", F.regexp_replace("id", r"-\d+$", ""))
    return r.select(invocation_hash(F.col("ts"), F.col("session_id"), F.col("skill")).alias("invocation_id"), "session_id", F.col("skill").alias("skill_name"), _time(F.col("ts")).alias("ts"), F.col("error").isNull().alias("success"), F.coalesce("project", F.lit("")).alias("project"), F.lit("skill_invocation").alias("event"), F.to_json(F.struct("id")).alias("context"))


def parse_routes(lines: DataFrame) -> DataFrame:
    """One row for each candidate of a receipt; rank is its place from 1."""
    r = _json(lines, ROUTES).select("route_id", "timestamp", "cwd", F.posexplode("candidates").alias("i", "c"))
    context = F.to_json(F.struct((F.col("i") + 1).alias("rank"), F.col("c.score").alias("score")))
    return r.select(F.concat("route_id", F.lit("#"), F.col("i").cast("string"), F.lit(":"), "c.id").alias("invocation_id"), F.col("route_id").alias("session_id"), F.col("c.id").alias("skill_name"), _time(F.col("timestamp")).alias("ts"), F.lit(None).cast("boolean").alias("success"), F.element_at(F.split("cwd", "/"), -1).alias("project"), F.lit("route_candidate").alias("event"), context.alias("context"))


def dispatch_events(hooks: DataFrame) -> DataFrame:
    """hooks (session_id, tool_name, subagent, ts): calls of the task tool."""
    return hooks.where("tool_name = 'Task'").select("session_id", "ts", F.coalesce(F.when(F.col("subagent") != "", F.col("subagent")), F.lit("unknown")).alias("source"), F.lit("agent_dispatch").alias("event"))


def _page(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy("id").limit(limit)


def kernel_events(bus: DataFrame, after_id: int, limit: int | None = None) -> DataFrame:
    """All events after the cursor, or a page of the next ones; those without source or type left out."""
    batch = _page(bus.where(F.col("id") > after_id), limit)
    return batch.where("source <> '' and type <> ''").select("id", "ts", "session_id", F.concat(F.lit("kernel-"), "source").alias("source"), F.col("type").alias("event"))


#: What a dismissal says about an agent.
REASONS = {"agent_wrong": "agent_wrong", "deprioritized": "deprioritized", "already_fixed": "stale_finding", "not_applicable": "not_applicable"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def disagreements(reviews: DataFrame) -> DataFrame:
    """A row for each agent whose severity was not the chosen one; reviews without finding, resolution or severity give none.

    Without a dismissal the reason is severity_miscalibrated if the finding was accepted with its severity overridden;
    else, and for a dismissal of another name, it is empty.
    """
    whole = F.lit(True)
    for c in ("finding_id", "resolution", "chosen_severity"):
        whole = whole & (_text(c) != "")
    x = reviews.where("coalesce(event_type, '') <> 'execution_defect'").where(whole)
    x = x.select("id", "ts", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), "finding_id", "chosen_severity", "resolution", "impact", "dismissal_reason", F.explode(F.from_json("agents_json", "map<string,string>")).alias("source", "severity"))
    raised = (F.coalesce("dismissal_reason", F.lit("")) == "") & (F.col("resolution") == "accepted") & (F.col("impact") == "severity_overridden")
    reason = F.when(raised, "severity_miscalibrated").otherwise("")
    for k, v in REASONS.items():
        reason = F.when(F.col("dismissal_reason") == k, v).otherwise(reason)
    context = F.to_json(F.struct(*(_text(c).alias(n) for c, n in (("finding_id", "finding_id"), ("severity", "agent_severity"), ("chosen_severity", "chosen_severity"), ("resolution", "resolution"), ("impact", "impact"), ("dismissal_reason", "dismissal_reason")))))
    return x.where(~F.col("severity").eqNullSafe(F.col("chosen_severity"))).select("id", "ts", "session_id", "source", F.lit("disagreement_override").alias("event"), reason.alias("override_reason"), context.alias("context"), F.col("dismissal_reason").alias("raw_override_reason"))


def execution_defects(reviews: DataFrame) -> DataFrame:
    """A row for the agent that a review's agents name as target, or else the first of them by name; reviews without finding, resolution or target give none."""
    x = reviews.where("event_type = 'execution_defect'").where((_text("finding_id") != "") & (_text("resolution") != ""))
    x = x.withColumn("a__", F.from_json("agents_json", "map<string,string>"))
    named = F.col("a__")["target"]
    target = F.coalesce(F.when(named != "", named), F.try_element_at(F.sort_array(F.map_keys("a__")), F.lit(1)))
    x = x.withColumn("target__", target).where("target__ <> ''")
    context = F.to_json(F.struct(_text("finding_id").alias("finding_id"), F.coalesce(F.col("a__")["reporter"], F.lit("")).alias("reporter"), F.col("target__").alias("target"), _text("chosen_severity").alias("severity"), _text("resolution").alias("resolution"), _text("impact").alias("impact")))
    return x.select("id", "ts", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.col("target__").alias("source"), F.lit("execution_defect").alias("event"), F.lit("").alias("override_reason"), context.alias("context"), F.lit("").alias("raw_override_reason"))


def review_evidence(reviews: DataFrame, after_id: int) -> DataFrame:
    new = reviews.where(F.col("id") > after_id)
    return disagreements(new).unionByName(execution_defects(new))


def cursor(df: DataFrame) -> DataFrame:
    return df.agg(F.max("id").alias("cursor"))


def winning_mutations(m: DataFrame, after_id: int, limit: int | None = None, prefix: str = "lab:") -> DataFrame:
    best = _page(m.where((F.col("is_new_best") == 1) & (F.col("id") > after_id)), limit)
    return best.select("id", F.col("created_at").alias("ts"), "session_id", F.concat(F.lit(prefix), "task_type").alias("source"), F.lit("winning_mutation").alias("event"), "quality_signal", F.lit("pattern").alias("source_kind"))


def outcome_evidence(df: DataFrame, event: str, fields: list[str]) -> DataFrame:
    """Typed records as evidence with the fields in a JSON context."""
    return df.select("session_id", "ts", F.coalesce("source", F.lit("unknown")).alias("source"), F.lit(event).alias("event"), F.to_json(F.struct(*fields)).alias("context"))


#: The source of each typed record, and its fields with their types and defaults; a field without one must be there.
OUTCOMES = {
    "decomposition_outcome": ("decomposition", (
        ("epic", "string", None), ("predicted_children", "long", None), ("actual_children", "long", None), ("completion_rate", "double", 0.0), ("replan_count", "long", 0),
        ("intent_survival", "double", 1.0), ("complexity", "long", 3), ("baseline_typical", "long", 5),
    )),
    "reaction_dispatched": ("reaction", (
        ("review_id", "string", None), ("input_path", "string", ""), ("agents_dispatched", "long", 0), ("reactions_produced", "long", 0), ("reactions_empty", "long", 0), ("reactions_errors", "long", 0),
        ("convergence_before", "double", 0.0), ("agent_count", "long", 0), ("fixative_injections", "long", 0),
    )),
    "reaction_outcome": ("reaction", (
        ("review_id", "string", None), ("convergence_after", "double", 0.0), ("sycophancy_flags", "string", "[]"), ("discourse_health", "string", "{}"), ("hearsay_count", "long", 0),
        ("independent_count", "long", 0), ("contested_count", "long", 0), ("minority_preserved", "boolean", False),
    )),
    "override": (None, (("correction", "string", ""), ("note", "string", ""))),
}


def typed_outcomes(df: DataFrame, event: str) -> DataFrame:
    """Records (session_id, ts, source where the kind has none of its own, fields) as evidence with a JSON context.

    A field that the records lack or have as null gets its default; a record without one that must be there is dropped.
    A manual correction is an override whose reason is the record's override_reason.
    """
    own, fields = OUTCOMES[event]
    has = {c.lower() for c in df.columns}
    whole, columns = F.col("session_id").isNotNull(), []
    for name, kind, default in fields:
        c = F.col(name).try_cast(kind) if name in has else F.lit(None).cast(kind)
        if default is None:
            whole = whole & c.isNotNull()
        columns.append((c if default is None else F.coalesce(c, F.lit(default))).alias(name))
    source = F.lit(own) if own else F.coalesce("source", F.lit("unknown"))
    reason = F.coalesce("override_reason", F.lit("")) if "override_reason" in has else F.lit("")
    return df.where(whole).select("session_id", "ts", source.alias("source"), F.lit(event).alias("event"), reason.alias("override_reason"), F.to_json(F.struct(*columns)).alias("context"))


def read_transcripts(spark: SparkSession, path: str, schema: str = "line long, type string, timestamp string, isMeta boolean, isSidechain boolean, message struct<content:string,usage:struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long>>") -> DataFrame:
    """Records with their number, kept by the writer; the file's stem is the session.

    Of the content, text or blocks: skills has the names of all Skill calls of an assistant's record, skill the first;
    text is that of the text blocks, null for a turn with a tool's result. ts is the time as an instant.
    """
    lines = spark.read.text(path).withColumn("session_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl", 1))
    json = F.try_parse_json("value")
    r = lines.select("session_id", F.from_json("value", schema).alias("r"), *(F.schema_of_variant(F.try_variant_get(json, p, "variant")).alias(c) for c, p in (("m__", "$.message"), ("c__", "$.message.content"))), F.try_variant_get(json, "$.message", "string").alias("own__")).where("r.type is not null").select("session_id", "r.*", "m__", "c__", "own__")
    r = r.withColumn("b__", F.when(F.col("c__").startswith("ARRAY"), F.from_json("message.content", BLOCKS)))
    calls = F.filter("b__", lambda b: (b.type == "tool_use") & (b.name == "Skill") & b.input.skill.isNotNull())
    skills = F.when(F.col("type") == "assistant", F.transform(calls, lambda b: b.input.skill))
    said = F.transform(F.filter("b__", lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text)
    joined = F.when((F.size(said) > 0) & ~F.exists("b__", lambda b: b.type.eqNullSafe("tool_result")), F.array_join(said, "\n"))
    text = F.when(F.col("m__") == "STRING", F.col("own__")).when(F.col("c__") == "STRING", F.col("message.content")).otherwise(joined)
    return r.select("*", skills.alias("skills"), F.try_element_at(skills, F.lit(1)).alias("skill"), text.alias("text"), _time(F.col("timestamp")).alias("ts")).drop("m__", "c__", "own__", "b__")


WORK_ITEM = "id string, status string, project string, started_at timestamp_ntz, closed_at timestamp_ntz, updated_at timestamp_ntz"


def read_work_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines; folders project=<name> give the project of lines that lack it. Lines that do not parse are in bad_work_items."""
    rows = spark.read.schema(f"{WORK_ITEM}, bad__ string").option("columnNameOfCorruptRecord", "bad__").json(path)
    return rows.where("bad__ is null and id is not null and status is not null").drop("bad__")


def bad_work_items(spark: SparkSession, path: str) -> DataFrame:
    """(line, path): the lines that are no item: what does not parse, and what lacks id or status."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")).where("trim(line) <> ''")
    r = F.from_json("line", f"{WORK_ITEM}, bad__ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad__"})
    return lines.withColumn("r", r).where("r.bad__ is not null or r.id is null or r.status is null").drop("r")


def read_skill_docs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Skill and command documents, one for each name: the first root wins, a skill before a command."""
    docs = None
    for i, root in enumerate(roots):
        d = spark.read.text(f"{root}/*/*/*.md", wholetext=True).select(F.lit(i).alias("root"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        docs = d if docs is None else docs.unionByName(d)
    skill = F.regexp_extract("path", r"/skills/([^/]+)/[^/]+\.md$", 1)
    name = F.coalesce(F.when(skill != "", skill), F.regexp_extract("path", r"/([^/]+)\.md$", 1))
    return first_wins(docs.withColumn("skill_name", name).withColumn("kind", F.when(skill != "", 0).otherwise(1)), "skill_name", ["kind", "root", "path"])


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rank__ = 1").drop("rank__")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a document whose version is at most 1; none otherwise."""
    doc = spark.read.schema("version int, overrides array<struct<agent:string,action:string,confidence:double,reason:string>>").json(path, multiLine=True)
    return doc.where("version <= 1").select(F.explode("overrides").alias("o")).select("o.*")


def read_fleet(spark: SparkSession, pattern: str) -> DataFrame:
    """All projects' stores; the project is the third folder above the file."""
    return spark.read.parquet(pattern).withColumn("project", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -4))
