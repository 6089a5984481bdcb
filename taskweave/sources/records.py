"""Verdict, evaluation and owner documents to rows.

Documents arrive one per file, or one per line as an envelope (name, updated,
body). Bodies are parsed with declared schemas; fields that come in several
types are read as text and settled in a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions.names import blank_to_null
from taskweave.functions.runs import category_of, cycle_status, gate_hints

# A verdict carries the submission and a list of tasks. Counts that are
# sometimes lists are declared as text.
VERDICT = """schema string, state string, state_rank bigint, stage string, decided_at string, updated_at string, owner string,
 delegated_by string, delivery string, family_id string, task_id string, run_id string, version string, submission_batch_id string,
 pipeline_batch_id string, tasks array<struct<task:string, decision:string, status:string, findings:string, blocking_findings:string,
 steps:string, blocked_at:string>>, _corrupt_record string"""
LEDGER = """cycles array<struct<run_id:string, task_id:string, family_id:string, task_name:string, status:string, sequence:bigint, attempt:bigint,
 enqueued_at:string, started_at:string, completed_at:string,
 submission:struct<status:string, submitted_by:string, pipeline_verdict:struct<decision:string, updated_at:string>>>>"""
HISTORY = """owner_email string, records array<struct<kind:string, object_name:string,
 record:struct<task_id:string, task_name:string, status:string, mode:string, created_at:string, finished_at:string>>>"""
OWNER_DOC = """owner_email string, task_name string, family_id string, records array<struct<record:struct<task_name:string, family_id:string>>>"""
ENVELOPE = "name string, updated string, body string"


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, updated, body) of documents stored one per file, below a folder or listed."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_modification_time").cast("string").alias("updated"), F.col("value").alias("body")
    )


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(name, updated, body) of documents exported one per line."""
    return spark.read.schema(ENVELOPE).json(path)


def _parsed(docs: DataFrame) -> DataFrame:
    body = F.from_json("body", VERDICT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return docs.withColumn("v", body)


def _whole_number(c: Column) -> Column:
    """A count, or NULL where the field holds a list."""
    return F.when(c.rlike(r"^-?\d+$"), c.cast("bigint"))


def finding_codes(findings: Column) -> Column:
    """Codes of a findings list; a bare count has none."""
    listed = F.from_json(findings, "array<struct<code:string>>")
    codes = F.filter(F.transform(listed, lambda f: f["code"]), lambda c: c.isNotNull() & (c != ""))
    return F.when(F.ltrim(findings).startswith("["), F.coalesce(codes, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def verdict_rows(docs: DataFrame) -> DataFrame:
    """One row per submission x task; one flagged row when a verdict names none."""
    good = _parsed(docs).where("v._corrupt_record is null and v is not null")
    each = good.select("name", "updated", "body", "v", F.posexplode_outer("v.tasks").alias("task_pos", "t"))
    text = lambda c: blank_to_null(F.col(c))
    return each.select(
        F.col("name").alias("source"),
        F.regexp_replace(F.substring_index("name", "/", -1), r"\.json$", "").alias("submission"),
        F.coalesce("task_pos", F.lit(0)).alias("task_pos"),
        F.col("updated").alias("object_updated"),
        F.col("v.schema").alias("schema"), text("v.state").alias("state"), text("v.stage").alias("stage"),
        F.col("v.decided_at").try_cast("timestamp").alias("decided_at"), F.col("v.updated_at").try_cast("timestamp").alias("updated_at"),
        blank_to_null(F.col("v.decided_at")).isNull().alias("decided_inferred"),
        F.lower(text("v.owner")).alias("owner"), text("v.family_id").alias("family_id"), text("v.task_id").alias("task_id"), text("v.run_id").alias("run_id"),
        gate_hints(F.col("body")).alias("gate"),
        text("t.task").alias("task_name"), F.coalesce("t.decision", F.lit("")).alias("decision"), F.col("t.status").alias("status"),
        F.col("t").isNotNull().alias("per_task_decision"),
        F.when(F.col("t").isNotNull(), finding_codes(F.col("t.findings"))).otherwise(F.array().cast("array<string>")).alias("finding_codes"),
        _whole_number(F.col("t.blocking_findings")).alias("blocking_findings"), _whole_number(F.col("t.steps")).alias("steps"),
    )


def ingest_coverage(docs: DataFrame, expected_schema: str) -> DataFrame:
    """(measure, value): documents listed, read and failed, and the rows they give."""
    parsed = _parsed(docs)
    failed = F.col("v").isNull() | F.col("v._corrupt_record").isNotNull()
    tasks = F.when(~failed, F.coalesce(F.size("v.tasks"), F.lit(0)))
    counted = parsed.agg(
        F.count("*").alias("objects_listed"),
        F.count_if(~failed).alias("objects_read"),
        F.count_if(failed).alias("objects_failed"),
        F.count_if(~failed & ~F.coalesce(F.col("v.schema") == expected_schema, F.lit(False))).alias("unexpected_schema"),
        F.sum(F.when(~failed, F.greatest(tasks, F.lit(1)))).alias("rows"),
        F.sum(F.greatest(tasks, F.lit(0))).alias("rows_with_decision"),
        F.count_if(tasks <= 0).alias("rows_without_decision"),
    )
    return counted.unpivot([], counted.columns, "measure", "value")


def evaluation_cycles(docs: DataFrame) -> DataFrame:
    """One row per cycle of each ledger document; the owner is in the document's path."""
    cycles = docs.select("name", F.inline(F.from_json("body", LEDGER)["cycles"]))
    stamp = F.coalesce("enqueued_at", "started_at")
    return cycles.select(
        F.col("run_id").alias("id"), F.element_at(F.split("name", "/"), -2).alias("owner_key"), "task_id", "family_id",
        F.coalesce("task_name", "task_id").alias("task"), F.lower("submission.submitted_by").alias("trainer"),
        cycle_status(F.col("submission.status"), F.col("submission.pipeline_verdict.decision"), F.col("status")).alias("status"),
        F.coalesce("sequence", F.lit(0)).alias("sequence"), F.coalesce("attempt", F.lit(0)).alias("attempt"),
        F.to_date(stamp).alias("submitted_on"), category_of(F.coalesce("task_name", "task_id")).alias("category"),
    )


def legacy_runs(docs: DataFrame) -> DataFrame:
    """One row per ``run`` record of each history document."""
    parsed = docs.select(F.from_json("body", HISTORY).alias("h"))
    each = parsed.select(F.lower("h.owner_email").alias("trainer"), F.explode("h.records").alias("r")).where("r.kind = 'run'")
    return each.select(
        F.col("r.object_name").alias("id"), "trainer", F.coalesce("r.record.task_name", "r.record.task_id", F.lit("Unknown")).alias("task"),
        cycle_status(F.lit(None), F.lit(None), F.col("r.record.status")).alias("status"),
        F.coalesce("r.record.mode", F.lit("Unknown")).alias("task_type"), F.to_date("r.record.created_at").alias("submitted_on"),
    )


def trainer_records(docs: DataFrame) -> DataFrame:
    """(task, family_id, trainer) per owner document; the name may sit in a record."""
    o = docs.select("name", F.from_json("body", OWNER_DOC).alias("o"))
    first = lambda field: F.get(
        F.filter(F.transform("o.records", lambda r: r["record"][field]), lambda v: v.isNotNull() & (v != "")), F.lit(0)
    )
    return o.select(
        F.col("name").alias("source"),
        F.coalesce(blank_to_null(F.col("o.task_name")), first("task_name")).alias("task"),
        F.coalesce(blank_to_null(F.col("o.family_id")), first("family_id")).alias("family_id"),
        F.lower(blank_to_null(F.col("o.owner_email"))).alias("trainer"),
    ).where("task is not null and trainer is not null")
