"""CSV exports and manifests, written from every executor.

Cells are made safe and quoted as columns, so a file is a projection and a
write. Each part file is a complete CSV with its own header.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions.names import NOT_RECORDED, recorded
from taskweave.operators.series import manifest_position
from taskweave.session import create_new, stored
from taskweave.sinks.publish import claim, latest


def guarded(c: Column) -> Column:
    """Text a spreadsheet does not run as a formula; a missing value is empty."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^([=+\-@\t\r])", r"'$1"), F.lit(""))


def joined(c: Column) -> Column:
    return guarded(F.array_join(c, " | "))


def yes_no(c: Column) -> Column:
    """yes, no, or blank for unknown."""
    return F.when(c, "yes").when(~c, "no").otherwise("")


def write_csv(cells: DataFrame, path: str) -> None:
    """RFC-4180 files: quotes doubled, quoted only where needed."""
    cells.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def truth_cells(rows: DataFrame) -> DataFrame:
    """The 28 columns of the task export, as text. Names and wording are fixed."""
    c = F.col
    sure = lambda name: yes_no(F.coalesce(c(name), F.lit(False)))
    identity = F.when(c("unmerged"), "unmerged: keyed on the submission id").otherwise("keyed by the pipeline family id")
    return rows.select(
        guarded(c("name")).alias("task_name"), guarded(c("state")).alias("state"), guarded(c("owner")).alias("trainer"), guarded(c("decided")).alias("decided"),
        sure("decided_inferred").alias("decided_is_approximate"), guarded(c("gate_era")).alias("gate_era"), guarded(c("runs")).alias("runs"),
        sure("at_current_bar").alias("at_current_bar"), sure("gate_only").alias("awaiting_regate"), sure("carried_over").alias("carried_over"),
        sure("delivered").alias("delivered"), guarded(c("delivered_via")).alias("delivered_matched_by"), joined(c("cohorts")).alias("cohorts"),
        yes_no(c("connector")).alias("connector"), joined(c("services")).alias("connector_services"),
        guarded(F.when(c("domain") != "Not recorded", c("domain"))).alias("domain"), joined(c("findings")).alias("findings"),
        joined(c("findings_prior")).alias("findings_on_earlier_run"), sure("possible_duplicate").alias("possible_duplicate"),
        guarded(F.when(c("possible_duplicate"), c("duplicate_siblings"))).alias("duplicate_siblings"), identity.alias("identity"),
        guarded(c("versions")).alias("versions_counted_once"), joined(c("other_versions")).alias("other_versions"), guarded(c("chosen_because")).alias("chosen_because"),
        guarded(c("why")).alias("why_this_state"), guarded(c("canonical_reason")).alias("canonical_run"), guarded(c("id")).alias("task_id"), guarded(c("source")).alias("read_from"),
    )


def audit_cells(rows: DataFrame) -> DataFrame:
    """The 16 columns of the delivery export, as text. Names are fixed."""
    plain = ["task", "batch", "category", "type", "score", "difficulty", "priority", "acceptance", "trainer", "source", "sha", "size_mb", "versions"]
    names = {"score": "glm"}
    return rows.select(
        *[guarded(F.col(n)).alias(names.get(n, n)) for n in plain], joined(F.col("connectors")).alias("connectors"), joined(F.col("flags")).alias("flags"), guarded(F.col("feedback_url")).alias("feedback_url")
    )


def delivery_entries(rows: DataFrame) -> DataFrame:
    """One entry per delivered package in batch then manifest order; none dropped."""
    c = F.col
    return manifest_position(rows).select(
        "position", F.coalesce("package_name", "task").alias("task_id"), c("task").alias("task_name"), F.substring_index("package_path", "/", -1).alias("original_filename"),
        "package_path", "batch", F.lower("difficulty").alias("difficulty"), F.struct(c("glm").alias("successes"), F.lit(4).alias("runs")).alias("trial_evidence"),
        "category", (c("type") == "Connector").alias("connector"), F.transform(F.coalesce("connectors", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"))).alias("connector_services"),
        F.when(c("bench") == "company", "Company Bench").otherwise("Computer Bench").alias("bench"), "source_uri", "sha256", "size_bytes",
    )


def entry_summary(entries: DataFrame) -> DataFrame:
    """(measure, value, n): the tallies that go with the entries."""
    pairs = F.array(
        F.struct(F.lit("by_batch").alias("measure"), recorded(F.col("batch")).alias("value")),
        F.struct(F.lit("by_bench").alias("measure"), F.col("bench").alias("value")),
        F.struct(F.lit("by_successes").alias("measure"), F.coalesce(F.col("trial_evidence.successes").cast("string"), F.lit(NOT_RECORDED)).alias("value")),
    )
    tallies = entries.select(F.inline(pairs)).groupBy("measure", "value").agg(F.count("*").alias("n"))
    totals = entries.agg(
        F.count("*").alias("tasks"), F.count_distinct("batch").alias("batches"), F.count_if("connector").alias("connector"),
        F.sum("size_bytes").alias("total_bytes"), F.count_if(F.col("sha256").isNull()).alias("without_checksum"),
    )
    return tallies.unionByName(totals.unpivot([], totals.columns, "measure", "n").withColumn("value", F.lit("")))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def shard_of(path: Column, buckets: int) -> Column:
    """First four bytes of the path's SHA-1, modulo the shards."""
    return F.conv(F.substring(F.sha1(path), 1, 8), 16, 10).cast("bigint") % buckets


def folder_index(objects: DataFrame, buckets: int) -> DataFrame:
    """(shard, folder, kind, name, bytes): every folder's direct children, one row each.

    A folder may hold a large share of all objects, so children stay rows; a
    reader opens one shard and filters on the folder.
    """
    parts = F.split("name", "/")
    depth = F.size(parts)
    level = F.sequence(F.lit(0), depth - 1)
    child = lambda i: F.struct(
        F.array_join(F.slice(parts, 1, i), "/").alias("folder"), F.get(parts, i).alias("name"), (i == depth - 1).alias("is_file")
    )
    each = objects.select("size_bytes", F.inline(F.transform(level, child)))
    return (
        each.groupBy("folder", "name", "is_file").agg(F.sum(F.when(F.col("is_file"), F.col("size_bytes"))).alias("bytes"))
        .select(shard_of(F.col("folder"), buckets).alias("shard"), "folder", F.when(F.col("is_file"), "file").otherwise("dir").alias("kind"), "name", "bytes")
    )


def folder_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("shard", "folder").agg(
        F.count_if(F.col("kind") == "dir").alias("dirs"), F.count_if(F.col("kind") == "file").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )


SHARD = "shard bigint, digest bigint, other bigint, n bigint, folder string"


def shard_digests(index: DataFrame) -> DataFrame:
    """(shard, digest, other, n): two digests of a shard's rows, whatever their order."""
    columns = sorted(index.columns)
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), *columns)).alias(name) for k, name in ((1, "digest"), (2, "other"))]
    return index.groupBy("shard").agg(*hashes, F.count("*").alias("n"))


def sync_shards(index: DataFrame, root: str) -> list[int]:
    """Publish a folder index, writing only the shards that changed; their numbers.

    A version is a list of shards, each with its digest and the folder that holds it. A shard
    whose digest is that of the version before is carried on by its folder; the others are
    written below a new one. The list becomes readable when its pointer is there. A list is a
    row per shard.
    """
    spark = index.sparkSession
    held = stored(index, "folder-index")
    before = {r["shard"]: r for r in _shards(spark, root)}
    now = shard_digests(held).collect()
    same = {r["shard"] for r in now if r["shard"] in before and tuple(before[r["shard"]])[:4] == tuple(r)}
    changed = sorted(r["shard"] for r in now if r["shard"] not in same)
    name = uuid.uuid4().hex
    if changed:
        wanted = spark.createDataFrame([(s,) for s in changed], "shard bigint")
        # Rebalancing keeps files few and splits a heavy shard.
        held.join(F.broadcast(wanted), "shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{root}/shards/{name}")
    rows = [(*r, before[r["shard"]]["folder"] if r["shard"] in same else f"{name}/shard={r['shard']}") for r in now]
    spark.createDataFrame(rows, SHARD).coalesce(1).write.parquet(f"{root}/lists/{name}")
    create_new(spark, f"{root}/pointers/{claim(spark, root)}-{name}")
    return changed


def _shards(spark: SparkSession, root: str) -> list:
    found = latest(spark, root)
    return spark.read.schema(SHARD).parquet(f"{root}/lists/{found[1]}").collect() if found else []


def read_shards(spark: SparkSession, root: str, shard: int | None = None) -> DataFrame:
    """The latest folder index, or one shard of it."""
    parts = [r for r in _shards(spark, root) if shard in (None, r["shard"])]
    columns = "folder string, kind string, name string, bytes bigint"
    if not parts:
        return spark.createDataFrame([], f"shard bigint, {columns}")
    rows = spark.read.schema(columns).parquet(*[f"{root}/shards/{r['folder']}" for r in parts])
    # The folder's name says which shard it is.
    shard_in_path = F.regexp_extract(F.col("_metadata.file_path"), r"/shard=(\d+)/[^/]*$", 1).cast("bigint")
    return rows.select(shard_in_path.alias("shard"), "folder", "kind", "name", "bytes")
