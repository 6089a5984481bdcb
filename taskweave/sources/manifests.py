"""Delivery manifests: many layouts to one row shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions import packages as K
from taskweave.functions.names import ANY_NAMESPACE, blank_to_null
from taskweave.functions.runs import domain_of_package

BATCH_TASKS = """tasks array<struct<task_name:string, task_id:string, sha256:string, source_uri:string, difficulty:string, is_connector:boolean,
 execution_type:string, category:string, category_normalized:string, reported_qc_verdict:string, reported_qc:string, qc_status_reported:string,
 source_version:string, original_filename:string, pipeline_batch_id:string>>"""


def read_batch_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per task of the manifests below ``path/batch=<label>/``."""
    docs = spark.read.schema("value string, batch string").text(path)
    each = docs.select("batch", F.inline(F.from_json("value", BATCH_TASKS)["tasks"]))
    found = lambda g: F.nullif(F.regexp_extract("source_uri", r"/tasks/([^/]+)/([^/]+)/([0-9a-f]{64})\.zip$", g), F.lit(""))
    by_words = (F.coalesce("execution_type", F.lit("")) == "connector") | (F.coalesce("category_normalized", F.lit("")) == "connector")
    return each.select(
        "batch", F.col("task_name").alias("name"), "task_id", "sha256", "source_uri",
        found(1).alias("prefix"), found(2).alias("folder"), found(3).alias("object_hash"), "difficulty",
        F.coalesce("is_connector", by_words).alias("connector"),
        F.coalesce(blank_to_null(F.col("category")), "category_normalized").alias("category"),
        F.coalesce(blank_to_null(F.col("reported_qc_verdict")), blank_to_null(F.col("reported_qc")), "qc_status_reported").alias("reported_qc"),
        "source_version", "original_filename", F.col("pipeline_batch_id").alias("batch_id"),
    )


def manifest_problems(tasks: DataFrame) -> DataFrame:
    """(batch, reason): manifests whose layout is not usable, read from flat tasks."""
    package = F.coalesce(blank_to_null(F.col("task_id")), F.regexp_replace(F.substring_index("package_path", "/", -1), r"\.[^.]*$", ""))
    lacking = F.col("package_path").isNull() | (F.col("package_path") == "") | ~F.coalesce(F.col("sha256").rlike(K.SHA256), F.lit(False)) | F.col("size_bytes").isNull()
    per = tasks.groupBy("batch").agg(
        F.count("*").alias("n"), F.count_if(lacking).alias("lacking"), F.min(F.when(lacking, F.col("index"))).alias("first_bad"),
        (F.count(package) - F.count_distinct(package)).alias("repeats"),
    )
    reason = F.when(
        F.col("lacking") > 0,
        F.format_string("%d of %d tasks lack a package_path, sha256 or size_bytes (first at index %d); layout not recognised", "lacking", "n", "first_bad"),
    ).when(F.col("repeats") > 0, F.lit("a package appears twice in the manifest"))
    return per.select("batch", reason.alias("reason")).where("reason is not null")


def normalise_manifest(tasks: DataFrame, bucket: str) -> DataFrame:
    """Rows of every usable manifest, in one shape; a row's id keeps its manifest index.

    ``tasks`` has one row per manifest task: batch, index, task_id, task_name,
    package_path, sha256, size_bytes, difficulty, successes, connector,
    declared, image, package_image, image_read_from, connectors (array), source_uri.
    """
    usable = tasks.join(manifest_problems(tasks).select("batch"), "batch", "left_anti")
    name = blank_to_null(F.regexp_replace(F.trim("task_name"), ANY_NAMESPACE, ""))
    placed = usable.withColumn("parts", K.package_parts(F.col("package_path"))).withColumn(
        "klass", K.package_class(F.get("parts", F.lit(0)), F.col("declared"), F.col("connector"))
    )
    placed = K.with_package_family(
        placed, [F.col("image")], F.col("connector"), F.col("klass"), F.col("declared"), F.col("package_image"), F.col("image_read_from"), F.col("connectors")
    )
    stem = F.regexp_replace(F.element_at("parts", -1), r"\.[^.]*$", "")
    base = (
        placed.withColumn("package", F.coalesce(blank_to_null(F.col("task_id")), stem))
        .withColumn("task", F.coalesce(name, "package"))
        .withColumn("ref", K.source_ref(F.col("source_uri"), F.lit(None).cast("string"), F.lit(None).cast("string"), bucket))
    )
    fam = F.col("family")
    non = fam == "non-connector"
    real = fam.isin("real-aster", "real-zeta", "real")
    bench = F.col("bench")
    filed = F.when((F.col("klass") == "Non-Connector") & (F.size("parts") > 3), F.get("parts", F.lit(2)))
    labels = F.coalesce(*[F.when(fam == f, F.lit(v)) for f, v in K.DELIVERED_KIND.items()], F.lit("Connector · not classified"))
    category = F.when(non, F.concat_ws(" · ", F.lit("Non-Connector"), F.col("domain"))).when(bench == "company", F.lit("CompanyBench")).otherwise(labels)
    band = F.coalesce(blank_to_null(F.col("difficulty")), F.when(F.size("parts") > 2, F.get("parts", F.lit(1))))
    series = F.when(F.col("batch").startswith("CompanyBench"), F.lit("CB")).otherwise(F.lit("B"))
    # What several columns read is bound first, a step at a time, so that no expression holds another twice.
    bound = (
        base.withColumn("bench", F.when(F.coalesce(real, F.lit(False)) & (F.col("klass") != "Real Connector"), "company").otherwise("computer"))
        .withColumn("domain", F.when(non, F.coalesce(filed, domain_of_package(F.col("task")))))
        .withColumn("category", category)
        .withColumn("harness", F.when(bench == "company", F.when(fam == "real-aster", "aster").when(fam == "real-zeta", "zeta")))
        .withColumn("band", F.initcap(band))
    )
    return bound.select(
        F.concat(series, F.regexp_replace("batch", r"\D", ""), F.lit("-"), F.format_string("%03d", "index")).alias("id"),
        "task", F.when(F.col("package") != F.col("task"), F.col("package")).alias("package_name"), "batch",
        "category", F.col("klass").alias("class"), "family", "family_from", "domain",
        F.when(non, "Non-connector").otherwise("Connector").alias("type"), "bench", "harness", F.col("band").alias("difficulty"), F.col("successes").alias("glm"), K.score_bucket(F.lit(None).cast("string"), F.col("successes")).alias("score"),
        F.substring("sha256", 1, 16).alias("sha"), F.round(F.col("size_bytes") / 1e6, 2).alias("size_mb"), "connectors",
        F.col("ref.object").alias("source_object"), F.col("ref.prefix").alias("source_prefix"), F.col("ref.folder").alias("source_folder"), F.col("ref.kind").alias("source_kind"),
    )


def locate_packages(tasks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed tasks, tasks left out, stray files), by any file name of a task.

    ``tasks`` is (batch, index, package_path, task_id, task_name,
    original_filename); ``files`` is (batch, name, path). A name listed twice in
    a batch counts once, at its last path.
    """
    keyed = tasks.withColumn("keys", K.package_file_keys(F.col("package_path"), F.col("task_id"), F.col("task_name"), F.col("original_filename")))
    where = files.groupBy("batch", F.lower("name").alias("key")).agg(F.max("path").alias("path"))
    hits = keyed.select("batch", "index", F.posexplode("keys").alias("n", "key")).join(where, ["batch", "key"])
    placed = hits.groupBy("batch", "index").agg(F.min_by("path", "n").alias("location"))
    left_out = tasks.join(placed, ["batch", "index"], "left_anti")
    stray = where.join(keyed.select("batch", F.explode("keys").alias("key")).distinct(), ["batch", "key"], "left_anti")
    return tasks.join(placed, ["batch", "index"]), left_out, stray


def batch_candidates(folders: DataFrame) -> DataFrame:
    """(batch, decision, folder) of each batch that folders claim.

    ``folders`` is (batch, folder, raw): a lone claim is used; one dedup copy
    wins; identical manifests are read once, under the shortest name; else none.
    """
    is_dedup = F.lower("folder").contains("dedup")
    content = F.coalesce(F.sha2("raw", 256), F.lit("(unreadable)"))
    shortest = F.struct(F.length("folder"), F.col("folder"))
    per = folders.groupBy("batch").agg(
        F.count("*").alias("claims"), F.count_if(is_dedup).alias("dedups"), F.min_by("folder", F.when(is_dedup, F.col("folder"))).alias("dedup"),
        F.min(content).alias("lo"), F.max(content).alias("hi"), F.min_by("folder", shortest).alias("short"),
    )
    same = (F.col("lo") == F.col("hi")) & (F.col("lo") != "(unreadable)")
    decision = (
        F.when(F.col("claims") == 1, "only folder").when(F.col("dedups") == 1, "the dedup copy is used")
        .when(same, "identical manifest; read once").otherwise("different manifests; none published")
    )
    folder = F.when(F.col("claims") == 1, F.col("short")).when(F.col("dedups") == 1, F.col("dedup")).when(same, F.col("short"))
    return per.select("batch", decision.alias("decision"), folder.alias("folder"))
