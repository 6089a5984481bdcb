"""Object listings: names split into cohort, folder and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions.names import blank_to_null


def read_listing_text(spark: SparkSession, path: str) -> DataFrame:
    """A listing saved as text, one object per line."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def read_object_listing(objects: DataFrame) -> DataFrame:
    """Objects with cohort, task folder, tail and is_zip.

    A file in the root of a cohort is a sentinel, not a task: its folder is NULL.
    """
    parts = F.split(F.regexp_replace("name", "^(gs://[^/]+/)?tasks/", ""), "/", 3)
    depth = F.size(parts)
    tail = F.when(depth > 2, F.get(parts, F.lit(2)))
    return objects.select(
        "*",
        F.get(parts, F.lit(0)).alias("cohort"),
        F.when(depth > 2, blank_to_null(F.get(parts, F.lit(1)))).alias("folder"),
        tail.alias("tail"),
        F.coalesce(tail.endswith(".zip"), F.lit(False)).alias("is_zip"),
        (depth <= 2).alias("is_sentinel"),
    )


def folders_from_listing(objects: DataFrame, prefix: str) -> DataFrame:
    """Distinct first path segments below a prefix."""
    rest = F.substring_index("name", f"tasks/{prefix}/", -1)
    return (
        objects.where(F.col("name").contains(f"tasks/{prefix}/"))
        .where(rest.contains("/"))
        .select(F.substring_index(rest, "/", 1).alias("folder"))
        .distinct()
    )


def canonical_archives(objects: DataFrame) -> DataFrame:
    """Task archives per folder: how many, and the newest one.

    Only ``<task>/<sha>.zip`` counts; hand-over copies below it do not.
    """
    direct = F.regexp_extract("name", r"^tasks/([^/]+)/([^/]+)/([^/]+)\.zip$", 3)
    return (
        read_object_listing(objects)
        .withColumn("sha", direct)
        .where((F.col("sha") != "") & ~F.col("name").contains("/review_handoff/"))
        .groupBy("cohort", "folder")
        .agg(
            F.count("*").alias("archives"),
            F.max_by(F.struct("sha", "size_bytes", "updated"), F.struct("updated", "sha")).alias("newest"),
        )
        .select("cohort", "folder", "archives", "newest.*")
    )
