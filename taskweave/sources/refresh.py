"""Verdict documents read once: later runs open new and changed ones only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.operators.quality import check_unique
from taskweave.session import stored
from taskweave.sinks.publish import latest, publish_if_reconciled, read_published
from taskweave.sources.records import read_documents, verdict_rows

# Documents that are opened by their paths; of more, the folder is read and others are dropped.
NAMED = 10_000


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, updated) of the documents stored one per file; none is opened."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.col("path").alias("name"), F.col("modificationTime").cast("string").alias("updated"))


def open_files(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    """Opens the files that a table of (name, updated) lists."""

    def opened(wanted: DataFrame) -> DataFrame:
        names = [r["name"] for r in wanted.select("name").limit(NAMED + 1).collect()]
        if len(names) <= NAMED:
            return read_documents(spark, names)
        return read_documents(spark, folder).join(wanted.select("name"), "name", "left_semi")

    return opened


def refresh_verdicts(listing: DataFrame, opened: Callable[[DataFrame], DataFrame], root: str) -> int:
    """Bring the published verdict rows below ``root`` up to a listing; how many documents were opened.

    ``listing`` is (name, updated), a row per document; ``opened`` reads those of a part of it
    as (name, updated, body). A version holds the listing that it answers for and its rows. Rows
    of documents that are as they were are carried on, those of documents that are gone are
    dropped; a document that could not be parsed is not opened again until it changes.
    """
    spark = listing.sparkSession
    listed = stored(listing.select("name", "updated"), "listing")
    found = latest(spark, root)
    known = read_published(spark, root, "documents") if found else listed.limit(0)
    same = listed.join(known, ["name", "updated"], "left_semi")
    changed = stored(listed.join(known, ["name", "updated"], "left_anti"), "changed")
    n = changed.count()
    if found and not n and listed.count() == known.count():
        return 0
    rows = verdict_rows(opened(changed)) if n else None
    if found:
        kept = read_published(spark, root, "rows").join(same.select(F.col("name").alias("source")), "source", "left_semi")
        rows = kept if rows is None else rows.unionByName(kept)
    rows = stored(rows, "verdict-rows")
    repeated = check_unique(rows, ["source", "task_pos"]).agg(F.lit("one row per document and task").alias("check"), F.count("*").alias("failures"))
    publish_if_reconciled({"documents": listed, "rows": rows}, repeated, root)
    return n
