"""Which bench, harness and segment a task belongs to, and who works where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions import packages as K
from taskweave.functions.names import bench_key, name_key
from taskweave.operators.lookups import agreed, lookup_by_priority, name_pairs
from taskweave.sources.tables import RATE

# Leaf segments.
LEAVES = ("company-aster", "company-zeta", "computer-connector", "computer-non-connector")


def side_of_image(bench: Column, gyms: Column) -> Column:
    """The bench an image names; a task that mounts Zeta's gym is Company Bench."""
    company = bench.isin("company bench aster", "company bench zeta")
    computer = bench.isin("computer bench synth", "computer bench real")
    return (
        F.when(company, F.lit("company"))
        .when(computer & K.harness_of_gyms(gyms).isNotNull(), F.lit("company"))
        .when(computer, F.lit("computer"))
    )


def bench_of_rows(truth: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Task rows with ``bench_of_row``.

    Order: a delivered real kind, the image, where it was delivered, its own
    side, then what its name says elsewhere.
    """
    kinds = deliveries.where((F.col("bench") == "computer") & F.col("family").isin(*K.DELIVERED_KIND))
    kind_of = agreed(name_pairs(kinds, F.col("family"), "task", "package_name"))
    sent_as = agreed(name_pairs(deliveries.where("family is not null"), F.col("bench"), "task", "package_name"))
    built = agreed(name_pairs(truth, F.col("bench_side"), "name"))
    rows = lookup_by_priority(truth, "id", ["delivered_task", "package_task", "name"], [kind_of], "_kind")
    rows = lookup_by_priority(rows, "id", ["delivered_task"], [sent_as], "_sent")
    rows = lookup_by_priority(rows, "id", ["name"], [sent_as, built], "_named")
    image = side_of_image(F.col("bench"), F.col("services"))
    bench = F.when(F.col("_kind") != "synthetic", F.lit("computer")).otherwise(
        F.coalesce(image, F.when(F.col("delivered"), F.col("_sent")), "bench_side", "_named")
    )
    return rows.withColumn("bench_of_row", bench).drop("_kind", "_sent", "_named")


def folder_segment(folders: DataFrame, cohort_rows: DataFrame, by_name: DataFrame) -> DataFrame:
    """A folder's segment: that of its cohort row, else by name.

    ``cohort_rows`` is (folder, segment); ``by_name`` is an ``agreed`` table of
    (key, value) segments.
    """
    own = cohort_rows.groupBy(F.lower("folder").alias("fk")).agg(F.max("segment").alias("own"))
    rows = lookup_by_priority(folders, "pos", ["declared_short", "folder"], [by_name], "named")
    return (
        rows.withColumn("fk", F.lower("folder"))
        .join(own, "fk", "left")
        .withColumn("segment", F.coalesce("own", "named", F.lit("unknown")))
        .drop("fk", "own", "named")
    )


def person_segments(ledger: DataFrame, tasks: DataFrame) -> DataFrame:
    """(email, segment): every segment a person has work in. Both inputs are (email, segment)."""
    known = lambda df: df.where("email <> '' and segment <> 'unknown'").select(F.lower("email").alias("email"), "segment")
    return known(ledger).unionByName(known(tasks)).distinct()


def segment_tiles(tasks: DataFrame, people: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per leaf segment: tasks, verdicts, people, and paid ledger tasks; untyped apart."""
    leaf = F.when(F.col("segment").isin(*LEAVES), F.col("segment")).otherwise(F.lit("untyped"))
    state = lambda *s: F.count_if(F.col("state").isin(*s))
    by_task = tasks.groupBy(leaf.alias("segment")).agg(
        F.count("*").alias("tasks"), state("accepted", "legacy accepted").alias("accepted"), state("rejected").alias("rejected")
    )
    by_person = people.where(F.col("segment").isin(*LEAVES)).groupBy("segment").agg(F.count_distinct("email").alias("people"))
    by_money = (
        ledger.where(F.col("segment").isin(*LEAVES))
        .groupBy("segment")
        .agg(F.count("*").alias("ledger"), F.count_if(F.col("payment_state").isin("Paid", "Not itemised")).alias("paid"))
    )
    return by_task.join(by_person, "segment", "left").join(by_money, "segment", "left").na.fill(0)
