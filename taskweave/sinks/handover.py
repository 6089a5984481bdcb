"""The ready manifest as one hand-over: entries, the rows they stand for, and the selection's arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.operators.lookups import side_by_side
from taskweave.operators.series import select_for_manifest, selection_arithmetic, stands_for
from taskweave.session import stored
from taskweave.sinks.publish import publish_if_reconciled

PARTS = ("entries", "stands_for", "arithmetic")


def publish_hand_over(rows: DataFrame, excluded: DataFrame | None, size: int | None, root: str) -> bool:
    """Publishes the three tables under one version, if they agree with each other.

    The rows an entry stands for stay rows of their own, however many they are.
    """
    entries = stored(select_for_manifest(rows, excluded, size), "entries")
    members = stored(stands_for(rows, entries), "stands-for")
    arithmetic = stored(selection_arithmetic(rows, excluded, entries, size), "arithmetic")
    figures = side_by_side(
        entries.agg(F.count("*").alias("entries"), F.max("position").alias("last"), F.coalesce(F.sum("stands_for"), F.lit(0)).alias("represented")),
        members.agg(F.count("*").alias("members")),
        arithmetic.select("taken"),
    )
    failed = (F.col("represented") != F.col("members")) | (F.col("taken") != F.col("entries")) | (F.coalesce("last", F.lit(0)) != F.col("entries"))
    checks = figures.select(F.lit("hand-over adds up").alias("check"), failed.cast("bigint").alias("failures"))
    return publish_if_reconciled({"entries": entries, "stands_for": members, "arithmetic": arithmetic}, checks, root)
