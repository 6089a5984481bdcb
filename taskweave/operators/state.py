"""Membership of the accepted folders, and the state every figure counts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions import runs as R
from taskweave.functions.names import name_key


def membership(objects: DataFrame) -> DataFrame:
    """Packages per task key and cohort, from a listing split by ``read_object_listing``."""
    return (
        objects.where("folder is not null")
        .withColumn("key", name_key(F.col("folder")))
        .groupBy("key", "cohort")
        .agg(
            F.count("*").alias("files"),
            F.count_if("is_zip").alias("packages"),
            F.max(F.when(F.col("is_zip"), F.col("updated"))).alias("updated"),
        )
    )


def join_membership(tasks: DataFrame, member: DataFrame, current: str, gate_only: str) -> DataFrame:
    """Tasks with at_bar, gate_only, cohort count and package count by name key."""
    per_key = member.groupBy("key").agg(
        F.bool_or(F.col("cohort") == current).alias("at_bar"),
        F.bool_or(F.col("cohort") == gate_only).alias("gate_only"),
        F.count_distinct("cohort").alias("cohorts"),
        F.sum("packages").alias("packages"),
    )
    return (
        tasks.withColumn("key", name_key(F.col("task_name")))
        .join(per_key, "key", "left")
        .na.fill({"at_bar": False, "gate_only": False, "cohorts": 0, "packages": 0})
    )


def gate_era(instant: Column, eras) -> Column:
    """The label in force at an instant: the latest boundary not after it.

    ``eras`` is a literal list of (boundary, label), earliest first; the first
    has no boundary. An as-of look-up over a few literals is an expression.
    """
    label = F.lit(eras[0][1])
    for boundary, name in eras[1:]:
        label = F.when(instant >= F.lit(boundary).cast("timestamp"), F.lit(name)).otherwise(label)
    return label


def derive_states(tasks: DataFrame, now: str, cut: str, eras=R.GATE_ERAS) -> DataFrame:
    """Tasks (canonical run + roll-up + membership) with state, scope and era."""
    state = R.derive_state(
        F.col("decision"),
        F.col("state"),
        F.col("accepted_at").cast("timestamp"),
        F.col("at_bar"),
        F.col("gate_only"),
        F.col("cohorts") > 0,
        F.lit(now).cast("timestamp"),
    )
    scope = R.scope_flags(F.col("decided_day"), F.col("first_decided_day"), F.lit(cut).cast("date"))
    return (
        tasks.withColumn("_s", state)
        .withColumn("_c", scope)
        .withColumn("gate_era", gate_era(F.col("decided_at_or_updated").cast("timestamp"), eras))
        .select("*", "_s.*", "_c.*")
        .drop("_s", "_c")
    )


def state_partition(tasks: DataFrame) -> DataFrame:
    """In-scope tasks per state, per predicate and per gate era."""
    dims = ["finalState", "statePredicate", "gate_era"]
    return (
        tasks.where("inScope")
        .groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
        .agg(F.grouping_id().alias("g"), F.count("*").alias("tasks"))
        .select(
            F.when(F.col("g") == 3, F.lit("state")).when(F.col("g") == 5, F.lit("predicate")).otherwise(F.lit("era")).alias("dimension"),
            F.coalesce(*dims).alias("value"),
            "tasks",
        )
    )
