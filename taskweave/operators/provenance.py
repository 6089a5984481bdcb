"""Figures as chains of surviving counts, vocabulary and duplicate flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions import runs as R
from taskweave.functions.names import plain_key


def provenance_chain(rows: DataFrame, figures: dict[str, list[tuple[str, Column, str]]]) -> DataFrame:
    """(label, pos, step, count, source): survivors after each predicate.

    All chains are counted in one pass. A figure's value is its last count.
    """
    aggs, places = [], []
    for f, (label, steps) in enumerate(figures.items()):
        passed: list[Column] = []
        for s, (step, predicate, source) in enumerate(steps):
            passed.append(F.coalesce(predicate, F.lit(False)))
            aggs.append(F.count_if(reduce(lambda a, b: a & b, passed)).alias(f"c_{f}_{s}"))
            places.append((label, s + 1, step, f"c_{f}_{s}", source))
    counted = rows.agg(*aggs)
    steps = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"), F.lit(pos).cast("bigint").alias("pos"), F.lit(step).alias("step"),
                F.col(c).alias("count"), F.lit(source).alias("source"),
            )
            for label, pos, step, c, source in places
        ]
    )
    return counted.select(F.inline(steps))


def headline_figures(cut: str) -> dict[str, list[tuple[str, Column, str]]]:
    """The published figures over derived tasks. Labels are fixed values."""
    scope = (f"decision on or after {cut}", F.col("inScope"), "step 5")
    state = lambda *names: F.col("finalState").isin(*names)
    # The predicate tests whether any run was accepted; the label says so.
    ever = ("some run was accepted", F.col("ever_accepted"), "step 4")
    return {
        "Accepted": [scope, ever, ("package is in the current bar today", state("accepted"), "step 5")],
        "Legacy accepted": [scope, ever, ("no package at the current bar", state("legacy accepted"), "step 5")],
        "Rejected": [scope, (R.WHY_REJECTED, state("rejected"), "step 5")],
        "No QC decision": [scope, (R.WHY_UNDECIDED, state("error", "no QC decision"), "step 5")],
        "Running": [scope, (R.WHY_RUNNING, state("running"), "step 5")],
        "Carried over": [scope, ("first decided before the cut", F.col("carriedOver"), "step 5")],
        "Awaiting re-gate": [scope, ("in the gate-only folder", F.col("gate_only"), "step 2")],
    }


def vocabulary(rows: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """(field, value, n): each value a filter may offer, with its count."""
    none = F.lit("(none)")
    values = [
        F.struct(F.lit(c).alias("field"), F.array(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), none)).alias("v"))
        for c in scalars
    ] + [
        F.struct(
            F.lit(c).alias("field"),
            F.when(F.size(F.col(c)) > 0, F.col(c).cast("array<string>")).otherwise(F.array(none)).alias("v"),
        )
        for c in lists
    ]
    return (
        rows.select(F.inline(F.array(*values)))
        .select("field", F.explode("v").alias("value"))
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
    )


def duplicate_groups(tasks: DataFrame) -> DataFrame:
    """Groups of in-scope tasks sharing a name and an owner, with their tier."""
    same = lambda c: (F.min(c) == F.max(c)) | F.min(c).isNull()
    return (
        tasks.where("inScope")
        .withColumn("dup_name", F.coalesce(plain_key(F.col("task_name")), F.lit("")))
        .withColumn("dup_owner", F.coalesce("owner", F.lit("")))
        .groupBy("dup_name", "dup_owner")
        .agg(
            F.count("*").alias("members"),
            same("decided_day").alias("same_day"),
            same("finalState").alias("same_state"),
            F.bool_and(F.col("confidence") == "high").alias("all_family_keyed"),
        )
        .where("members > 1")
        .withColumn("tier", F.when(F.col("same_day") & F.col("same_state"), "likely").otherwise("possible"))
    )


def flag_duplicates(tasks: DataFrame) -> DataFrame:
    """Every task, flagged (never merged) when it shares a name and an owner."""
    groups = duplicate_groups(tasks)
    keyed = tasks.withColumn("dup_name", F.coalesce(plain_key(F.col("task_name")), F.lit(""))).withColumn(
        "dup_owner", F.coalesce("owner", F.lit(""))
    )
    hit = F.col("inScope") & F.col("members").isNotNull()
    return keyed.join(groups, ["dup_name", "dup_owner"], "left").select(
        *[F.col(c) for c in tasks.columns],
        hit.alias("possible_duplicate"),
        F.when(hit, F.col("members") - 1).otherwise(0).alias("duplicate_siblings"),
        F.when(hit, F.col("tier")).otherwise("").alias("duplicate_tier"),
        (hit & F.col("same_day")).alias("duplicate_same_day"),
        (hit & F.col("same_state")).alias("duplicate_same_state"),
    )


def partition_counts() -> list[Column]:
    """What the scope's partition is checked on, as aggregates over all tasks; they can be observed on a write."""
    of = lambda name, cond: F.count_if(F.col("inScope") & cond).alias(name)
    state = F.col("finalState")
    return [
        of("headline", state.isin(*R.HEADLINE_STATES)),
        of("undecided", state.isin("error", "no QC decision", "queued")),
        of("in_scope", F.lit(True)),
        of("undeclared_state", ~state.isin(*R.HEADLINE_STATES, *R.UNDECIDED_STATES)),
        of("no_state", state.isNull() | (state == "")),
    ]


def partition_failures(counts: dict[str, int]) -> dict[str, int]:
    """The checks on :func:`partition_counts`, 0 where one holds."""
    off = counts["headline"] + counts["undecided"] != counts["in_scope"]
    return {"partition": int(off), "undeclared_state": counts["undeclared_state"], "no_state": counts["no_state"]}


def reconciled_partition(tasks: DataFrame) -> DataFrame:
    """Headline plus undecided states against the scope, and whether they agree."""
    headline, undecided, in_scope, *_ = partition_counts()
    return tasks.agg(headline, undecided, in_scope).withColumn("reconciles", F.col("headline") + F.col("undecided") == F.col("in_scope"))
