"""Invariants a build must hold before anything is published.

Each check returns rows that can be unioned: (check, failures, detail count).
``failures`` is 0 when the check holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taskweave.functions import runs as R


def _check(df: DataFrame, **failures: Column) -> DataFrame:
    counted = df.agg(*[c.cast("bigint").alias(n) for n, c in failures.items()])
    return counted.unpivot([], list(failures), "check", "failures")


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def check_partition(tasks: DataFrame, declared=R.HEADLINE_STATES + R.UNDECIDED_STATES) -> DataFrame:
    """Every state is declared, and every row has exactly one."""
    return _check(
        tasks,
        undeclared_state=F.count_if(~F.col("state").isin(*declared)),
        no_state=F.count_if(_missing("state")),
    )


def check_scope(tasks: DataFrame, cut: str) -> DataFrame:
    """Rows decided before the cut; inferred dates are reported beside it."""
    early = ~F.coalesce(F.col("decided") >= F.lit(cut).cast("date"), F.lit(False))
    return tasks.agg(
        F.count_if(early).alias("before_cut"),
        F.count_if("decided_inferred").alias("inferred_dates"),
        F.count("*").alias("rows"),
    )


def check_chains(chains: DataFrame, values: DataFrame) -> DataFrame:
    """Per figure: steps that grow, and whether the last count is the value.

    Steps marked ``fan_out`` multiply rows by design and may grow.
    """
    order = W.partitionBy("label").orderBy("pos")
    grows = (F.col("count") > F.lag("count").over(order)) & ~F.col("fan_out")
    return (
        chains.withColumn("_grows", grows)
        .groupBy("label")
        .agg(
            F.count_if("_grows").alias("growing_steps"),
            F.max_by("count", "pos").alias("ends_at"),
        )
        .join(values, "label", "left")
        .select("label", "growing_steps", "ends_at", (F.col("ends_at") == F.col("value")).alias("ends_at_value"))
    )


def check_figures_match_rows(figures: DataFrame, tasks: DataFrame) -> DataFrame:
    """Published figures against counts taken again from the rows."""
    recount = tasks.where("inScope").groupBy(F.col("finalState").alias("state")).agg(F.count("*").alias("rows"))
    return figures.join(recount, "state", "left").select(
        "label", "value", F.coalesce("rows", F.lit(0)).alias("rows"),
        (F.col("value") == F.coalesce("rows", F.lit(0))).alias("agrees"),
    )


def check_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_sums(counts: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Whether the parts of each row add up to its total."""
    added = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return counts.withColumn("adds_up", added == F.col(total))


def check_provenance(tasks: DataFrame, prefix: str) -> DataFrame:
    """Rows that cite no verdict object, no rule or no canonical reason."""
    return _check(
        tasks,
        no_source=F.count_if(~F.coalesce(F.col("source").startswith(prefix), F.lit(False))),
        no_why=F.count_if(_missing("why")),
        no_canonical_reason=F.count_if(_missing("canonical_reason")),
    )


def check_vocabulary(offered: DataFrame, used: DataFrame) -> DataFrame:
    """Values offered but absent, and present but not offered."""
    absent = offered.select("value").exceptAll(used.select("value").distinct()).where("value <> '(none)'")
    unoffered = used.select("value").distinct().exceptAll(offered.select("value"))
    return absent.withColumn("problem", F.lit("offered but absent")).unionByName(
        unoffered.withColumn("problem", F.lit("present but not offered"))
    )


def check_orphans(claims: DataFrame, packages: DataFrame) -> DataFrame:
    """Keys of rows that claim a package the listing does not hold."""
    return claims.select("key").distinct().join(packages.select("key"), "key", "left_anti")


def stale_index(built_for: DataFrame, current: DataFrame) -> DataFrame:
    """Indexes built for another version than the current one, per ``index``."""
    return built_for.join(current, "index", "left").select(
        "index", F.coalesce(F.col("built_for") != F.col("current"), F.lit(True)).alias("stale")
    )


def holds(checks: DataFrame) -> bool:
    """Whether every check of a (check, failures) frame holds."""
    return checks.where("failures > 0").isEmpty()
