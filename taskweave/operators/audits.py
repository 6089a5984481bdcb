"""Audits of families, names and submissions that may be the same work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import name_key


def _instant(c: str = "submitted_at") -> Column:
    return F.coalesce(F.col(c).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))


def _order() -> Column:
    return F.struct(_instant(), F.col("pos"))


def family_key() -> Column:
    return F.coalesce(F.nullif("family_id", F.lit("")), F.concat(F.lit("name:"), name_key(F.col("name"))))


def _hours(first: Column, last: Column) -> Column:
    return F.round((F.unix_micros(last) - F.unix_micros(first)) / 3.6e9, 2)


def contested_families(rows: DataFrame, is_trainer: Column, legacy_before: str) -> DataFrame:
    """Families whose submissions name two or more people, with first and last.

    Each submitter of a family is reduced to the first and last submission before the family
    is; names are counted apart. Several distinct counts beside them would copy every row of
    a task, and sort the copies. Who the people are, with their counts, is :func:`family_people`.
    """
    keyed = rows.select(family_key().alias("family"), "name", "trainer", is_trainer.alias("person"), F.struct(_instant().alias("at"), "pos", "state").alias("sent"))
    each = keyed.groupBy("family", "trainer", "person").agg(F.count("*").alias("n"), F.min("sent").alias("lo"), F.max("sent").alias("hi"))
    who = lambda end: F.struct("trainer", F.col(end)["at"].alias("at"), F.col(end)["state"].alias("state"))
    people = each.groupBy("family").agg(
        F.sum("n").alias("submissions"),
        F.count(F.when(F.col("person"), F.col("trainer"))).alias("trainer_count"),
        F.count(F.when(~F.col("person") & (F.col("trainer") != ""), F.col("trainer"))).alias("machine_submitters"),
        F.min_by(who("lo"), F.when(F.col("person"), F.col("lo"))).alias("f"),
        F.max_by(who("hi"), F.when(F.col("person"), F.col("hi"))).alias("l"),
        F.max("hi").alias("last"),
    )
    names = keyed.groupBy("family").agg(F.count_distinct("name").alias("distinct_names"))
    # Families may be NULL as any key of a group may.
    per = (
        people.withColumnRenamed("family", "_of").join(names, F.col("_of").eqNullSafe(F.col("family")))
        .withColumns({"final_state": F.col("last.state"), "last_any": F.col("last.at")})
    )
    return per.where("submissions >= 2 and trainer_count >= 2").select(
        "family", "submissions", "distinct_names", "trainer_count", "machine_submitters",
        F.when(F.to_date("last_any") >= F.lit(legacy_before).cast("date"), "live").otherwise("legacy").alias("scope"),
        F.col("f.trainer").alias("first_trainer"), F.col("l.trainer").alias("last_trainer"),
        F.col("f.at").alias("first_at"), F.col("l.at").alias("last_at"), F.col("f.state").alias("first_state"), F.col("l.state").alias("last_state"),
        _hours(F.col("f.at"), F.col("l.at")).alias("span_hours"), "final_state",
        (F.col("f.trainer") != F.col("l.trainer")).alias("handover"),
    )


def family_people(rows: DataFrame, is_trainer: Column) -> DataFrame:
    """(family, trainer, submissions) of every person in a family."""
    return rows.where(is_trainer).groupBy(family_key().alias("family"), "trainer").agg(F.count("*").alias("submissions"))


def handovers(rows: DataFrame, contested: DataFrame, is_trainer: Column) -> DataFrame:
    """Contested families whose last submitter is not the first, and what came before."""
    moved = contested.where("handover").select("family", "last_trainer", "last_at", "first_trainer", "final_state")
    accepted = ("accepted", "legacy_accepted")
    before = is_trainer & (F.col("trainer") != F.col("last_trainer")) & (_instant() < F.col("last_at"))
    return (
        rows.withColumn("family", family_key())
        .join(moved, "family")
        .groupBy("family", "first_trainer", "last_trainer", "final_state")
        .agg(
            F.count_if(before).alias("attempts_before"),
            F.count_if(before & F.col("state").isin(*accepted)).alias("_won"),
            F.count_distinct(F.when(before, F.col("trainer"))).alias("uncredited_trainers"),
        )
        .select(
            "family", "first_trainer", "last_trainer", "attempts_before", "uncredited_trainers",
            ((F.col("attempts_before") > 0) & (F.col("_won") == 0)).alias("prior_all_unsuccessful"),
            F.col("final_state").isin(*accepted).alias("ends_accepted"),
        )
    )


def name_collisions(rows: DataFrame, is_trainer: Column) -> DataFrame:
    """One name, two or more families."""
    return (
        rows.groupBy(name_key(F.col("name")).alias("task_name"))
        .agg(
            F.count("*").alias("submissions"),
            F.count_distinct(F.nullif("family_id", F.lit(""))).alias("distinct_families"),
            F.count_distinct(F.when(is_trainer, F.col("trainer"))).alias("distinct_trainers"),
            F.max_by("trainer", _order()).alias("name_keying_credits"),
        )
        .where("distinct_families >= 2")
    )


def fold_listings(rows: DataFrame) -> DataFrame:
    """One row per submission: a decided state outranks error and running."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(r)) for s, r in (("accepted", 0), ("rejected", 1), ("error", 2), ("running", 3))], F.lit(9))
    keys = ["task_id", "run_id", "submitted_at"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, F.col("pos"))).alias("r")).select(*keys, "r.*")


def duplicate_ordering_audit(rows: DataFrame) -> DataFrame:
    """(measure, groups): groups of one name whose order or owner is in doubt."""
    day = F.to_date("submitted_at")
    keyed = rows.withColumn("key", name_key(F.col("name"))).withColumn("at", _instant())
    latest = keyed.groupBy("key").agg(
        F.max("at").alias("last"), F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.count_if(day.isNull()).alias("undated"),
        F.count_distinct(F.when(F.col("trainer").contains("@"), F.col("trainer"))).alias("people"),
    )
    tied = (
        keyed.join(latest.where("n > 1").select("key", "last"), "key").where("at = last")
        .groupBy("key").agg(F.count("*").alias("ties"), F.min("state").alias("lo"), F.max("state").alias("hi"))
    )
    groups = latest.where("n > 1").agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("days") + F.least("undated", F.lit(1)) < F.col("n")).alias("same_day"),
        F.count_if(F.col("people") > 1).alias("contested"),
    )
    ties = tied.where("ties > 1").agg(F.count("*").alias("tied_on_latest"), F.count_if(F.col("lo") != F.col("hi")).alias("tied_and_disagree"))
    return groups.unpivot([], groups.columns, "measure", "groups").unionByName(ties.unpivot([], ties.columns, "measure", "groups"))


def client_acceptance(rows: DataFrame, layer: DataFrame, accepted_priority: str) -> DataFrame:
    """(measure, value, n): priorities, accepted tasks, and rows the layer disputes."""
    priorities = rows.groupBy(F.coalesce(F.nullif("priority", F.lit("")), F.lit("Not set")).alias("value")).agg(F.count("*").alias("n"))
    accepted = rows.where(F.col("priority") == accepted_priority).select("id")
    disputed = symmetric_difference(accepted, layer.select("id"))
    total = lambda df, m: df.agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), F.lit("").alias("value"), "n")
    return priorities.select(F.lit("priority").alias("measure"), "value", "n").unionByName(total(accepted, "accepted")).unionByName(total(disputed, "disagree"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one side only, with the side."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))
