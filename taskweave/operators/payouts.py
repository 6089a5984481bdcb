"""Ledger, payments and balances. Money is a count of tasks at one rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators.lookups import side_by_side
from taskweave.sources.tables import RATE


def collapse_ledger(records: DataFrame) -> DataFrame:
    """One payable task per task and person; repeats only ever fill gaps."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("src_row"))).alias(c)
    return records.groupBy(F.lower("task").alias("task_key"), "email").agg(
        F.min_by("task", "src_row").alias("task"),
        F.min_by("valid", "src_row").alias("valid"),
        *[first(c) for c in records.columns if c not in ("task", "email", "src_row", "valid")],
        (F.count("*") - 1).alias("duplicate_rows"),
        F.lit(True).alias("accepted"),
    )


def resolve_payment_owner(requests: DataFrame, cjs: DataFrame) -> DataFrame:
    """The child job decides whom a request paid; the last owner listed for it wins."""
    by_cj = cjs.where("cj is not null").groupBy("cj").agg(F.max_by("email", "row").alias("cj_owner"))
    return requests.join(by_cj, "cj", "left").select(
        F.coalesce("cj_owner", "email").alias("email"),
        F.col("email").alias("tracker_email"),
        F.coalesce(F.col("cj_owner") != F.col("email"), F.lit(False)).alias("email_mismatch"),
        *[c for c in requests.columns if c != "email"],
    )


def people_balance(ledger: DataFrame, paid: DataFrame, requests: DataFrame) -> DataFrame:
    """Per person: listed, accepted, paid and pending tasks, and where the tracker differs."""
    listed = ledger.groupBy("email").agg(F.count("*").alias("listed_tasks"), F.count_if("accepted").alias("accepted_tasks"))
    tracked = requests.groupBy("email").agg(F.count("*").alias("payment_requests"), F.sum("paid_tasks").alias("tracker_tasks"))
    joined = listed.join(paid.select("email", "paid_tasks"), "email", "full").join(tracked, "email", "left").na.fill(0)
    pending = F.greatest(F.col("accepted_tasks") - F.col("paid_tasks"), F.lit(0))
    return joined.select(
        "email", "listed_tasks", "accepted_tasks", "paid_tasks", (F.col("paid_tasks") * RATE).alias("paid_amount"),
        F.least("paid_tasks", "listed_tasks").alias("itemised_paid_tasks"),
        F.greatest(F.col("paid_tasks") - F.col("listed_tasks"), F.lit(0)).alias("unitemised_paid_tasks"),
        "payment_requests", "tracker_tasks", (F.col("tracker_tasks") != F.col("paid_tasks")).alias("tracker_mismatch"),
        pending.alias("pending_tasks"), (pending * RATE).alias("pending_amount"),
    )


def payment_state(ledger: DataFrame, people: DataFrame) -> DataFrame:
    """Ledger tasks with Paid, Not itemised or Not paid, by their person's balance."""
    state = (
        F.when((F.col("paid_tasks") >= F.col("listed_tasks")) & (F.col("paid_tasks") > 0), "Paid")
        .when(F.col("paid_tasks") > 0, "Not itemised")
        .otherwise("Not paid")
    )
    return ledger.join(people.select("email", "paid_tasks", "listed_tasks"), "email", "left").select(*ledger.columns, state.alias("payment_state"))


def ledger_totals(records: DataFrame, ledger: DataFrame, people: DataFrame) -> DataFrame:
    """(measure, value): the totals, and whether they reconcile with the source rows."""
    rows = records.agg(F.count("*").alias("source_rows"))
    tasks = ledger.agg(
        F.count("*").alias("ledger_tasks"), F.sum("duplicate_rows").alias("duplicate_rows"), F.count_if(~F.col("valid")).alias("invalid_tasks")
    )
    sums = ["accepted_tasks", "paid_tasks", "paid_amount", "payment_requests", "itemised_paid_tasks", "unitemised_paid_tasks", "pending_tasks", "pending_amount"]
    money = people.agg(*[F.sum(c).alias(c) for c in sums], F.count_if("tracker_mismatch").alias("tracker_mismatches"))
    long = lambda df: df.unpivot([], [F.col(c).cast("bigint").alias(c) for c in df.columns], "measure", "value")
    return long(rows).unionByName(long(tasks)).unionByName(long(money))


def reconciles(totals: DataFrame) -> DataFrame:
    """Source rows less repeats must be the ledger's tasks."""
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("value")))
    return totals.agg((pick("source_rows") - pick("duplicate_rows") == pick("ledger_tasks")).alias("reconciles"))


def payout_split(ledger: DataFrame, people: DataFrame) -> DataFrame:
    """(email, segment, paid, pending): tasks placed where the records say.

    ``ledger`` carries segment and payment_state; ``people`` carries paid_tasks.
    Paid and unpaid tasks sit in their own segment. Not-itemised tasks are placed
    only when all of a person's lie in one segment, else under ``(unplaced)``,
    with every paid task beyond the ledger.
    """
    state = lambda s: F.count_if(F.col("payment_state") == s)
    leaves = ledger.groupBy("email", "segment").agg(
        state("Paid").alias("itemised"), state("Not paid").alias("unpaid"), state("Not itemised").alias("open")
    )
    totals = leaves.groupBy("email").agg(
        F.sum("itemised").alias("all_itemised"), F.sum("open").alias("all_open"), F.count_if(F.col("open") > 0).alias("open_segments")
    )
    beyond = F.greatest(F.coalesce("paid_tasks", F.lit(0)) - F.coalesce("all_itemised", F.lit(0)), F.lit(0))
    split = (
        people.select("email", "paid_tasks")
        .join(totals, "email", "left")
        .withColumn("open_paid", F.least(beyond, F.coalesce("all_open", F.lit(0))))
        .withColumn("extra", F.greatest(beyond - F.col("open_paid"), F.lit(0)))
        .withColumn("one_place", F.coalesce(F.col("open_segments") == 1, F.lit(False)))
    )
    here = F.col("one_place") & (F.col("open") > 0)
    placed = leaves.join(split.select("email", "open_paid", "all_open", "one_place"), "email").select(
        "email", "segment",
        (F.col("itemised") + F.when(here, F.col("open_paid")).otherwise(0)).alias("paid"),
        (F.col("unpaid") + F.when(here, F.col("all_open") - F.col("open_paid")).otherwise(0)).alias("pending"),
    )
    spread = ~F.col("one_place") & (F.coalesce("all_open", F.lit(0)) > 0)
    unplaced = split.select(
        "email", F.lit("(unplaced)").alias("segment"),
        (F.col("extra") + F.when(spread, F.col("open_paid")).otherwise(0)).alias("paid"),
        F.when(spread, F.col("all_open") - F.col("open_paid")).otherwise(0).alias("pending"),
    )
    return placed.unionByName(unplaced).where("paid > 0 or pending > 0")


def bench_of_segment(segment: Column) -> Column:
    return F.when(segment.startswith("company"), "company").when(segment.startswith("computer"), "computer").otherwise("unassigned")


def money_by(split: DataFrame, bucket: Column, name: str) -> DataFrame:
    """Paid and pending money per bucket; the buckets add to the whole."""
    return split.groupBy(bucket.alias(name)).agg(
        F.sum("paid").alias("paid_tasks"), F.sum("pending").alias("pending_tasks"), (F.sum("paid") * RATE).alias("paid"),
        (F.sum("pending") * RATE).alias("pending"), F.count_distinct("email").alias("people"),
    )


def payout_rows(roster: DataFrame, ledger: DataFrame, paid: DataFrame) -> DataFrame:
    """Roster rows with accepted, paid and pending tasks and money."""
    accepted = ledger.where("accepted").groupBy("email").agg(F.count("*").alias("accepted_tasks"))
    sums = paid.groupBy("email").agg(F.sum("paid_tasks").alias("paid_tasks"), F.sum("paid_amount").alias("paid_amount"))
    rows = roster.join(accepted, "email", "left").join(sums, "email", "left").na.fill(0, ["accepted_tasks", "paid_tasks", "paid_amount"])
    pending = F.greatest(F.col("accepted_tasks") - F.col("paid_tasks"), F.lit(0))
    return rows.withColumn("pending_tasks", pending).withColumn("pending_amount", pending * RATE)


def bench_shares(ledger: DataFrame) -> DataFrame:
    """Per person: the share of accepted tasks on each bench; unassigned when on none."""
    on = lambda b: F.count_if(F.col("accepted") & (F.col("bench") == b))
    total = F.col("on_company") + F.col("on_computer")
    return (
        ledger.groupBy("email").agg(on("company").alias("on_company"), on("computer").alias("on_computer"))
        .select("email", F.coalesce(F.try_divide("on_company", total), F.lit(0.0)).alias("company"),
                F.coalesce(F.try_divide("on_computer", total), F.lit(0.0)).alias("computer"), F.when(total > 0, 0.0).otherwise(1.0).alias("unassigned"))
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up; 0 of nothing is 0."""
    return F.coalesce(F.floor(F.try_divide(part * 100, whole) + 0.5), F.lit(0)).cast("bigint")


def team_scorecard(rows: DataFrame) -> DataFrame:
    """Per team: accepted work, money, people and settlement."""
    team = F.coalesce(F.nullif("team", F.lit("")), F.lit("Unassigned"))
    return (
        rows.groupBy(team.alias("team"))
        .agg(
            F.sum("accepted_tasks").alias("accepted"), F.sum("paid_amount").alias("paid"), F.sum("pending_amount").alias("owed"),
            F.count_if(F.lower("status") == "active").alias("active"), F.count_distinct("manager").alias("managers"), F.count("*").alias("people"),
        )
        .withColumn("settled", percent(F.col("paid"), F.col("paid") + F.col("owed")))
    )


def payout_summary(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: accepted, paid and upcoming work, people, and the request days."""
    days = requests.agg(F.count("*").alias("requests"), F.min("requested_on").alias("first_request"), F.max("requested_on").alias("last_request"))
    money = rows.agg(
        F.sum("accepted_tasks").alias("accepted_tasks"), F.sum("paid_tasks").alias("paid_tasks"), F.sum("paid_amount").alias("paid"), F.sum("pending_amount").alias("upcoming"),
        F.count_if((F.col("accepted_tasks") > 0) | (F.col("paid_tasks") > 0)).alias("people"),
    ).withColumn("settled", percent(F.col("paid"), F.col("paid") + F.col("upcoming")))
    return side_by_side(money, days)


def team_money(rows: DataFrame) -> DataFrame:
    team = F.coalesce(F.nullif("team", F.lit("")), F.lit("Unassigned"))
    return (
        rows.where("paid_amount > 0 or pending_amount > 0").groupBy(team.alias("team"))
        .agg(F.sum("paid_amount").alias("paid"), F.sum("pending_amount").alias("owed"), F.count("*").alias("people"))
        .orderBy((F.col("paid") + F.col("owed")).desc(), "team")
    )


def ledger_strip(ledger: DataFrame) -> DataFrame:
    """Tasks per payment state, invalid tasks and folded rows."""
    state = lambda s: F.count_if(F.col("payment_state") == s)
    return ledger.agg(
        F.count("*").alias("tasks"), state("Paid").alias("paid"), state("Not itemised").alias("not_itemised"), state("Not paid").alias("not_paid"),
        F.count_if(~F.col("valid")).alias("invalid"), F.sum("duplicate_rows").alias("folded_rows"),
    )


def roster_summary(trainers: DataFrame, current: DataFrame, historical: DataFrame) -> DataFrame:
    """(measure, key, n): active and total trainers, and status and team counts."""
    counts = trainers.agg(F.count_if(F.lower("status") == "active").alias("active"), F.count("*").alias("total"))
    long = counts.unpivot([], ["active", "total"], "key", "n").select(F.lit("trainers").alias("measure"), "key", "n")
    status = current.select("status").unionByName(historical.select("status")).groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("Unknown")).alias("key"))
    teams = trainers.groupBy(F.coalesce(F.nullif("team", F.lit("")), F.lit("Unassigned")).alias("key"))
    named = lambda g, m: g.agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), "key", "n")
    return long.unionByName(named(status, "status")).unionByName(named(teams, "team"))


def plan_vs_actual(plan: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Planned, done and share per bench inside a range of days."""
    kept = plan
    if start:
        kept = kept.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        kept = kept.where(F.col("day") <= F.lit(end).cast("date"))
    return kept.groupBy("bench").agg(F.sum("plan").alias("planned"), F.sum("actual").alias("done")).withColumn("share", F.try_divide("done", F.col("planned")))
