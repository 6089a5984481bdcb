"""Daily series. Rows are counted per day first, so every window runs over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taskweave.functions.names import NAME_RECORDED, NAME_UNKNOWN, batch_order, manifest_task_key, readable_name
from taskweave.operators.figures import preferred_order

from taskweave.operators.lookups import side_by_side
from taskweave.session import numbered


def dense_daily(events: DataFrame, states: list[str]) -> DataFrame:
    """Day by state, zero-filled on the days that occur."""
    per_day = events.where("decided is not null").groupBy("decided").agg(
        *[F.count_if(F.col("state") == s).alias(f"s{i}") for i, s in enumerate(states)]
    )
    cells = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"s{i}").alias("n")) for i, s in enumerate(states)])
    return per_day.select(F.col("decided").alias("day"), F.inline(cells))


def last_n_days(rows: DataFrame, n: int, group: str | None = None) -> DataFrame:
    """The last n calendar days up to the latest day seen, zero-filled (per group)."""
    keys = [group] if group else []
    daily = rows.where("decided is not null").groupBy(*keys, "decided").agg(F.count("*").alias("n"))
    span = daily.groupBy(*keys).agg(F.max("decided").alias("end"))
    days = span.select(*keys, F.explode(F.sequence(F.date_sub("end", n - 1), F.col("end"))).alias("decided"))
    return days.join(daily, [*keys, "decided"], "left").select(*keys, F.col("decided").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def half_change(series: DataFrame) -> DataFrame:
    """Whole-percent change of the later half's daily mean over the earlier half's."""
    latest, first = F.max("day").over(W.partitionBy(F.lit(1))), F.min("day").over(W.partitionBy(F.lit(1)))
    late = F.date_diff("day", F.col("first")) >= F.floor((F.date_diff("last", F.col("first")) + 1) / 2)
    placed = series.select("day", "n", latest.alias("last"), first.alias("first"))
    means = placed.agg(F.avg(F.when(~late, F.col("n"))).alias("earlier"), F.avg(F.when(late, F.col("n"))).alias("later"), F.avg("n").alias("per_day"))
    change = F.floor(F.try_divide((F.col("later") - F.col("earlier")) * 100, F.col("earlier")) + 0.5).cast("bigint")
    return means.select(F.floor(F.col("per_day") + 0.5).cast("bigint").alias("per_day"), change.alias("change"))


def cumulative_cleared(rows: DataFrame) -> DataFrame:
    """Settled per day and the running share of all dated rows."""
    daily = rows.where("decided is not null").groupBy("decided").agg(F.count("*").alias("settled"))
    running = F.sum("settled").over(W.orderBy("decided").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("settled").over(W.orderBy("decided").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return daily.select(F.col("decided").alias("day"), "settled", F.floor(running * 100 / whole + 0.5).cast("bigint").alias("cleared"))


def first_last(rows: DataFrame, group: str, at: Column, who: str) -> DataFrame:
    """First and last of a group by instant, and how many came before the last."""
    order = F.struct(at, F.col("pos"))
    return rows.groupBy(group).agg(
        F.min_by(who, order).alias("first"), F.max_by(who, order).alias("last"), (F.count("*") - 1).alias("before_last")
    )


def manifest_position(rows: DataFrame) -> DataFrame:
    """Position of every package: batch order, then manifest order. ``pos`` is unique.

    Only the columns that the order needs are sorted and stored.
    """
    series, number, text = batch_order(F.col("batch"))
    keyed = rows.select("pos", "batch", series.alias("_s"), number.alias("_n"))
    placed = numbered(keyed, [F.col("_s"), F.col("_n"), F.col("batch"), F.col("pos")])
    return rows.join(placed.select("pos", "position"), "pos")


def select_for_manifest(rows: DataFrame, excluded: DataFrame | None, size: int | None) -> DataFrame:
    """One entry per task: its representative, oldest decision first, the first ``size``.

    ``excluded`` is (id): rows an earlier manifest names; their tasks are left
    out whole. What an entry stands for is in :func:`stands_for`.
    """
    key = manifest_task_key(F.col("package_task"), F.col("cohort_folder"), F.col("name"))
    keyed = rows.select("id", "name", "owner", "state", "decided", "runs", "maybe_delivered", key.alias("key"))
    if excluded is None:
        keyed = keyed.withColumn("out", F.lit(False))
    else:
        keyed = keyed.join(excluded.select("id").distinct().withColumn("_x", F.lit(True)), "id", "left").withColumn("out", F.coalesce("_x", F.lit(False)))
    rep = F.struct("id", "name", "owner", "state", "decided", "runs", "maybe_delivered")
    tasks = keyed.groupBy("key").agg(F.min_by(rep, preferred_order()).alias("r"), F.count("*").alias("stands_for"), F.bool_or("out").alias("out"))
    entries = tasks.where("not out").select("key", "r.*", "stands_for", readable_name(F.col("r.id"), F.col("r.name")).alias("rn"))
    entries = entries.select("*", F.col("rn.name").alias("readable_name"), F.col("rn.source").alias("name_source")).drop("rn", "runs")
    order = [F.col("decided").asc_nulls_first(), F.col("key")]
    chosen = entries if size is None else entries.orderBy(*order).limit(size)
    # Only the order's columns are sorted and stored.
    return chosen.join(numbered(chosen.select("decided", "key"), order).select("key", "position"), "key")


def stands_for(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, id): every row an entry of the manifest stands for."""
    key = manifest_task_key(F.col("package_task"), F.col("cohort_folder"), F.col("name"))
    return rows.select("id", key.alias("key")).join(entries.select("key"), "key", "left_semi")


def selection_arithmetic(rows: DataFrame, excluded: DataFrame | None, entries: DataFrame, size: int | None) -> DataFrame:
    """One row: what was requested, considered, distinct, excluded, available, taken and short by; of
    the entries their owners, the rows they stand for and supersede, those that may be delivered
    already, and those whose name was derived or is not to be recovered.
    """
    key = manifest_task_key(F.col("package_task"), F.col("cohort_folder"), F.col("name"))
    flag = F.lit(False)
    keyed = rows.select("id", key.alias("key"))
    if excluded is not None:
        keyed = keyed.join(excluded.select("id").distinct().withColumn("_x", F.lit(True)), "id", "left")
        flag = F.coalesce("_x", F.lit(False))
    tasks = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(flag).alias("out"))
    whole = tasks.agg(F.sum("n").alias("rows_considered"), F.count("*").alias("distinct_tasks"), F.count_if("out").alias("excluded"))
    taken = entries.agg(
        F.count("*").alias("taken"),
        F.count_distinct(F.nullif(F.col("owner"), F.lit(""))).alias("owners"),
        F.coalesce(F.sum("stands_for"), F.lit(0)).alias("rows_represented"),
        F.coalesce(F.sum(F.col("stands_for") - 1), F.lit(0)).alias("superseded_rows"),
        F.count_if("maybe_delivered").alias("possibly_already_delivered"),
        F.count_if(F.col("name_source") != NAME_RECORDED).alias("names_derived"),
        F.count_if(F.col("name_source") == NAME_UNKNOWN).alias("names_unrecoverable"),
    )
    both = side_by_side(whole, taken)
    available = F.col("distinct_tasks") - F.col("excluded")
    wanted = available if size is None else F.lit(size)
    return both.select("*", F.lit(size).cast("bigint").alias("requested"), available.alias("available"), F.greatest(wanted - F.col("taken"), F.lit(0)).cast("bigint").alias("short_by"))
