"""Figures over filtered rows: tallies, rates, crosstabs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taskweave.functions.names import NOT_RECORDED, name_key, recorded, truth_task_key
from taskweave.functions.packages import connector_type
from taskweave.functions.runs import UNDECIDED_STATES
from taskweave.operators.filters import collectable
from taskweave.operators.lookups import side_by_side
from taskweave.operators.payouts import percent


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _task_key() -> Column:
    return truth_task_key(F.col("cohort_folder"), F.col("delivered_task"), F.col("name"))


def preferred_order() -> Column:
    """A struct whose minimum is the row shown: latest, most runs, smallest id."""
    day = F.coalesce(F.date_diff(F.col("decided"), F.lit("0001-01-01").cast("date")), F.lit(-1))
    return F.struct((-day).alias("d"), (-F.col("runs")).alias("r"), F.col("id").alias("i"))


def preferred_row(rows: DataFrame, key: Column) -> DataFrame:
    """(key, id) of the row that speaks for each task."""
    return rows.groupBy(key.alias("key")).agg(F.min(preferred_order()).alias("p")).select("key", F.col("p.i").alias("id"))


# How a version was chosen.
CHOSEN_BY_DATE = "decided later than the others"
CHOSEN_BY_RUNS = "got furthest, tied on decision date"
CHOSEN_BY_ID = "tied on date and progress; chosen by identifier"


def collapse_by_task(rows: DataFrame) -> DataFrame:
    """One row per task with its number of versions and why it was chosen.

    Only the first two rows of a task are ranked, and that limit is applied
    before the shuffle. The folded rows are in :func:`other_versions`.
    """
    keyed = rows.select("id", "decided", "runs", _task_key().alias("version_key"))
    order = [F.col("decided").desc_nulls_last(), F.col("runs").desc(), F.col("id")]
    top = keyed.withColumn("rn", F.row_number().over(W.partitionBy("version_key").orderBy(*order))).where("rn <= 2")
    pick = lambda n: F.max(F.when(F.col("rn") == n, F.struct("id", "decided", "runs")))
    shown = top.groupBy("version_key").agg(pick(1).alias("a"), pick(2).alias("b"))
    sizes = keyed.groupBy("version_key").agg(F.count("*").alias("versions"))
    because = (
        F.when(F.col("b").isNull(), F.lit(None).cast("string"))
        .when(~F.col("a.decided").eqNullSafe(F.col("b.decided")), F.lit(CHOSEN_BY_DATE))
        .when(F.col("a.runs") != F.col("b.runs"), F.lit(CHOSEN_BY_RUNS))
        .otherwise(F.lit(CHOSEN_BY_ID))
    )
    return shown.join(sizes, "version_key").select("version_key", F.col("a.id").alias("id"), "versions", because.alias("chosen_because"))


def other_versions(rows: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(version_key, id) of every row a shown row stands for."""
    keyed = rows.select("id", "name", "state", "decided", "runs", _task_key().alias("version_key"))
    shown = collapsed.select("version_key", F.col("id").alias("shown"))
    return keyed.join(shown, "version_key").where("id <> shown").drop("shown")


def task_fold(folders: DataFrame) -> DataFrame:
    """Folders, the distinct tasks they hold, and the folders beyond them."""
    task = F.coalesce(F.concat(F.lit("task:"), name_key(F.col("package_task"))), F.concat(F.lit("folder:"), F.lower("folder")))
    counted = folders.agg(F.count("*").alias("folders"), F.count_distinct(task).alias("tasks"))
    return counted.withColumn("extra_folders", F.col("folders") - F.col("tasks"))


def truth_figures(rows: DataFrame, held: bool = True) -> DataFrame:
    """All headline counts of a selection, as (measure, value).

    Row counts take one aggregate; distinct counts go through one more, below.
    """
    state = lambda *s: F.col("state").isin(*s)
    sent, bar, failed = _yes("delivered"), collectable(), _yes("glm53_failed")
    ready = bar & ~sent & ~failed if held else bar & ~sent
    counts = {
        "accepted": state("accepted"), "legacy_accepted": state("legacy accepted"), "rejected": state("rejected"), "running": state("running"),
        "undecided": state(*UNDECIDED_STATES), "carried_over": _yes("carried_over"), "gate_only": _yes("gate_only"), "at_current_bar": _yes("at_current_bar"),
        "delivered": sent, "connector_tasks": F.col("connector"), "non_connector_tasks": ~F.col("connector"), "connector_unknown": F.col("connector").isNull(),
        "maybe_delivered": _yes("maybe_delivered"), "ready_for_delivery": ready, "accepted_at_bar_rows": bar, "delivered_at_bar_rows": bar & sent,
        "unmerged": _yes("unmerged"), "possible_duplicates": _yes("possible_duplicate"), "likely_duplicates": F.col("duplicate_tier") == "likely",
        "inferred_dates": _yes("decided_inferred"),
    }
    name, task = F.lower(F.trim("name")), F.col("_task")
    distinct = {
        "ready_names": F.when(ready, name), "delivered_names": F.when(sent, name), "delivered_tasks": F.when(sent, task), "ready_tasks": F.when(ready, task),
        "glm53_held_tasks": F.when(bar & ~sent & failed & F.lit(held), task), "glm53_failed_tasks": F.when(~sent & failed, task),
        "accepted_at_bar_tasks": F.when(bar, task), "delivered_at_bar_tasks": F.when(bar & sent, task), "owners": F.nullif("owner", F.lit("")),
    }
    base = rows.withColumn("_task", _task_key())
    flat = base.agg(F.count("*").alias("rows"), *[F.count_if(p).alias(n) for n, p in counts.items()])
    # Distinct counts go through (measure, value) pairs: each value is counted
    # once after a partial aggregate, instead of one expansion per measure.
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("measure"), v.alias("v"))) for n, v in distinct.items()]))
    per_measure = base.select(F.inline(pairs)).distinct().groupBy("measure").agg(F.count("*").alias("value"))
    return flat.unpivot([], flat.columns, "measure", "value").unionByName(per_measure)


def delta_totals(events: DataFrame) -> DataFrame:
    """Per state: tasks, inferred dates, and the busiest day (the earliest of ties)."""
    daily = events.where("decided is not null").groupBy("state", "decided").agg(F.count("*").alias("n"), F.count_if("decided_inferred").alias("i"))
    busiest = F.struct("n", (-F.unix_date("decided")).alias("d"))
    return daily.groupBy("state").agg(
        F.sum("n").alias("tasks"), F.sum("i").alias("inferred"), F.max_by("decided", busiest).alias("peak_day"), F.max("n").alias("peak")
    )


def undated(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("rows"), F.count_if(F.col("decided").isNull()).alias("undated"))


# ------------------------------------------------------------------- deliveries
def verdict_rate(rows: DataFrame) -> DataFrame:
    """Accepted, rejected and pending per batch, and the rate of the decided; All on top."""
    acceptance = lambda a: F.count_if(F.col("acceptance") == a)
    counted = rows.rollup("batch").agg(
        F.count("*").alias("tasks"), acceptance("Accepted").alias("accepted"), acceptance("Rejected").alias("rejected"), F.grouping_id().alias("g")
    )
    decided = F.col("accepted") + F.col("rejected")
    rate = F.when(decided > 0, percent(F.col("accepted"), decided))
    return counted.select(
        F.when(F.col("g") == 1, F.lit("All batches")).otherwise(F.coalesce("batch", F.lit(NOT_RECORDED))).alias("batch"),
        "tasks", "accepted", "rejected", (F.col("tasks") - decided).alias("pending"), rate.alias("rate"),
    )


def category_score_crosstab(rows: DataFrame, scores=("0/4", "1/4", "2/4", "3/4", "4/4")) -> DataFrame:
    """Category by score, with a Not recorded column and the sum of each row."""
    at = lambda s: F.count_if(F.col("score") == s).alias(s.replace("/", "_of_"))
    return rows.groupBy(recorded(F.col("category")).alias("category")).agg(
        *[at(s) for s in scores], F.count_if(F.col("score") == NOT_RECORDED).alias("not_recorded"), F.count("*").alias("sum")
    )


DIMENSIONS = ("category", "score", "batch", "acceptance", "trainer", "difficulty", "type", "priority", "source")


def tally_by(rows: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """(dimension, value, n) of each dimension, a missing value under its own label."""
    pairs = [F.struct(F.lit(d).alias("dimension"), recorded(F.col(d)).alias("value")) for d in dimensions]
    return rows.select(F.inline(F.array(*pairs))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def delivery_summary(rows: DataFrame) -> DataFrame:
    """One row: packages, attributed, contested, coverage, size and trainers."""
    named = F.col("trainer").isNotNull()
    return rows.agg(
        F.count("*").alias("packages"),
        F.count_if(named).alias("attributed"),
        F.count_if(_yes("ambiguous")).alias("contested"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
        F.count_if(F.col("type") == "Connector").alias("connectors"),
        F.count_if(F.col("difficulty") == "Harder").alias("harder"),
        F.count_distinct("trainer").alias("trainers"),
        F.round(F.sum("size_mb"), 2).alias("megabytes"),
        percent(F.count_if(named), F.count("*")).alias("coverage"),
    )


# -------------------------------------------------------------- carried-over work
RUN_BUCKETS = ("2", "3", "4", "5", "6", "7", "8+")
SETTLED = ("accepted", "legacy accepted")


def carried_figures(rows: DataFrame) -> DataFrame:
    """(measure, value): carried-over tasks by what became of them, and their runs.

    The upper median is read off the counts per number of runs. Run counts are
    distinct numbers that add to the rows, so n rows have at most sqrt(2n).
    """
    base = rows.where("carried_over")
    state = lambda s: F.count_if(F.col("state") == s)
    counts = base.agg(
        F.count("*").alias("carried_over"), state("accepted").alias("now_accepted"), state("legacy accepted").alias("legacy_accepted"),
        state("rejected").alias("rejected"), F.count_if(~F.col("state").isin(*SETTLED, "rejected")).alias("unresolved"),
        F.count_if(F.col("runs") >= 5).alias("five_plus"), F.max("runs").cast("bigint").alias("most_runs"),
    )
    per_run = base.groupBy("runs").agg(F.count("*").alias("n"))
    through = F.sum("n").over(W.orderBy("runs").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.orderBy("runs").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    median = (
        per_run.select("runs", through.alias("through"), total.alias("total"))
        .where(F.col("through") > F.floor(F.col("total") / 2))
        .agg(F.min("runs").cast("bigint").alias("median_runs"))
    )
    long = lambda df: df.unpivot([], df.columns, "measure", "value")
    return long(counts).unionByName(long(median))


def carried_runs(rows: DataFrame) -> DataFrame:
    """Histogram of runs, by state."""
    bucket = F.when(F.col("runs") >= 8, F.lit("8+")).otherwise(F.col("runs").cast("string"))
    return rows.where("carried_over").groupBy(bucket.alias("bucket"), "state").agg(F.count("*").alias("n"))


def carried_owners(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Owners by carried-over tasks, with how many are settled; the first ``k`` if a page asks for so many."""
    owners = (
        rows.where("carried_over and owner is not null")
        .groupBy("owner")
        .agg(F.count("*").alias("n"), F.count_if(F.col("state").isin(*SETTLED)).alias("settled"))
        .orderBy(F.col("n").desc(), F.col("settled").desc(), "owner")
    )
    return owners if k is None else owners.limit(k)


def carried_reasons(rows: DataFrame) -> DataFrame:
    """(kind, value, n): why carried-over tasks settled, and the findings on the way."""
    base = rows.where("carried_over")
    why = base.groupBy(F.coalesce("why", F.lit("Not recorded")).alias("value")).agg(F.count("*").alias("n"))
    found = base.select(F.explode("findings").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return why.select(F.lit("why").alias("kind"), "value", "n").unionByName(found.select(F.lit("finding").alias("kind"), "value", "n"))


# ------------------------------------------------------------------ trial scores
def glm_band(trials: DataFrame) -> DataFrame:
    """Per task: strict passes over its trials; a task with no reward read has no row."""
    return (
        trials.groupBy("task")
        .agg(F.count_if(F.col("reward") == 1.0).alias("passes"), F.count("*").alias("trials"), F.count("reward").alias("read"))
        .where("read > 0")
    )


def band_histogram(bands: DataFrame) -> DataFrame:
    return bands.groupBy(F.concat_ws("/", F.col("passes").cast("string"), F.col("trials").cast("string")).alias("band")).agg(F.count("*").alias("tasks"))


def score_fold(runs: DataFrame) -> DataFrame:
    """Per task over its complete runs: fewest passes, all zero, and whether they disagree."""
    done = F.when(F.col("complete") & F.col("passes").isNotNull(), F.col("passes"))
    return runs.groupBy("task").agg(
        F.min(done).alias("passes"),
        F.coalesce(F.max(done) == 0, F.lit(False)).alias("failed"),
        F.coalesce((F.min(done) == 0) & (F.max(done) > 0), F.lit(False)).alias("disagree"),
        F.count("*").alias("runs"),
    )


# ------------------------------------------------------------------ page figures
def makeup_split(rows: DataFrame) -> DataFrame:
    """Connector, not, or unknown, each with how much was declared."""
    kind = connector_type(F.col("connector"), F.col("delivered_type"), F.col("bench"))
    label = F.when(kind, "connector").when(~kind, "non-connector").otherwise("not known")
    declared = F.count_if(F.col("connector").isNotNull())
    return rows.groupBy(label.alias("kind")).agg(
        F.count("*").alias("tasks"), declared.alias("declared"), (F.count("*") - declared).alias("inferred")
    )


def kind_columns(rows: DataFrame) -> DataFrame:
    """Tasks per domain kind; those not recorded are outside the base."""
    kind = F.coalesce(F.nullif("domain_kind", F.lit("")), F.lit("Not recorded"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("tasks")).where("kind <> 'Not recorded'")


FLAGS = {
    "carried over": "carried_over", "awaiting re-gate": "gate_only",
    "possible duplicates": "possible_duplicate", "packages at the bar": "at_current_bar",
}


def flag_rows(rows: DataFrame) -> DataFrame:
    """(flag, decided): one row per flag a task carries; flags overlap."""
    marks = [F.when(_yes(c), F.lit(name)) for name, c in FLAGS.items()]
    return rows.select("decided", F.explode(F.array_compact(F.array(*marks))).alias("flag"))


def flag_cards(rows: DataFrame) -> DataFrame:
    """Per flag: tasks and their share of everything shown.

    The whole is carried through the aggregate as a flag of its own, so the
    rows are read once and nothing is joined.
    """
    marks = [F.when(_yes(c), F.lit(name)) for name, c in FLAGS.items()]
    counted = rows.select(F.explode(F.array_compact(F.array(F.lit("(all)"), *marks))).alias("flag")).groupBy("flag").agg(F.count("*").alias("tasks"))
    whole = F.max(F.when(F.col("flag") == "(all)", F.col("tasks"))).over(W.partitionBy(F.lit(1)))
    return counted.select("flag", "tasks", percent(F.col("tasks"), whole).alias("percent")).where("flag <> '(all)'")


def command_snapshot(folders: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row: folders, distinct tasks, copies, unassigned folders, current evaluations.

    ``folders`` is (name, trainer); ``evaluations`` one row per current cycle.
    """
    counted = folders.agg(
        F.count("*").alias("folders"), F.count_distinct("name").alias("tasks"), F.count_if(F.col("trainer").isNull()).alias("unassigned")
    ).withColumn("duplicates", F.col("folders") - F.col("tasks"))
    current = evaluations.agg(F.count("*").alias("current"))
    return side_by_side(counted, current)


def bench_cards(evaluations: DataFrame, folders: DataFrame) -> DataFrame:
    """Per bench: current tasks, accepted, rate, distinct finalised names, and rank.

    ``evaluations`` is (bench, status); ``folders`` is (bench, name).
    """
    tasks = evaluations.groupBy("bench").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "Accepted").alias("accepted"))
    names = folders.groupBy("bench").agg(F.count_distinct("name").alias("finalised"))
    cards = tasks.join(names, "bench", "full").na.fill(0).withColumn("rate", percent(F.col("accepted"), F.col("tasks")))
    return rank_medals(cards, ["accepted", "tasks"], "bench")


def status_mix(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("bench", "status").agg(F.count("*").alias("n"))


def rank_medals(cards: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Rank of each card. For lists of benches or teams only: the ranking is one task."""
    order = [F.col(c).desc() for c in by] + [F.col(tie)]
    return cards.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))
