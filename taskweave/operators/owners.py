"""Who made a package: routes, sheets, reviews and the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import NOT_RECORDED, SPELLING_STEPS, bare_name, bench_key, is_person, name_variants, plain_key, tracker_key, with_underscores
from taskweave.operators.lookups import dealt, one_person, person_of, spellings

# The label of each route and source.
ROUTE_LABELS = {"object": "GCS package owner", "records": "GCS trainer records", "verdict": "GCS verdict owner"}
UNATTRIBUTED = "unattributed"
FROM_SHEET = "Trainer credit sheet"
FROM_REVIEW = "Trainer review"
FROM_VERDICTS = "GCS verdict owner"
CONTESTED_OWNER = "Contested owner"
FROM_CONSOLE = "Harbor Console submitter"
NAME_ONLY = "Name match only"
NO_RECORD = "No trainer record"


def _people(df: DataFrame, name: str, who: str) -> DataFrame:
    return df.where(is_person(F.col(who))).select(bench_key(F.col(name)).alias("key"), F.col(who).alias("person"))


def owner_candidates(df: DataFrame, name: str, who: str) -> DataFrame:
    """(key, person): everyone a contested name stands for, one row each."""
    return _people(df, name, who).distinct()


def owner_waterfall(rows: DataFrame, folders: DataFrame, records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, state, route, trainer, source): the first route that names anyone decides.

    Package owner, then trainer records, then verdict owner. One person is the
    trainer; several make the row contested.
    """
    by_object = folders.groupBy(F.col("sha256").alias("source_object")).agg(F.max_by(F.struct("owner", "owner_contested"), "pos").alias("f"))
    keyed = rows.select("id", F.explode(spellings(bench_key(F.col("task")), bench_key(F.col("package_name")))).alias("key"))
    by_record = one_person(keyed, "id", _people(records, "task", "trainer"))
    by_verdict = one_person(keyed, "id", _people(verdicts, "name", "owner"))
    joined = (
        rows.select("id", "source_object")
        .join(by_object, "source_object", "left")
        .join(by_record.select("id", F.col("person").alias("p1"), F.col("named").alias("n1")), "id", "left")
        .join(by_verdict.select("id", F.col("person").alias("p2"), F.col("named").alias("n2")), "id", "left")
    )
    own = F.when(is_person(F.col("f.owner")) & ~F.coalesce("f.owner_contested", F.lit(False)), F.col("f.owner"))
    route = F.when(own.isNotNull(), "object").when(F.col("n1") != "none", "records").when(F.col("n2") != "none", "verdict")
    trainer = F.when(route == "object", own).when(route == "records", F.col("p1")).otherwise(F.col("p2"))
    state = F.when(route.isNull(), UNATTRIBUTED).when(trainer.isNotNull(), "attributed").otherwise("contested")
    label = F.when(state == "contested", F.lit("Contested")).otherwise(
        F.coalesce(*[F.when(route == r, F.lit(v)) for r, v in ROUTE_LABELS.items()])
    )
    return joined.select("id", state.alias("state"), route.alias("route"), F.when(route.isNotNull(), trainer).alias("trainer"), label.alias("source"))


def _missing(trainer: Column) -> Column:
    return trainer.isNull() | (F.lower(F.trim(trainer)) == UNATTRIBUTED) | (trainer == "")


def fill_owner_if_unique(audit: DataFrame, truth: DataFrame) -> DataFrame:
    """Missing or contested owners, filled when the tasks name exactly one person."""
    owners = truth.where("owner <> ''").select(plain_key(F.col("name")).alias("key"), F.col("owner").alias("person"))
    found = one_person(audit.select("id", plain_key(F.col("task")).alias("key")), "id", owners)
    wanted = _missing(F.col("trainer")) | F.col("ambiguous") | (F.col("source") == "Contested")
    outcome = (
        F.when(~wanted, "untouched").when(F.col("named").isNull(), "not in pipeline").when(F.col("named") == "one", "resolved").otherwise("still ambiguous")
    )
    return audit.join(found, "id", "left").select(
        "id",
        F.when(outcome == "resolved", F.col("person")).otherwise(F.col("trainer")).alias("trainer"),
        F.when(outcome == "resolved", F.lit(FROM_VERDICTS)).otherwise(F.col("source")).alias("source"),
        outcome.alias("outcome"),
    )


def attribute_folders(scan: DataFrame, records: DataFrame) -> DataFrame:
    """Folder owner by declared name: one match, contested, or unattributed."""
    people = records.where("task <> ''").select(
        F.replace(plain_key(F.col("task")), F.lit("harbor/"), F.lit("")).alias("key"), F.col("trainer").alias("person")
    )
    key = plain_key(F.coalesce(F.nullif("declared_short", F.lit("")), "folder"))
    found = one_person(scan.select("pos", key.alias("key")), "pos", people)
    basis = F.when(F.col("named") == "one", "name match").when(F.col("named") == "several", "contested").otherwise("unattributed")
    return scan.join(found, "pos", "left").select("pos", F.col("person").alias("owner"), (F.coalesce("named", F.lit("")) == "several").alias("owner_contested"), basis.alias("owner_basis"))


# ------------------------------------------------------------ sheet and reviews
def sheet_people(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, person, named) of each delivered row that the credit sheet knows under any of its names.

    Spellings are made once per distinct name and folded to its smallest and largest person;
    rows then meet names, six at most, and not all spellings.
    """
    parts = F.filter(F.split("source_uri", "/"), lambda p: p != "")
    names = spellings(
        F.col("task"), F.col("package_name"), F.col("source_folder"), F.substring_index("package_path", "/", -1),
        F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2),
    )
    tracked = F.array_compact(F.array(tracker_key(F.col("package_name")), tracker_key(F.col("source_folder"))))
    per_key = entries.groupBy("key").agg(F.min("person").alias("lo"), F.max("person").alias("hi"))
    each = rows.select("id", F.explode(names).alias("n"))
    distinct = each.select(F.col("n").alias("id"), "n").distinct()
    by_name = variant_rows(distinct).join(dealt(per_key, "key"), "key").groupBy(F.col("id").alias("n")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_key = rows.select("id", F.explode(tracked).alias("key")).join(per_key, "key")
    met = each.join(dealt(by_name, "n"), "n").select("id", "lo", "hi").unionByName(by_key.select("id", "lo", "hi"))
    return person_of(met.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "id")


def variant_rows(names: DataFrame) -> DataFrame:
    """(id, key): every spelling of each (id, n), each step bound to a column."""
    based = names.select("id", bare_name(F.col("n")).alias("v")).where("v <> 'none'")
    steps = based.select("id", F.explode(with_underscores(F.col("v"))).alias("x"))
    for name, base, step in SPELLING_STEPS:
        steps = steps.withColumn(name, step(F.col(base)))
    every = F.array_distinct(F.array("x", *[name for name, _, _ in SPELLING_STEPS]))
    return steps.select("id", F.explode(every).alias("key")).where(F.length("key") > 6)


def sheet_entries(sheet: DataFrame) -> DataFrame:
    """(key, person) of each sheet row; a row may name nobody."""
    who = F.when(is_person(F.col("trainer")), F.lower("trainer"))
    return sheet.select(F.explode(name_variants(F.col("sheet_name"))).alias("key"), who.alias("person"))


def sheet_trainer(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The sheet's trainer where it names one person: fills gaps, replaces for Company Bench."""
    # A named row of another bench keeps its trainer whatever the sheet says.
    open_rows = rows.where(_missing(F.col("trainer")) | F.coalesce(F.col("bench") == "company", F.lit(False)))
    found = sheet_people(open_rows, entries)
    named = ~_missing(F.col("trainer"))
    takes = (F.col("named") == "one") & (~named | ((F.col("bench") == "company") & (F.lower("trainer") != F.col("person"))))
    takes = F.coalesce(takes, F.lit(False))
    return rows.join(found, "id", "left").select(
        "id",
        F.when(takes, F.col("person")).otherwise(F.when(named, F.col("trainer"))).alias("trainer"),
        F.when(takes, F.lit(FROM_SHEET)).otherwise(F.col("source")).alias("source"),
        F.when(takes & named, F.col("trainer")).alias("bucket_trainer"),
        takes.alias("from_sheet"),
    )


def sheet_coverage(rows: DataFrame, entries: DataFrame, owners: DataFrame) -> DataFrame:
    """(bench, state, outcome, n): what the sheet settles. ``owners`` is (id, state, trainer)."""
    found = sheet_people(rows, entries)
    joined = rows.select("id", "bench").join(owners.select("id", "state", F.col("trainer").alias("owner")), "id", "left").join(found, "id", "left")
    settled = F.col("state") == "attributed"
    open_outcome = (
        F.when(F.col("named") == "one", "filled").when(F.col("named") == "several", "sheet names several")
        .when(F.col("named") == "none", "sheet row with no trainer").otherwise("not in the sheet")
    )
    differs = settled & (F.col("named") == "one") & (F.col("person") != F.lower("owner"))
    outcome = F.when(~settled, open_outcome).when(differs & (F.col("bench") == "company"), "replaced").when(differs, "sheet disagrees")
    return (
        joined.withColumn("state", F.coalesce("state", F.lit(UNATTRIBUTED)))
        .withColumn("outcome", outcome)
        .where("outcome is not null")
        .groupBy("bench", "state", "outcome")
        .agg(F.count("*").alias("n"))
    )


def review_override(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """A hand review of (batch, task or package) decides; it may say there is no trainer."""
    entry = F.struct("trainer", "trainer_type", "confidence")
    by_task = reviews.select("batch", bench_key(F.col("task")).alias("k1"), entry.alias("r1"))
    by_package = reviews.select("batch", bench_key(F.col("task")).alias("k2"), entry.alias("r2"))
    review = F.coalesce("r1", "r2")
    joined = (
        rows.withColumn("k1", bench_key(F.col("task"))).withColumn("k2", bench_key(F.col("package_name")))
        .join(by_task, ["batch", "k1"], "left").join(by_package, ["batch", "k2"], "left")
    )
    named = ~_missing(F.col("trainer"))
    return joined.select(
        "id",
        F.coalesce(review["trainer"], F.when(named, F.col("trainer"))).alias("trainer"),
        F.when(review["trainer"].isNotNull(), F.lit(FROM_REVIEW)).otherwise(F.col("source")).alias("source"),
        F.when(review.isNotNull() & review["trainer"].isNull(), F.coalesce(review["trainer_type"], F.lit("no trainer"))).alias("reviewed_no_trainer"),
        F.when(review["trainer"].isNotNull() & named & (F.lower("trainer") != review["trainer"]), F.col("trainer")).alias("bucket_trainer"),
    )


def client_feedback(rows: DataFrame, feedback: DataFrame) -> DataFrame:
    """The client's decision for that batch's copy; the last feedback row wins."""
    last = (
        feedback.where(F.col("acceptance").isin("Accepted", "Rejected"))
        .groupBy("batch", bench_key(F.col("task")).alias("k"))
        .agg(F.max_by(F.struct("acceptance", "priority"), "pos").alias("d"))
    )
    first = last.select("batch", F.col("k").alias("k1"), F.col("d").alias("d1"))
    second = last.select("batch", F.col("k").alias("k2"), F.col("d").alias("d2"))
    hit = F.coalesce("d1", "d2")
    return (
        rows.withColumn("k1", bench_key(F.col("task"))).withColumn("k2", bench_key(F.col("package_name")))
        .join(first, ["batch", "k1"], "left").join(second, ["batch", "k2"], "left")
        .select("id", F.coalesce(hit["acceptance"], F.col("acceptance")).alias("acceptance"),
                F.coalesce(F.nullif(hit["priority"], F.lit("")), F.col("priority")).alias("priority"), hit.isNotNull().alias("judged"))
    )


def merge_deliveries(audit: DataFrame, drive: DataFrame, company_share: DataFrame) -> DataFrame:
    """Audited rows plus the rows of batches the audit does not cover.

    ``company_share`` is (batch, key): audited packages filed as Company Bench.
    """
    share = company_share.select("batch", "key").distinct().withColumn("shared", F.lit(True))
    audited = (
        audit.withColumn("key", bench_key(F.col("task"))).join(share, ["batch", "key"], "left")
        .withColumn("bench", F.when(F.col("shared"), F.lit("company")).otherwise(F.col("bench"))).select(*audit.columns)
    )
    return audited.withColumn("from_manifest", F.lit(False)).unionByName(
        uncovered(audit, drive).withColumn("from_manifest", F.lit(True)), allowMissingColumns=True
    )


def uncovered(audit: DataFrame, drive: DataFrame) -> DataFrame:
    """Drive rows of batches that the audit lacks."""
    return drive.join(audit.select("batch").distinct(), "batch", "left_anti")


# --------------------------------------------------------------------- console
def console_latest(console: DataFrame) -> DataFrame:
    """Latest submission per declared task; rows without a name are left out."""
    instant = F.coalesce(F.col("submitted_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    return (
        console.withColumn("key", bench_key(F.col("name")))
        .where("key <> ''")
        .groupBy("key")
        .agg(F.max_by(F.struct("pos", "state", "submitted_at", "trainer", "failed_stage", "task_type", "accepted_folders"), F.struct(instant, -F.col("pos"))).alias("c"))
        .select("key", "c.*")
    )


def console_owners(console: DataFrame) -> DataFrame:
    """(key, owner, contested) over the four name fields of a submission."""
    fields = ("name", "task_id", "family_id", "run_id")
    keys = spellings(*[bench_key(F.col(f)) for f in fields])
    return (
        console.where(F.col("trainer").contains("@")).select(F.explode(keys).alias("key"), F.lower("trainer").alias("who"))
        .groupBy("key").agg(F.min("who").alias("lo"), F.max("who").alias("hi"))
        .select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("owner"), (F.col("lo") != F.col("hi")).alias("contested"))
    )


def bench_of_team(team: Column) -> Column:
    return F.when(team == "Company", "company").when(team.isin("Computer A", "Computer B"), "computer").otherwise("unassigned")


def _squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def finalisation_owner(folders: DataFrame, roster: DataFrame, owners: DataFrame) -> DataFrame:
    """Folder owner: console submitter, else the scan's owner, else a unique alias.

    ``owners`` is (key, owner) from the console, unambiguous names only.
    """
    trainers = roster.groupBy(F.lower("email").alias("email")).agg(F.max("team").alias("team"))
    aliases = (
        roster.select(F.lower("email").alias("email"), F.explode(spellings(_squash(F.col("name")), _squash(F.substring_index("email", "@", 1)))).alias("alias"))
        .groupBy("alias").agg(F.min("email").alias("lo"), F.max("email").alias("hi")).where("lo = hi").select("alias", F.col("lo").alias("alias_email"))
    )
    k1 = bench_key(F.coalesce("declared_short", "folder"))
    k2 = bench_key(F.col("declared_name"))
    console = owners.where("owner is not null").select("key", "owner")
    base = (
        folders.select("pos", "owner", "owner_contested", k1.alias("k1"), k2.alias("k2"))
        .join(console.select(F.col("key").alias("k1"), F.col("owner").alias("o1")), "k1", "left")
        .join(console.select(F.col("key").alias("k2"), F.col("owner").alias("o2")), "k2", "left")
        .withColumn("from_console", F.coalesce("o1", "o2"))
        .withColumn("email", F.lower(F.coalesce("from_console", "owner")))
        .withColumn("alias", F.when(F.col("from_console").isNull(), _squash(F.col("owner"))))
        .join(trainers, "email", "left")
        .join(aliases, "alias", "left")
        .join(trainers.select(F.col("email").alias("alias_email"), F.col("team").alias("alias_team")), "alias_email", "left")
    )
    contested = F.col("owner_contested") & F.col("from_console").isNull()
    team = F.when(~contested, F.coalesce("team", "alias_team"))
    linked = team.isNotNull()
    return base.select(
        "pos",
        F.col("email").alias("owner"),
        F.when(contested, "conflict").when(linked, "linked").when(F.col("email").isNotNull(), "unlinked").otherwise("missing").alias("ownership"),
        F.when(contested, F.lit(CONTESTED_OWNER)).when(F.col("from_console").isNotNull(), F.lit(FROM_CONSOLE))
        .when(F.col("owner").isNotNull(), F.lit(NAME_ONLY)).otherwise(F.lit(NO_RECORD)).alias("attribution"),
        bench_of_team(team).alias("bench"),
    )


# How the console's states are shown, and where legacy ends.
CONSOLE_STATUS = {
    "accepted": "Accepted", "rejected": "Rejected", "error": "Failed", "running": "Running",
    "queued": "Queued", "legacy_accepted": "Legacy accepted",
}


def console_status(state: Column) -> Column:
    named = F.coalesce(*[F.when(state == s, F.lit(v)) for s, v in CONSOLE_STATUS.items()])
    return F.coalesce(named, F.nullif(F.concat(F.upper(F.substring(state, 1, 1)), state.substr(F.lit(2), F.length(state))), F.lit("")), F.lit("Unknown"))


def console_evidence(console: DataFrame, cycles: DataFrame, folders: DataFrame, roster: DataFrame, legacy_before: str) -> DataFrame:
    """One row per task: the console's status, with ledger and bucket evidence beside it.

    ``cycles`` is (task, status, attempt); ``folders`` is (name, archives). The
    ledger is evidence: where no cycle has the console's status, ``disagrees``.
    """
    latest = console_latest(console).withColumn("status", console_status(F.col("state"))).withColumn("email", F.nullif(F.lower("trainer"), F.lit("")))
    attempts = console.groupBy(bench_key(F.col("name")).alias("key")).agg(F.count("*").alias("submissions"))
    keyed = cycles.withColumn("key", bench_key(F.col("task"))).where("key <> ''")
    ledger = keyed.groupBy("key").agg(
        F.count("*").alias("cycles"), F.max("attempt").alias("attempts"), F.count("status").alias("statuses")
    )
    agreeing = keyed.where("status is not null").select("key", "status").distinct().withColumn("agrees", F.lit(True))
    bucket = folders.groupBy(bench_key(F.col("name")).alias("key")).agg(F.count("*").alias("folders"), F.sum("archives").alias("archives"))
    people = roster.groupBy(F.lower("email").alias("email")).agg(F.max("team").alias("team"))
    return (
        latest.join(attempts, "key").join(ledger, "key", "left").join(agreeing, ["key", "status"], "left").join(bucket, "key", "left").join(people, "email", "left")
        .select(
            "key", "status", F.to_date("submitted_at").alias("day"),
            (F.col("submitted_at").isNull() | (F.to_date("submitted_at") < F.lit(legacy_before).cast("date"))).alias("legacy"),
            F.col("email").alias("owner"), F.col("team").isNotNull().alias("on_roster"), bench_of_team(F.col("team")).alias("bench"),
            F.coalesce("task_type", F.lit("Not recorded")).alias("task_type"), "submissions",
            F.coalesce("cycles", F.lit(0)).alias("cycles"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
            ((F.coalesce("statuses", F.lit(0)) > 0) & F.col("agrees").isNull()).alias("disagrees"),
            F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("archives", F.lit(0)).alias("archives"),
        )
    )


def console_statuses(console: DataFrame, kept: DataFrame, scope: Column) -> DataFrame:
    """(unit, status, n): tasks by status, submissions by status, and repeat tasks.

    ``kept`` is (key, status) of the tasks shown; ``scope`` selects submissions.
    """
    subs = (
        console.withColumn("key", bench_key(F.col("name"))).where(scope).join(kept.select("key"), "key", "left_semi")
        .select("key", console_status(F.col("state")).alias("status"))
    )
    repeats = subs.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    count = lambda df, unit: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(unit).alias("unit"), "status", "n")
    return count(kept, "task").unionByName(count(subs, "submission")).unionByName(
        repeats.select(F.lit("repeat tasks").alias("unit"), F.lit("").alias("status"), "n")
    )


# ----------------------------------------------------------- evaluation cycles
def latest_per_family(cycles: DataFrame) -> DataFrame:
    """Latest evaluation per owner and family; a cycle without either key is an error."""
    family = F.coalesce(F.nullif("family_id", F.lit("")), F.nullif("task_id", F.lit("")))
    stable = F.when(family.isNull(), F.raise_error(F.lit("evaluation lacks a stable task identity")).cast("string")).otherwise(family)
    rest = [c for c in cycles.columns if c != "owner_key"]
    return (
        cycles.withColumn("_family", stable)
        .groupBy("owner_key", "_family")
        .agg(F.max_by(F.struct(*rest), F.struct("sequence", "submitted_on", "attempt", "id")).alias("c"))
        .select("owner_key", F.col("_family").alias("family"), "c.*")
    )


def unique_runs(cycles: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs with exact copies folded, keys whose copies differ)."""
    folded = cycles.distinct()
    clashes = folded.groupBy(*keys).agg(F.count("*").alias("versions")).where("versions > 1")
    return folded, clashes


def cohort_totals(folders: DataFrame) -> DataFrame:
    """Tasks per cohort by outcome, and over all; a cohort that is not recorded is one of its own."""
    outcome = lambda o: F.count_if(F.col("outcome") == o)
    return folders.rollup("cohort").agg(
        F.count("*").alias("tasks"), outcome("accepted").alias("accepted"), outcome("rejected").alias("rejected"),
        outcome("unsubmitted").alias("unsubmitted"), outcome("promoted").alias("promoted"),
        F.count_if(F.col("outcome").isin("accepted", "rejected")).alias("graded"), F.sum("archives").alias("archives"), F.grouping_id().alias("g"),
    ).withColumn("cohort", F.when(F.col("g") == 1, F.lit("All")).otherwise(F.coalesce("cohort", F.lit(NOT_RECORDED)))).drop("g")


def finalisation_duplicates(folders: DataFrame) -> DataFrame:
    """Each folder: whether a newer archive represents its task, and the group's size."""
    key = bench_key(F.coalesce("declared_short", "folder"))
    groups = folders.groupBy(key.alias("name")).agg(
        F.max_by("pos", F.struct("updated", -F.col("pos"))).alias("counted"), F.count("*").alias("group_size"), F.count_distinct("cohort_label").alias("cohorts_for_task")
    )
    return folders.withColumn("name", key).join(groups, "name").select("pos", "name", (F.col("pos") != F.col("counted")).alias("duplicate"), "group_size", "counted", "cohorts_for_task")
