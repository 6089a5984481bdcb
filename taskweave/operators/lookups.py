"""Join patterns shared by the operators.

Every look-up table is first reduced to one row per key, so each join is
many-to-one: its output never exceeds its left side, and a key that holds a
large share of the left side is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import bench_key, name_key, norm_name
from taskweave.functions.packages import DISAGREE, FROM_ARCHIVE, FROM_DELIVERED, FROM_EARLIER, FROM_NAME
from taskweave.session import numbered


def spellings(*cols: Column) -> Column:
    """Distinct non-empty spellings as an array."""
    return F.array_distinct(F.filter(F.array(*cols), lambda s: s.isNotNull() & (s != "")))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """One row per key, dealt out by an exchange of its own.

    AQE splits a hot key only where both sides of a join come straight from an exchange; the
    sides of a look-up that were just reduced by the same key would not. The key is made
    anew, so the join deals it again; these rows are few, the other side's are many.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def asked(key: Column, row: Column) -> Column:
    """The key of a row that looks for an answer dealt by :func:`answered`.

    Rows without a key find nothing; they are dealt out by ``row``, as they would all meet in one task.
    """
    return F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("!"), F.pmod(F.xxhash64(row), F.lit(1 << 14)).cast("string")))


def answered(key: Column) -> Column:
    """The key of an answer; made anew, like that of :func:`dealt`, so AQE may split the rows that ask for it."""
    return F.concat(F.lit("="), key)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def agreed(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row per key: its value, or NULL when the key has two values."""
    return (
        pairs.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))
    )


def name_pairs(df: DataFrame, value: Column, *names: str) -> DataFrame:
    """(key, value) for each name a row carries."""
    keys = spellings(*[bench_key(F.col(n)) for n in names])
    return df.select(F.explode(keys).alias("key"), value.alias("value"))


def lookup_by_priority(rows: DataFrame, row_id: str, names: list[str], sources: list[DataFrame], out: str) -> DataFrame:
    """The first answer by source, then by name; sources are ``agreed`` tables."""
    probes = rows.select(row_id, F.posexplode(F.array(*[bench_key(F.col(n)) for n in names])).alias("n", "key"))
    answers = None
    for s, source in enumerate(sources):
        ranked = source.where("value is not null").select("key", F.lit(s).alias("s"), F.col("value").alias("v"))
        answers = ranked if answers is None else answers.unionByName(ranked)
    per_key = answers.groupBy("key").agg(
        *[F.max(F.when(F.col("s") == s, F.col("v"))).alias(f"v{s}") for s in range(len(sources))]
    )
    hit = probes.join(per_key, "key").groupBy(row_id).agg(
        *[
            F.min_by(F.col(f"v{s}"), F.when(F.col(f"v{s}").isNotNull(), F.col("n"))).alias(f"v{s}")
            for s in range(len(sources))
        ]
    )
    return rows.join(hit.select(row_id, F.coalesce(*[F.col(f"v{s}") for s in range(len(sources))]).alias(out)), row_id, "left")


def one_person(keyed: DataFrame, row_id: str, people: DataFrame) -> DataFrame:
    """Per row that any key reaches: the single person named, and how many are.

    ``keyed`` is (row_id, key), any number of keys per row; ``people`` is
    (key, person), person NULL where an entry names nobody.
    Returns (row_id, person, named) with ``named`` one of none, one, several.
    Smallest and largest name per key are enough to tell one from several.
    """
    per_key = people.groupBy("key").agg(F.min("person").alias("lo"), F.max("person").alias("hi"))
    return person_of(keyed.join(dealt(per_key, "key"), "key").groupBy(row_id).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), row_id)


def person_of(bounds: DataFrame, row_id: str) -> DataFrame:
    """(row_id, person, named) from the smallest and largest person, ``lo`` and ``hi``, of each row."""
    named = F.when(F.col("lo").isNull(), "none").when(F.col("lo") == F.col("hi"), "one").otherwise("several")
    return bounds.select(row_id, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("person"), named.alias("named"))


def ranked_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """1-based rank within a group that may be arbitrarily large."""
    placed = numbered(df, [F.col(group), F.col(order)], "_at")
    starts = placed.groupBy(group).agg(F.min("_at").alias("_start"))
    return placed.join(starts, group).withColumn(name, F.col("_at") - F.col("_start") + 1).drop("_at", "_start")


def count_reached(keys: DataFrame, left_id: str, spelled: DataFrame, right_id: str) -> DataFrame:
    """(left_id, reached): how many distinct right rows share any spelling with each left one.

    ``keys`` is (left_id, key), each pair once, any number per left one; it is read several
    times, so it should be stored. ``spelled`` is (right_id, at, key): a right row's few
    spellings, in an order, those alone that any left one has. A right row is counted at the
    first of them that the left one has. Right rows that are alike in the spellings
    any left one has are one row with their number, and so are those that are alike up to a
    spelling: left keys meet these, never right rows.
    """
    own = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda s: s["key"]))
    alike = spelled.groupBy(right_id).agg(own.alias("own")).groupBy("own").agg(F.count("*").alias("n"))
    steps = alike.select("own", "n", F.posexplode("own").alias("at", "key")).select("key", F.when(F.col("at") > 0, F.slice("own", F.lit(1), F.col("at"))).otherwise(F.array().cast("array<string>")).alias("before"), "n")
    met = keys.join(dealt(steps.groupBy("key", "before").agg(F.sum("n").alias("n")), "key"), "key")
    first = met.where(F.size("before") == 0).select(left_id, "n")
    # Later spellings count where the left one has none of those before.
    probes = met.where(F.size("before") > 0).select(left_id, F.col("key").alias("here"), "before", "n", F.explode("before").alias("key"))
    had = keys.select(left_id, "key", F.lit(True).alias("had"))
    later = probes.join(had, [left_id, "key"], "left").groupBy(left_id, "here", "before").agg(F.max("n").alias("n"), F.max("had").alias("had")).where("had is null").select(left_id, "n")
    return first.union(later).groupBy(left_id).agg(F.sum("n").alias("reached"))


# ------------------------------------------------------------ connector cascade
def classify_connector(truth: DataFrame, scan: DataFrame) -> DataFrame:
    """Connector per task: exact name, then stem, then the chain's own reading.

    The first scan row that carries a spelling answers for it.
    """
    known = scan.where("is_connector is not null")
    names = ("declared_short", "folder", "declared_name")
    exact = F.transform(spellings(*[name_key(F.col(n)) for n in names]), lambda k: F.struct(k.alias("key"), F.lit(True).alias("exact")))
    loose = F.transform(spellings(*[norm_name(F.col(n)) for n in names]), lambda k: F.struct(k.alias("key"), F.lit(False).alias("exact")))
    services = F.when(F.size("connector_services") > 0, F.array_sort("connector_services"))
    per_key = (
        known.select("pos", "is_connector", services.alias("svc"), F.explode(F.concat(exact, loose)).alias("s"))
        .select("pos", "is_connector", "svc", "s.*")
        .groupBy("key")
        .agg(
            F.min_by("is_connector", F.when(F.col("exact"), F.col("pos"))).alias("exact_flag"),
            F.min_by("is_connector", F.when(~F.col("exact"), F.col("pos"))).alias("loose_flag"),
            F.min_by("svc", F.when(F.col("svc").isNotNull(), F.col("pos"))).alias("svc"),
        )
    )
    by_name = per_key.select(F.col("key").alias("k1"), "exact_flag", F.col("svc").alias("svc1"))
    by_stem = per_key.select(F.col("key").alias("k2"), "loose_flag", F.col("svc").alias("svc2"))
    joined = (
        truth.withColumn("k1", name_key(F.col("name")))
        .withColumn("k2", norm_name(F.col("name")))
        .join(by_name, "k1", "left")
        .join(by_stem, "k2", "left")
    )
    answer = F.coalesce("exact_flag", "loose_flag", "connector")
    via = (
        F.when(F.col("exact_flag").isNotNull(), F.lit("name"))
        .when(F.col("loose_flag").isNotNull(), F.lit("normalised name"))
        .when(F.col("connector").isNotNull(), F.lit("ingest chain"))
        .otherwise(F.lit("no package scanned"))
    )
    return joined.select(
        *truth.columns,
        answer.alias("is_connector"),
        via.alias("via"),
        F.when(answer, F.coalesce("svc1", "svc2")).alias("found_services"),
    )


def connector_agreement(classified: DataFrame) -> DataFrame:
    """Coverage of the connector reading, with the tasks at the bar as its base."""
    has = F.col("is_connector").isNotNull()
    return classified.agg(
        F.count("*").alias("tasks"),
        F.count_if(has).alias("classified"),
        F.count_if(F.col("is_connector")).alias("connector"),
        F.count_if(F.col("is_connector") == F.lit(False)).alias("non_connector"),
        F.count_if(~has).alias("unknown"),
        F.count_if("at_current_bar").alias("at_bar"),
        F.count_if(has & F.col("at_current_bar")).alias("classified_at_bar"),
        *[F.count_if(F.col("via") == v).alias(a) for v, a in (("name", "by_name"), ("normalised name", "by_stem"), ("ingest chain", "by_chain"))],
    )


def services_used(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("found_services").alias("service")).groupBy("service").agg(F.count("*").alias("tasks"))


# ------------------------------------------------------------------ run scores
def score_lookup(rows: DataFrame, row_id: str, names: list[str], scores: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each row's run score: by each name as written, then without version suffixes.

    ``scores`` is (key, value); ``aliases`` is (key, task) and answers where no
    score carries the key itself.
    """
    tries = []
    for n in names:
        k = bench_key(F.col(n))
        tries += [k, F.regexp_replace(k, r"(-v\d+)+$", ""), F.regexp_replace(k, r"(-for-qc(-v\d+)?|-v\d+)+$", "")]
    through_alias = aliases.join(scores.withColumnRenamed("key", "task"), "task").select("key", F.col("value").alias("alias_value"))
    table = scores.join(through_alias, "key", "full").select("key", F.coalesce("value", "alias_value").alias("value"))
    hit = (
        rows.select(row_id, F.posexplode(F.array(*tries)).alias("n", "key"))
        .where("key <> ''")
        .join(table, "key")
        .groupBy(row_id)
        .agg(F.min_by("value", "n").alias("score"))
    )
    return rows.join(hit, row_id, "left")


def package_aliases(runs: DataFrame) -> DataFrame:
    """(key, task): package folders that name exactly one task and are no task themselves."""
    one = (
        runs.where("package_key <> '' and package_key <> task")
        .groupBy(F.col("package_key").alias("key"))
        .agg(F.min("task").alias("task"), F.max("task").alias("other"))
        .where("task = other")
        .select("key", "task")
    )
    return one.join(runs.select(F.col("task").alias("key")).distinct(), "key", "left_anti")


# --------------------------------------------------------------- trial reports
# Why a task has trials or none.
NO_REPORT = "no gate report for this batch"
NO_TASK = "the batch holds several tasks and none matches this name"
NO_TRIALS = "the gate report records no GLM trials"
READ = "read from the trial files"


def trials_join(truth: DataFrame, reports: DataFrame, rewards: DataFrame) -> DataFrame:
    """Rewards per truth row through its batch's report: exact name, or the only one.

    ``reports`` is (batch, task); ``rewards`` is (batch, task, trials, passes).
    """
    per_batch = reports.groupBy("batch").agg(F.count("*").alias("n"), F.min("task").alias("only"))
    keyed = truth.join(per_batch, "batch", "left").join(
        reports.select("batch", F.col("task").alias("name"), F.lit(True).alias("exact")), ["batch", "name"], "left"
    )
    chosen = F.when(F.col("exact"), F.col("name")).when(F.col("n") == 1, F.col("only"))
    why = (
        F.when(F.col("n").isNull(), F.lit(NO_REPORT))
        .when(F.col("chosen").isNull(), F.lit(NO_TASK))
        .when(F.col("trials").isNull(), F.lit(NO_TRIALS))
        .otherwise(F.lit(READ))
    )
    return (
        keyed.withColumn("chosen", chosen)
        .join(rewards.withColumnRenamed("task", "chosen"), ["batch", "chosen"], "left")
        .withColumn("reason", why)
        .drop("n", "only", "exact")
    )


# ------------------------------------------------------------- package images
def package_images(readings: DataFrame) -> DataFrame:
    """Per name: its image, only when every image under it is one family.

    ``readings`` is (key, image, family); a plain image has no family.
    """
    family = F.coalesce("family", F.lit("(plain)"))
    return readings.groupBy("key").agg(
        F.count_distinct("image").alias("images"),
        F.when(F.min(family) == F.max(family), F.min("image")).alias("image"),
    )


# Fixed value: a copy that was read from the zip as delivered.
DELIVERED_ZIP = "delivered zip"


def image_of_packages(packages: DataFrame, names: list[str], copies: DataFrame, archives: DataFrame, readings: DataFrame) -> DataFrame:
    """(pos, image, read_from): the image each package runs, by the first reading that settles it.

    The delivered copy; the archive the manifest names; the readings under any of its names,
    if all are of one family; an earlier copy. Where only readings of several families are
    left there is no image, and ``read_from`` says so. ``packages`` is (pos, batch, zip,
    archive, names...), ``copies`` (batch, zip, image, read_from), ``archives`` (archive,
    image), ``readings`` (key, image, family) with no family for a plain image.
    """
    copy = copies.groupBy("batch", F.lower("zip").alias("zip_key")).agg(
        F.min(F.when(F.col("read_from") == DELIVERED_ZIP, F.col("image"))).alias("delivered"),
        F.min(F.when(F.col("read_from") != DELIVERED_ZIP, F.col("image"))).alias("earlier"),
    )
    named = archives.groupBy("archive").agg(F.min("image").alias("archived"))
    family = F.coalesce("family", F.lit("(plain)"))
    per_key = readings.groupBy("key").agg(F.min("image").alias("image"), F.min(family).alias("lo"), F.max(family).alias("hi"))
    keys = packages.select("pos", F.explode(spellings(*[bench_key(F.col(n)) for n in names])).alias("key"))
    scanned = keys.join(per_key, "key").groupBy("pos").agg(F.min("image").alias("scanned"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    joined = (
        packages.select("pos", "batch", "archive", F.lower("zip").alias("zip_key"))
        .join(copy, ["batch", "zip_key"], "left")
        .join(named, "archive", "left")
        .join(scanned, "pos", "left")
    )
    choices = [
        (F.col("delivered").isNotNull(), F.col("delivered"), FROM_DELIVERED),
        (F.col("archived").isNotNull(), F.col("archived"), FROM_ARCHIVE),
        (F.col("lo") == F.col("hi"), F.col("scanned"), FROM_NAME),
        (F.col("earlier").isNotNull(), F.col("earlier"), FROM_EARLIER),
        (F.col("scanned").isNotNull(), F.lit(None).cast("string"), DISAGREE),
    ]
    image, how = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, value, label in reversed(choices):
        image, how = F.when(holds, value).otherwise(image), F.when(holds, F.lit(label)).otherwise(how)
    return joined.select("pos", image.alias("image"), how.alias("read_from"))


# ------------------------------------------------------- incremental snapshots
def work_left(wanted: DataFrame, known: DataFrame, misses: DataFrame, today: Column, recheck_days: int) -> DataFrame:
    """Keys still to read: not known, and not missed within the last days."""
    fresh = misses.where(F.date_diff(today, "checked_on") < recheck_days).select("key")
    return wanted.join(known.select("key"), "key", "left_anti").join(fresh, "key", "left_anti")


def merge_snapshot(previous: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """The latest answer per key; an earlier answer is kept where nothing is newer."""
    both = previous.unionByName(new)
    rest = [c for c in both.columns if c != "key"]
    return both.groupBy("key").agg(F.max_by(F.struct(*rest), version).alias("_r")).select("key", "_r.*")
