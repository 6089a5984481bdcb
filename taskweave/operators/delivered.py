"""Which tasks have gone out: the delivery audit and manifests against the tasks.

An audited task reaches a row by one of three keys: the name, the stem of the
name, or the name spelled inside the row's identifier. Audited tasks and rows
never meet pairwise. Both sides list their (kind, value) keys, one side is
reduced to a row per key, and the answer is carried back through the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import NOT_RECORDED, is_placeholder, name_key, norm_name, plain_key, stem
from taskweave.operators.figures import preferred_order
from taskweave.operators.filters import collectable
from taskweave.operators.lookups import answered, asked, count_reached, dealt, ranked_within, spellings
from taskweave.session import stored

# Match methods, strongest first, and the shortest embedded name.
BY_NAME = "name"
BY_STEM = "normalised name"
BY_ID = "embedded in the verdict identifier"
BY_MANIFEST = "delivery manifest"
METHODS = (BY_NAME, BY_STEM, BY_ID)
SHORTEST_EMBEDDED = 14


def method_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), kind)


def _clean_starts(text: Column) -> Column:
    """1-based positions of a text where no word is cut: its start and those behind a separator."""
    pieces = F.split(text, r"(?<=[^\p{L}\p{N}])")
    return F.aggregate(pieces, F.array(F.lit(1)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))


def embedded_in(rows: DataFrame, row_id: str, text: Column, names: DataFrame) -> DataFrame:
    """(row_id, value): names (one ``value`` per row) spelled inside a text as whole segments.

    A name longer than the shortest length is found by its opening characters: from every
    clean start of a text, as much of it as the longest name goes on, there is one candidate
    per length that names of that opening have. A candidate must end where no word is cut, and
    is then compared in full. The names are stored, so Spark knows their size when it decides
    whether the starts, many per text, have to be shuffled to meet them.
    """
    width = SHORTEST_EMBEDDED + 1
    wanted = stored(names.select("value").where(F.length("value") >= width).distinct(), "wanted-names")
    # No more lengths per opening than the longest name has characters.
    lengths = stored(wanted.groupBy(F.substring("value", 1, width).alias("opening")).agg(F.collect_set(F.length("value")).alias("sizes")), "name-lengths")
    longest = lengths.agg(F.max(F.array_max("sizes"))).first()[0] or 0
    text = text.cast("string")
    pieces = F.transform(_clean_starts(text), lambda at: F.substring(text, at, F.lit(longest + 1)))
    starts = rows.select(row_id, F.explode(pieces).alias("piece")).where(F.length("piece") >= width)
    alive = starts.withColumn("opening", F.substring("piece", 1, width)).join(lengths, "opening").select(row_id, "piece", F.explode("sizes").alias("size"))
    after = F.substring("piece", F.col("size") + 1, F.lit(1))
    whole = (F.length("piece") >= F.col("size")) & ((after == "") | after.rlike(r"^[^\p{L}\p{N}]"))
    candidates = alive.where(whole).select(row_id, F.substring("piece", F.lit(1), F.col("size")).alias("value"))
    return candidates.join(wanted, "value", "left_semi").select(row_id, "value").distinct()


def name_collisions(truth: DataFrame) -> DataFrame:
    """Stems that more than one spelling collapses onto; they are refused."""
    k = plain_key(F.col("name"))
    return (
        truth.select(k.alias("key"), stem(k).alias("stem"))
        .groupBy("stem")
        .agg(F.count_distinct("key").alias("spellings"))
        .where("spellings > 1")
    )


def audit_keys(audit: DataFrame, truth: DataFrame, collisions: DataFrame | None = None) -> DataFrame:
    """(pos, kind, value): the keys each audited task may be found by."""
    base = audit.select("pos", plain_key(F.col("task")).alias("key")).withColumn("stem", stem(F.col("key")))
    clear = base.join(name_collisions(truth) if collisions is None else collisions, "stem", "left_anti")
    k = plain_key(F.col("name"))
    named = truth.select(F.explode(F.array(k, stem(k))).alias("key")).distinct()
    long_enough = clear.where(F.length("key") > SHORTEST_EMBEDDED).join(named, "key", "left_anti")
    pick = lambda df, kind, c: df.select("pos", F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return pick(base, BY_NAME, "key").unionByName(pick(clear, BY_STEM, "stem")).unionByName(pick(long_enough, BY_ID, "key"))


def row_keys(truth: DataFrame, embedded_names: DataFrame) -> DataFrame:
    """(id, kind, value): the keys each task row can be found under."""
    k = plain_key(F.col("name"))
    own = truth.select(
        "id",
        F.inline(
            F.array(
                F.struct(F.lit(BY_NAME).alias("kind"), k.alias("value")),
                F.struct(F.lit(BY_STEM).alias("kind"), stem(k).alias("value")),
            )
        ),
    )
    hay = F.concat(plain_key(F.col("id")), F.lit("/"), F.coalesce(plain_key(F.col("source")), F.lit("")))
    inside = embedded_in(truth, "id", hay, embedded_names).select("id", F.lit(BY_ID).alias("kind"), "value")
    return own.unionByName(inside)


def first_claimant(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(id, winner): the first audited task, in audit order, that reaches a row.

    Walking the audit in order, a task with any unclaimed row claims all of
    them, and a task with none claims nothing that was free. So the claimant of
    a row is simply the smallest position that reaches it.
    """
    first = dealt(audits.groupBy("kind", "value").agg(F.min("pos").alias("pos")), "value")
    return rows.join(first, ["kind", "value"]).groupBy("id").agg(F.min("pos").alias("winner"))


def join_delivered(audit: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(delivered rows, audited tasks), each with how it was matched.

    Delivered rows: id, method, delivered_task. Audited tasks: pos, task,
    matched, method, claimed_by, reason.
    """
    # The collisions and both key tables are read several times below, so they are stored once.
    collisions = stored(name_collisions(truth).select("stem"), "collisions")
    audits = stored(audit_keys(audit, truth, collisions), "audit-keys")
    rows = stored(row_keys(truth, audits.where(F.col("kind") == BY_ID)), "row-keys")
    names = audit.select("pos", "task")
    claims = stored(
        first_claimant(rows, audits).join(names.select(F.col("pos").alias("winner"), F.col("task").alias("delivered_task")), "winner"),
        "claims",
    )
    matched = claims.select(F.col("winner").alias("pos")).distinct()

    # The method is that of the last matched audited task reaching the row.
    last = audits.join(matched, "pos", "left_semi").groupBy("kind", "value").agg(F.max("pos").alias("pos"))
    method = rows.join(dealt(last, "value"), ["kind", "value"]).groupBy("id").agg(
        F.max_by("kind", F.struct("pos", -method_rank(F.col("kind")))).alias("method")
    )
    delivered = claims.join(method, "id").select("id", "method", "delivered_task")

    held_by = rows.join(claims.select("id", "delivered_task"), "id").groupBy("kind", "value").agg(F.min("delivered_task").alias("holder"))
    reached = audits.join(held_by, ["kind", "value"]).groupBy("pos").agg(
        F.min_by("kind", method_rank(F.col("kind"))).alias("method"), F.min("holder").alias("holder")
    )
    collided = collisions.withColumn("collided", F.lit(True))
    outcome = (
        audit.withColumn("stem", stem(plain_key(F.col("task"))))
        .join(reached, "pos", "left")
        .join(matched.withColumn("matched", F.lit(True)), "pos", "left")
        .join(collided, "stem", "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )
    # Why an audited task found no row of its own.
    reason = (
        F.when(F.col("matched"), F.lit(None).cast("string"))
        .when(F.col("holder").isNotNull(), F.concat(F.lit("its only pipeline rows are already claimed by "), "holder"))
        .when(F.col("collided"), F.lit("several pipeline names share this normalised name"))
        .otherwise(F.lit("no task decided in the pipeline window carries this name"))
    )
    audited = outcome.select(
        *audit.columns,
        "matched",
        F.when(F.col("matched"), F.col("method")).alias("method"),
        F.when(~F.col("matched"), F.col("holder")).alias("claimed_by"),
        reason.alias("reason"),
    )
    return delivered, audited


def whereabouts(unmatched: DataFrame, scan: DataFrame) -> DataFrame:
    """Where an unmatched audited task sits in the bucket: outcomes, cohorts, folders."""
    keys = []
    for n in ("declared_short", "folder", "declared_name"):
        k = plain_key(F.col(n))
        keys += [k, stem(k)]
    # Outcomes and cohorts are short fixed lists, so their sets stay small.
    per_key = (
        scan.select("outcome", "cohort_label", "folder", F.explode(spellings(*keys)).alias("key"))
        .groupBy("key")
        .agg(
            F.array_sort(F.collect_set("outcome")).alias("outcomes"),
            F.array_sort(F.collect_set("cohort_label")).alias("cohorts"),
            F.count_distinct("folder").alias("folders"),
        )
    )
    k = plain_key(F.col("task"))
    exact = per_key.select(F.col("key").alias("k1"), F.struct("outcomes", "cohorts", "folders").alias("a"))
    loose = per_key.select(F.col("key").alias("k2"), F.struct("outcomes", "cohorts", "folders").alias("b"))
    found = F.coalesce("a", "b")
    return (
        unmatched.withColumn("k1", k)
        .withColumn("k2", stem(k))
        .join(exact, "k1", "left")
        .join(loose, "k2", "left")
        .select(*unmatched.columns, found.isNotNull().alias("in_bucket"), found["outcomes"].alias("outcomes"), found["cohorts"].alias("cohorts"), found["folders"].alias("folders"))
    )


def _collectable(df: DataFrame) -> DataFrame:
    return df.where(collectable())


def manifest_claims(truth: DataFrame, manifest: DataFrame, delivered: DataFrame) -> DataFrame:
    """Undelivered tasks at the bar that a manifest names: claimed or flagged.

    ``manifest`` is (pos, name, task_id, folder, batch). A row is claimed when
    its own name is a placeholder or is the delivered name; a version of the
    delivered name, or a match through the identifier, is only flagged.
    """
    spelled = F.posexplode(F.array(*[plain_key(F.col(n)) for n in ("name", "task_id", "folder")])).alias("n", "key")
    by_key = (
        manifest.select("pos", "batch", F.col("name").alias("task"), spelled)
        .where("key <> ''")
        .groupBy("key")
        .agg(F.min_by(F.struct("task", "batch"), F.struct("pos", "n")).alias("m"))
    )
    tail = F.regexp_replace(plain_key(F.col("id")), r"^[^:]*:", "")
    probes = F.array(plain_key(F.col("name")), tail, F.regexp_replace(tail, r"-[0-9a-f]{6,}$", ""))
    hits = (
        _collectable(truth)
        .join(delivered.select("id"), "id", "left_anti")
        .select("id", "name", F.posexplode(probes).alias("n", "key"))
        .join(by_key, "key")
        .groupBy("id")
        .agg(F.min_by(F.struct("name", "m.task", "m.batch"), "n").alias("h"))
        .select("id", "h.*")
    )
    own, theirs = plain_key(F.col("name")), plain_key(F.col("task"))
    version_of = (stem(own) == stem(theirs)) & (own != theirs)
    claimed = ~version_of & (is_placeholder(own, "delivered") | (own == theirs))
    why = F.when(claimed, F.lit("claimed")).when(version_of, F.lit("a version of a delivered name")).otherwise(F.lit("matched through the family id"))
    return hits.select("id", "name", "task", "batch", claimed.alias("claimed"), why.alias("rule"))


def placed_by_manifest(unmatched: DataFrame, claims: DataFrame) -> DataFrame:
    """Unmatched audited tasks that a claim places: the first ones per task."""
    per_task = claims.where("claimed").groupBy("task").agg(F.count("*").alias("n"))
    wanted = unmatched.join(per_task, "task")
    return ranked_within(wanted, "task", "pos", "rank").where("rank <= n").drop("n", "rank")


def suspect_embedded(ready: DataFrame, audit: DataFrame) -> DataFrame:
    """(id, audited): a ready row whose identifier names an audited task; longest wins."""
    names = audit.select(plain_key(F.col("task")).alias("value")).where(F.length("value") > SHORTEST_EMBEDDED)
    return (
        embedded_in(ready, "id", plain_key(F.col("id")), names)
        .groupBy("id")
        .agg(F.max_by("value", F.struct(F.length("value"), "value")).alias("audited"))
    )


def suspect_version(ready: DataFrame, truth: DataFrame, delivered: DataFrame) -> DataFrame:
    """(id, twin): a ready row that shares a stem with a row delivered by name."""
    k = plain_key(F.col("name"))
    twins = (
        truth.join(delivered.where(F.col("method") == BY_NAME).select("id"), "id", "left_semi")
        .groupBy(stem(k).alias("stem"))
        .agg(F.min_by("name", "id").alias("twin"))
    )
    return (
        ready.withColumn("stem", stem(k))
        .join(twins, "stem")
        .where(k != plain_key(F.col("twin")))
        .select("id", "twin")
    )


# -------------------------------------------------------- manifests and bucket
def bucket_check(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Does each package still exist: by hash, by the tail of its batch id, by folder."""
    row = F.struct("outcome", "cohort_label", "sha256")
    hashed = scan.where("sha256 is not null")
    by_hash = hashed.groupBy(F.col("sha256").alias("h")).agg(F.max_by(row, "pos").alias("by_hash"))
    by_tail = hashed.groupBy(F.substring("sha256", 1, 12).alias("tail")).agg(F.min_by(row, "pos").alias("by_tail"))
    by_folder = scan.where("folder is not null").groupBy(name_key(F.col("folder")).alias("fk")).agg(F.min_by(row, "pos").alias("by_folder"))
    candidates = F.array("sha256", "object_hash", "source_version", F.replace("original_filename", F.lit(".zip"), F.lit("")))
    hit = (
        manifest.select("pos", F.posexplode(candidates).alias("n", "h"))
        .where("h <> ''")
        .join(by_hash, "h")
        .groupBy("pos")
        .agg(F.min_by("by_hash", "n").alias("by_hash"))
    )
    tail = F.element_at(F.split("batch_id", "-"), -1)
    joined = (
        manifest.withColumn("tail", F.when(F.length(tail) == 12, tail))
        .withColumn("fk", name_key(F.col("folder")))
        .join(hit, "pos", "left")
        .join(by_tail, "tail", "left")
        .join(by_folder, "fk", "left")
    )
    exact = F.coalesce("by_hash", "by_tail")
    state = F.when(exact.isNotNull(), "hash").when(F.col("by_folder").isNotNull(), "folder").otherwise("absent")
    found = F.coalesce(exact, F.col("by_folder"))
    return joined.select(*manifest.columns, state.alias("bucket_state"), found["outcome"].alias("bucket_outcome"), found["cohort_label"].alias("bucket_cohort"))


def live_check(manifest: DataFrame, listing: DataFrame | None, previous: DataFrame, checked_on: Column, hash_pattern: str = "[0-9a-f]{64}") -> DataFrame:
    """Each package against a listing: object, moved, repackaged or absent.

    Without a listing the earlier answers (``previous``: name, state,
    checked_on) stand, each with its own date.
    """
    if listing is None:
        was = previous.select("name", F.col("state").alias("live_state"), F.col("checked_on").alias("live_checked_on"))
        return manifest.join(was, "name", "left").select(*manifest.columns, "live_state", "live_checked_on")
    inside = r"^gs://[^/]+/tasks/[^/]+/([^/]+)/(.+)$"
    lines = listing.select(F.trim("name").alias("uri")).where(F.col("uri").startswith("gs://"))
    placed = lines.select(F.regexp_extract("uri", inside, 1).alias("folder"), F.regexp_extract("uri", inside, 2).alias("tail")).where("folder <> ''")
    folders = placed.select("folder").distinct().withColumn("has_folder", F.lit(True))
    hashes = (
        placed.select("folder", F.explode(F.regexp_extract_all("tail", F.lit(f"({hash_pattern})"), F.lit(1))).alias("object_hash"))
        .distinct()
        .withColumn("has_hash", F.lit(True))
    )
    uris = lines.select(F.col("uri").alias("source_uri")).distinct().withColumn("has_uri", F.lit(True))
    state = (
        F.when(F.col("has_uri"), "object").when(F.col("has_hash"), "moved").when(F.col("has_folder"), "repackaged").otherwise("absent")
    )
    answers = (
        manifest.join(uris, "source_uri", "left")
        .join(folders, "folder", "left")
        .join(hashes, ["folder", "object_hash"], "left")
    )
    return answers.select(*manifest.columns, state.alias("live_state"), checked_on.alias("live_checked_on"))


def manifest_counts(checked: DataFrame) -> DataFrame:
    """Per batch and overall: packages by bucket state and by live state."""
    is_ = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return (
        checked.rollup("batch")
        .agg(
            F.count("*").alias("tasks"),
            is_("bucket_state", "hash").alias("verified"),
            is_("bucket_state", "folder").alias("repackaged"),
            is_("bucket_state", "absent").alias("absent"),
            is_("live_state", "object", "moved").alias("live_confirmed"),
            is_("live_state", "absent", "repackaged").alias("live_missing"),
            F.grouping_id().alias("g"),
        )
        .withColumn("batch", F.when(F.col("g") == 1, F.lit("All")).otherwise(F.coalesce("batch", F.lit(NOT_RECORDED))))
        .drop("g")
    )


# ------------------------------------------------------------- accepted folders
def verdict_spellings() -> Column:
    tail = F.regexp_replace(name_key(F.col("id")), r"^[^:]*:", "")
    return spellings(name_key(F.col("name")), norm_name(F.col("name")), tail, F.regexp_replace(tail, r"-[0-9a-f]{6,}$", ""))


def folder_spellings() -> Column:
    names = [F.col("folder"), F.col("declared_short"), F.col("declared_name")]
    return spellings(*[name_key(n) for n in names], *[norm_name(n) for n in names])


# What told whether a folder is a connector task.
VIA_PACKAGE = "the folder’s own package"
VIA_MANIFEST = "the delivery manifest that packaged it"
VIA_CONFIG = "its task.toml, read directly (%s)"


def folder_keys(folders: DataFrame, scan: DataFrame) -> DataFrame:
    """(fk, key): every spelling that any scan row of a folder declares, else those of its own name."""
    declared = scan.where("folder is not null").select(name_key(F.col("folder")).alias("fk"), F.explode(folder_spellings()).alias("key")).distinct()
    own = folders.select(name_key(F.col("folder")).alias("fk"), F.explode(spellings(name_key(F.col("folder")), norm_name(F.col("folder")))).alias("key"))
    return declared.union(own.join(declared.select("fk").distinct(), "fk", "left_anti").distinct())


def cohort_fold(folders: DataFrame, scan: DataFrame, truth: DataFrame, manifest: DataFrame, reads: DataFrame) -> DataFrame:
    """One row per accepted folder: its latest verdict, states seen, connector, delivery.

    ``folders`` is (folder), each once. ``scan`` has any number of rows per folder: a verdict
    reaches the folder by any spelling of any of them, and the last row (``pos``) answers for
    the package. ``manifest`` is (pos, folder, batch, connector), the last row of a folder
    counts; ``reads`` is (folder, connector, basis), one row per folder. The package answers
    first for the connector, then the manifest, then the config text. Identifiers may repeat:
    rows that differ in what is said of them are verdicts of their own, equal ones are one.
    """
    keys = stored(folder_keys(folders, scan), "folder-keys")
    verdict = F.struct("id", "state", "decided", "owner", "runs")
    named = truth.select(verdict.alias("verdict"), F.posexplode(verdict_spellings()).alias("at", "key"))
    spelled = stored(named.join(keys.select("key").distinct(), "key", "left_semi"), "verdict-keys")
    best = F.struct(F.coalesce("verdict.decided", F.lit("0001-01-01").cast("date")), "verdict.runs", "verdict.id")
    # States are a short fixed list.
    per_key = spelled.groupBy("key").agg(
        F.max(F.struct(best.alias("rank"), "verdict.state", "verdict.decided", "verdict.owner")).alias("v"), F.collect_set("verdict.state").alias("states")
    )
    seen = (
        keys.join(dealt(per_key, "key"), "key")
        .groupBy("fk")
        .agg(F.max("v").alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("states")))).alias("states"))
    )
    reached = count_reached(keys, "fk", spelled, "verdict")
    package = F.struct("is_connector", F.array_sort(F.coalesce("connector_services", F.array().cast("array<string>"))).alias("services"))
    scanned = scan.where("folder is not null").groupBy(name_key(F.col("folder")).alias("fk")).agg(F.max_by(package, "pos").alias("p"))
    sent = manifest.where("folder is not null").groupBy(name_key(F.col("folder")).alias("fk")).agg(F.max_by(F.struct("batch", "connector"), "pos").alias("m"))
    own, packed, read = F.col("p.is_connector"), F.col("m.connector"), F.col("read.connector")
    rows = folders.select("folder", name_key(F.col("folder")).alias("fk"))
    for side in (seen, reached, scanned, sent):
        rows = rows.join(side, "fk", "left")
    return rows.join(reads.select("folder", F.struct("connector", "basis").alias("read")), "folder", "left").select(
        "folder",
        is_placeholder(F.col("folder"), "cohort").alias("placeholder_name"),
        F.coalesce(own, packed, read).alias("connector"),
        F.when(own.isNotNull(), F.lit(VIA_PACKAGE))
        .when(packed.isNotNull(), F.lit(VIA_MANIFEST))
        .when(read.isNotNull(), F.format_string(VIA_CONFIG, F.col("read.basis")))
        .alias("connector_via"),
        F.coalesce("p.services", F.array().cast("array<string>")).alias("services"),
        F.coalesce("reached", F.lit(0)).alias("verdicts"),
        F.col("v.state").alias("state"),
        F.col("v.decided").alias("decided"),
        F.col("v.owner").alias("owner"),
        F.coalesce("states", F.array().cast("array<string>")).alias("states"),
        F.col("m").isNotNull().alias("delivered"),
        F.col("m.batch").alias("batch"),
    )


def cohort_counts(folded: DataFrame) -> DataFrame:
    """The accepted folders by their latest verdict; the parts add to the whole."""
    state = lambda s: F.count_if(F.col("state") == s)
    decided = F.count_if(F.col("state").isNotNull())
    return folded.agg(
        F.count("*").alias("packages"),
        decided.alias("decided"),
        (F.count("*") - decided).alias("before_cut"),
        state("accepted").alias("latest_accepted"),
        state("legacy accepted").alias("latest_legacy_accepted"),
        state("rejected").alias("latest_rejected"),
        (decided - state("accepted") - state("legacy accepted") - state("rejected")).alias("latest_other"),
        F.count_if(F.size("states") > 1).alias("disagree_across_runs"),
        F.count_if("placeholder_name").alias("placeholder_names"),
        F.count_if("delivered").alias("delivered"),
        F.count_if(~F.col("delivered")).alias("not_delivered"),
        F.count_if("connector").alias("connector_tasks"),
        F.count_if(~F.col("connector")).alias("non_connector_tasks"),
        F.count_if(F.col("connector").isNull()).alias("connector_unknown"),
        F.count_if(F.col("connector_via") == VIA_MANIFEST).alias("connector_from_manifest"),
        F.count_if(F.col("connector_via").startswith(VIA_CONFIG.split("(")[0])).alias("connector_from_package"),
    )


def cohort_rows(folders: DataFrame, truth: DataFrame) -> DataFrame:
    """Each folder with the verdict row that best describes it, or none.

    The folder's key is tried first, then its stem.
    """
    best = (
        truth.select("*", F.explode(spellings(name_key(F.col("name")), norm_name(F.col("name")))).alias("key"))
        .groupBy("key")
        .agg(F.min_by(F.struct("id", "name", "owner", "decided", "runs"), preferred_order()).alias("m"))
    )
    exact = best.select(F.col("key").alias("k1"), F.col("m").alias("m1"))
    loose = best.select(F.col("key").alias("k2"), F.col("m").alias("m2"))
    match = F.coalesce("m1", "m2")
    return (
        folders.withColumn("k1", name_key(F.col("folder")))
        .withColumn("k2", norm_name(F.col("folder")))
        .join(exact, "k1", "left")
        .join(loose, "k2", "left")
        .select(
            *[F.col(c) for c in folders.columns if c not in ("owner",)],
            F.coalesce(match["id"], F.concat(F.lit("folder:"), "folder")).alias("id"),
            F.coalesce(match["name"], F.col("folder")).alias("name"),
            match["owner"].alias("owner"),
            match["decided"].alias("decided"),
            F.coalesce(match["runs"], F.lit(0)).alias("runs"),
            match.isNull().alias("no_verdict"),
        )
    )


def duplicate_folders(packages: DataFrame) -> DataFrame:
    """Folders whose packages declare the same task; others are cleared."""
    sizes = packages.where("package_task is not null").groupBy("package_task").agg(F.count("*").alias("n"))
    dup = F.coalesce(F.col("n") > 1, F.lit(False))
    return packages.join(sizes, "package_task", "left").select(
        *packages.columns,
        F.when(dup, F.col("n") - 1).otherwise(0).alias("duplicate_siblings"),
        dup.alias("possible_duplicate"),
        F.when(dup, "confirmed").otherwise("").alias("duplicate_tier"),
    )


def carry_duplicates(truth: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows that a duplicated folder reaches by name, stem or id, confirmed.

    ``folders`` is the result of :func:`duplicate_folders`; the first folder in
    order answers.
    """
    answer = F.struct("package_task", "duplicate_siblings")
    by_key = (
        folders.where("possible_duplicate")
        .select("pos", answer.alias("a"), F.explode(spellings(name_key(F.col("folder")), norm_name(F.col("folder")), name_key(F.col("package_task")))).alias("key"))
        .groupBy("key")
        .agg(F.min(F.struct("pos", "a")).alias("f"))
    )
    ident = name_key(F.regexp_replace("id", r"^(task|family|folder):", ""))
    return (
        truth.select("id", F.explode(spellings(name_key(F.col("name")), norm_name(F.col("name")), ident)).alias("key"))
        .join(by_key, "key")
        .groupBy("id")
        .agg(F.min("f").alias("f"))
        .select("id", F.col("f.a.package_task").alias("package_task"), F.col("f.a.duplicate_siblings").alias("duplicate_siblings"))
    )


# ------------------------------------------------------------ tracing deliveries
def _delivery_keys(deliveries: DataFrame, prefix: str) -> DataFrame:
    """(pos, route, key) of each delivery: its source folder, its names."""
    folder = F.when(F.col("source_prefix") == prefix, name_key(F.col("source_folder")))
    named = [F.struct(F.lit("name").alias("route"), name_key(F.col(n)).alias("key")) for n in ("task", "package_name")]
    routes = F.array(F.struct(F.lit("folder").alias("route"), folder.alias("key")), *named)
    return deliveries.select("pos", F.inline(routes)).where("key <> ''").distinct()


def trace_folders(folders: DataFrame, deliveries: DataFrame, prefix: str) -> DataFrame:
    """Each accepted folder and the delivery that reached it, by the strongest route."""
    per_key = (
        _delivery_keys(deliveries, prefix)
        .join(deliveries.select("pos", "batch", "type"), "pos")
        .groupBy("route", "key")
        .agg(F.min(F.struct("pos", "batch", "type")).alias("d"))
    )
    fk = name_key(F.col("folder"))
    probes = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("folder").alias("route"), fk.alias("key")),
        F.struct(F.lit(1).alias("n"), F.lit("name").alias("route"), fk.alias("key")),
        F.struct(F.lit(2).alias("n"), F.lit("name").alias("route"), name_key(F.col("package_task")).alias("key")),
    )
    hit = (
        folders.select(F.col("pos").alias("fpos"), F.inline(probes))
        .join(per_key, ["route", "key"])
        .groupBy("fpos")
        .agg(F.min_by(F.struct("route", "d"), "n").alias("h"))
        .select(F.col("fpos").alias("pos"), "h.*")
    )
    by = F.when(F.col("index_delivered"), F.lit("manifest")).otherwise(F.col("route"))
    return (
        folders.join(hit, "pos", "left")
        .withColumn("delivered_by", by)
        .select(
            *folders.columns,
            by.isNotNull().alias("delivered"),
            "delivered_by",
            F.col("d.batch").alias("delivered_batch"),
            F.when(F.col("d.type") == "Connector", True).when(F.col("d.type") == "Non-connector", False).alias("delivered_type"),
        )
    )


def trace_deliveries(folders: DataFrame, deliveries: DataFrame, prefix: str, missing: DataFrame) -> DataFrame:
    """Each delivery: the first accepted folder that holds it, or why none does.

    ``missing`` is (batch, key): audited packages a listing no longer holds.
    """
    fk = name_key(F.col("folder"))
    held = (
        folders.select("pos", "folder", F.inline(F.array(
            F.struct(F.lit("folder").alias("route"), fk.alias("key")),
            F.struct(F.lit("name").alias("route"), fk.alias("key")),
            F.struct(F.lit("name").alias("route"), name_key(F.col("package_task")).alias("key")),
        )))
        .where("key <> ''")
        .groupBy("route", "key")
        .agg(F.min(F.struct("pos", "folder")).alias("f"))
    )
    reached = _delivery_keys(deliveries, prefix).join(held, ["route", "key"]).groupBy("pos").agg(F.min("f").alias("f"))
    known = folders.select(fk.alias("sk")).distinct().withColumn("folder_known", F.lit(True))
    gone = missing.select("batch", F.col("key").alias("tk")).distinct().withColumn("gone", F.lit(True))
    traced = (
        deliveries.withColumn("sk", F.when(F.col("source_prefix") == prefix, name_key(F.col("source_folder"))))
        .withColumn("tk", name_key(F.col("task")))
        .join(reached, "pos", "left")
        .join(known, "sk", "left")
        .join(gone, ["batch", "tk"], "left")
    )
    found = F.when(F.col("audited"), F.col("gone").isNull()).otherwise(F.col("f").isNotNull())
    reason = (
        F.when(found, F.lit(None).cast("string"))
        .when(F.col("audited"), "gone")
        .when(F.col("sk").isNotNull() & F.col("folder_known").isNull(), "gone")
        .when(F.col("source_kind") == "elsewhere", "elsewhere")
        .otherwise("unnamed")
    )
    return traced.select("pos", "batch", "task", found.alias("found"), F.col("f.folder").alias("folder"), reason.alias("reason"))


def mark_rows_delivered(truth: DataFrame, deliveries: DataFrame, prefix: str) -> DataFrame:
    """Task rows marked by unaudited deliveries' names; the index answer stands first."""
    names = spellings(
        name_key(F.col("task")), name_key(F.col("package_name")), F.when(F.col("source_prefix") == prefix, name_key(F.col("source_folder")))
    )
    by_name = (
        deliveries.where("not audited")
        .select("pos", "task", "batch", F.explode(names).alias("key"))
        .groupBy("key")
        .agg(F.min(F.struct("pos", "task", "batch")).alias("d"))
    )
    first = by_name.select(answered(F.col("key")).alias("k1"), F.col("d").alias("d1"))
    second = by_name.select(answered(F.col("key")).alias("k2"), F.col("d").alias("d2"))
    open_row = ~(F.col("delivered") | F.coalesce("maybe_delivered", F.lit(False)))
    hit = F.coalesce("d1", "d2")
    # Few rows name a package, and rows that are not open ask for nothing.
    return (
        truth.withColumn("k1", asked(F.when(open_row, name_key(F.col("name"))), F.col("id")))
        .withColumn("k2", asked(F.when(open_row, name_key(F.col("package_task"))), F.col("id")))
        .select("id", "delivered", "delivered_task", "k1", "k2")
        .join(first, "k1", "left")
        .join(second, "k2", "left")
        .select(
            "id",
            (F.col("delivered") | hit.isNotNull()).alias("delivered"),
            F.coalesce(hit["task"], F.col("delivered_task")).alias("delivered_task"),
            F.when(hit.isNotNull(), F.concat(hit["batch"], F.lit(": the task name it carries"))).alias("delivered_via"),
        )
    )


def trace_counts(traced: DataFrame) -> DataFrame:
    """Found and missing deliveries, and why; the reasons add to the missing."""
    why = lambda r: F.count_if(~F.col("found") & (F.col("reason") == r))
    return traced.agg(
        F.count("*").alias("delivered"),
        F.count_if("found").alias("found"),
        F.count_if(~F.col("found")).alias("missing"),
        why("gone").alias("gone"),
        why("elsewhere").alias("elsewhere"),
        why("unnamed").alias("unnamed"),
        F.count_distinct("batch").alias("batches"),
    )


def cohort_split(folders: DataFrame) -> DataFrame:
    """Accepted folders delivered by manifest, by name, and as another copy."""
    by_name = F.col("delivered") & (F.col("delivered_by") == "name")
    named = (
        folders.where(F.col("delivered") & (F.col("delivered_by") != "name") & F.col("package_task").isNotNull())
        .select(F.lower("package_task").alias("pt"))
        .distinct()
        .withColumn("has_original", F.lit(True))
    )
    return (
        folders.withColumn("pt", F.lower("package_task"))
        .join(named, "pt", "left")
        .agg(
            F.count("*").alias("packages"),
            F.count_if("delivered").alias("delivered"),
            F.count_if(~F.col("delivered")).alias("not_delivered"),
            F.count_if(F.col("delivered") & (F.col("delivered_by") != "name")).alias("by_manifest"),
            F.count_if(by_name).alias("by_name"),
            F.count_if(by_name & F.col("has_original")).alias("copies"),
        )
    )
