"""Task names, identifiers and the keys they are matched on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns, as the data writes them.
NAMESPACE = r"^(harbor/)?(obi/)?"
ANY_NAMESPACE = r"^(harbor|obi)/"
VERSION_SUFFIX = r"(-(final|v\d+|\d{4,}|copy|new|fixed|updated))+$"
PLACEHOLDERS = {
    "delivered": r"(?i)^(harbor-single-task-|autorun-|content-[0-9a-f]{16,}|task\d*$|task[-_]|g\d+_|code-c\d+$|tasks?$)",
    "cohort": r"(?i)^(task\d*|tasks?|harbor-single-task-\S*|autorun-\S*|content-[0-9a-f]{16,}|code-c\d+|g\d+_\S*)$",
    "manifest": r"(?i)^(autorun-|harbor-single-task-|content-[0-9a-f]{12,})",
}
NOT_A_PERSON = r"(?i)gserviceaccount\.com$|^companybench@|^dev@localhost$|harbor-operator"
NAMES_IN_IDS = (r"^task:(?:harbor/)?(.+)$", r"^family:(.+?)-\d{8}t[\dz]*-?[0-9a-f]{4,}$", r"^family:(.+?)-[0-9a-f]{6,}$")
BARE_HASH = r"^[0-9a-f]{16,}$"
ZIP_SUFFIX = r"\.zip$"
TASK_PREFIX = r"^task-"
HASHED_VERSION = r"-[0-9a-f]{6}-v\d+$"
SHEET_SUFFIX = r"(-v\d+|-fixed|-final)+$"
TRACKED_NAME = r"^\d{6}-(.+)$"
TRACKER_ID = r"^(?:(\d{6})-|(astr_\d+|cb\d_\d+))"
PACKAGE_VERSION = r"(-v\d+)+$"
LEGACY_SUFFIXES = (
    r"-(?:v|version)[0-9][a-z0-9.-]*$",
    r"-(?:final|modified|reviewed(?:-[0-9]+)?|hardened|candidate|clean|submit)$",
    r"-[0-9]{8}t[0-9]{6}z(?:-[0-9]+-?[0-9]*)?$",
)
BATCH_SERIES = (r"(?i)^batch\b", r"(?i)^companybench\b")
# Where a readable name comes from.
NAME_RECORDED = "pipeline"
NAME_DERIVED = "derived from the verdict identifier"
NAME_UNKNOWN = "placeholder; no readable name recorded"

NOT_RECORDED = "(not recorded)"
WHITESPACE = " \t\n\r\x0b\x0c"


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with empty text as NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def plain_key(c: Column) -> Column:
    """Trimmed, lower-cased text."""
    return F.lower(F.trim(c, F.lit(WHITESPACE)))


def name_key(c: Column) -> Column:
    """The key a task name is matched on: no case, no namespace."""
    return F.regexp_replace(plain_key(c), NAMESPACE, "")


def bench_key(c: Column) -> Column:
    """Like :func:`name_key`, dropping a single namespace only."""
    return F.regexp_replace(plain_key(c), ANY_NAMESPACE, "")


def stem(c: Column) -> Column:
    """Drop every trailing version or status suffix from a key."""
    return F.regexp_replace(c, VERSION_SUFFIX, "")


def norm_name(c: Column) -> Column:
    return stem(name_key(c))


def is_placeholder(c: Column, kind: str = "delivered") -> Column:
    """Whether a machine, not a person, chose the name."""
    return c.rlike(PLACEHOLDERS[kind])


def readable_name(identifier: Column, name: Column) -> Column:
    """(name, source): a placeholder is replaced by the name the id spells."""
    ident = F.lower(identifier)
    tries = [F.regexp_extract(ident, pattern, 1) for pattern in NAMES_IN_IDS]

    def usable(found: Column) -> Column:
        return F.when(
            (found != "") & ~is_placeholder(found, "manifest") & ~found.rlike(BARE_HASH), found
        )

    recovered = F.coalesce(*[usable(t) for t in tries])
    said = lambda value, source: F.struct(value.alias("name"), F.lit(source).alias("source"))
    return F.when(~is_placeholder(name, "manifest"), said(name, NAME_RECORDED)).when(recovered.isNotNull(), said(recovered, NAME_DERIVED)).otherwise(said(name, NAME_UNKNOWN))


# Spellings that one name may have, as steps: (column, how it comes from the column before it or another).
SPELLING_STEPS = (
    ("y", "x", lambda v: F.regexp_replace(v, TASK_PREFIX, "")),
    ("z", "y", lambda v: F.regexp_replace(v, HASHED_VERSION, "")),
    ("w", "z", lambda v: F.regexp_replace(v, SHEET_SUFFIX, "")),
    ("t", "z", lambda v: F.regexp_extract(v, TRACKED_NAME, 1)),
)


def bare_name(c: Column) -> Column:
    """A name without case, namespace and .zip."""
    return F.regexp_replace(bench_key(c), ZIP_SUFFIX, "")


def with_underscores(c: Column) -> Column:
    """A name as it is and with hyphens for underscores."""
    return F.array_distinct(F.array(c, F.replace(c, F.lit("_"), F.lit("-"))))


def name_variants(c: Column) -> Column:
    """Every spelling of one name a manifest or a sheet may use."""

    def spellings(x: Column) -> Column:
        made = {"x": x}
        for name, base, step in SPELLING_STEPS:
            made[name] = step(made[base])
        return F.array(*made.values())

    every = F.flatten(F.transform(with_underscores(bare_name(c)), spellings))
    kept = F.array_distinct(F.filter(every, lambda x: F.length(x) > 6))
    return F.when(c.isNull() | (plain_key(c) == "none"), F.array().cast("array<string>")).otherwise(kept)


def tracker_key(c: Column) -> Column:
    """``tt:<id>`` for a name that starts with a tracker id, else NULL."""
    text = F.lower(c)
    found, other = (F.regexp_extract(text, TRACKER_ID, group) for group in (1, 2))
    return F.when(found != "", F.concat(F.lit("tt:"), found)).when(other != "", F.concat(F.lit("tt:"), other))


def package_key(path: Column) -> Column:
    """A package path's task folder: the leaf, no .zip, no -vN."""
    tidy = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/+$", "")
    leaf = F.regexp_replace(F.lower(F.substring_index(tidy, "/", -1)), ZIP_SUFFIX, "")
    return F.regexp_replace(leaf, PACKAGE_VERSION, "")


def legacy_task_key(c: Column) -> Column:
    """The older key: no version, review or timestamp suffix."""
    key = F.lower(c)
    for suffix in LEGACY_SUFFIXES:
        key = F.regexp_replace(key, suffix, "")
    return key


def truth_task_key(folder: Column, delivered_task: Column, name: Column) -> Column:
    """Which task a truth row is: its folder, else its audited task, else its name."""
    return F.coalesce(
        F.concat(F.lit("folder:"), plain_key(folder)),
        F.concat(F.lit("audit:"), plain_key(delivered_task)),
        F.concat(F.lit("name:"), stem(plain_key(name))),
    )


def manifest_task_key(package_task: Column, folder: Column, name: Column) -> Column:
    """Which task a hand-over row is: its package's task, else folder, else name."""
    return F.coalesce(
        F.concat(F.lit("task:"), stem(plain_key(F.regexp_replace(F.trim(package_task), "(?i)" + ANY_NAMESPACE, "")))),
        F.concat(F.lit("folder:"), plain_key(folder)),
        stem(plain_key(name)),
    )


def batch_order(batch: Column) -> list[Column]:
    """Sort keys: own batches, then bench batches, then others; by number; by text."""
    own, bench = BATCH_SERIES
    series = F.when(batch.rlike(own), 0).when(batch.rlike(bench), 1).otherwise(2)
    digits = F.regexp_extract(F.regexp_replace(batch, r"[^\d.]", ""), r"^(\d*\.?\d*)", 1)
    return [series, F.coalesce(digits.try_cast("double"), F.lit(0.0)), batch]


def is_person(email: Column, others: str = NOT_A_PERSON) -> Column:
    """A person's address, not a service account or a shared login, which ``others`` matches."""
    return F.coalesce(email.contains("@") & ~email.rlike(others), F.lit(False))


def runs_bucket(n: Column) -> Column:
    return F.when(n >= 8, F.lit("8+")).otherwise(n.cast("string"))


def recorded(c: Column) -> Column:
    """A missing dimension shown as its own value."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NOT_RECORDED))
