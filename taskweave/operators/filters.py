"""Selections. A filter is a mapping of optional facets; an absent facet selects all.

Every facet becomes a Column, so the whole selection is one predicate that
Catalyst can push into the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import manifest_task_key, plain_key, recorded, stem
from taskweave.functions.packages import connector_type
from taskweave.operators.lookups import spellings
from taskweave.operators.postings import Postings



def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def free_text(cols: list[str], term: str) -> Column:
    """Case-insensitive contains over the joined columns."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return text.contains(term.strip().lower())


def date_range(day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range; undated rows are out once a bound is set; an inverted range is empty."""
    if start and end and start > end:
        return F.lit(False)
    bounds = []
    if start:
        bounds.append(day >= F.lit(start).cast("date"))
    if end:
        bounds.append(day <= F.lit(end).cast("date"))
    return _true(all_of(bounds)) if bounds else F.lit(True)


def inverted(start: str | None, end: str | None) -> bool:
    return bool(start and end and start > end)


def collectable() -> Column:
    return _true(F.col("at_current_bar")) & F.col("state").isin("accepted", "legacy accepted")


def ready_for_delivery(held: bool = True) -> Column:
    """Accepted at the bar and not delivered; failed runs are held unless asked for."""
    open_row = collectable() & ~_true(F.col("delivered"))
    return open_row & ~_true(F.col("glm53_failed")) if held else open_row


FAILED_GATE = "GLM-5.3 failed"


def truth_facets(f: Mapping[str, str]) -> dict[str, Column]:
    """The predicate of each facet that ``f`` asks for."""
    get = lambda k: f.get(k) or None
    out: dict[str, Column] = {}
    for facet, column in (
        ("state", "state"), ("domain", "domain"), ("domain_kind", "domain_kind"), ("owner", "owner"), ("confidence", "confidence"), ("side", "side"),
    ):
        if get(facet):
            out[facet] = _true(F.col(column) == f[facet])
    asked_failed = f.get("gate_era") == FAILED_GATE
    if get("gate_era"):
        out["gate_era"] = _true(F.col("glm53_failed")) if asked_failed else _true(F.col("gate_era") == f["gate_era"])
    if get("duplicate"):
        flagged = _true(F.col("possible_duplicate"))
        out["duplicate"] = {"yes": flagged, "no": ~flagged, "likely": _true(F.col("duplicate_tier") == "likely")}.get(f["duplicate"], F.lit(True))
    if get("finding"):
        out["finding"] = _true(F.array_contains("findings", f["finding"]))
    if get("cohort"):
        out["cohort"] = _true(F.array_contains("cohorts", f["cohort"]))
    if get("delivery"):
        at_bar = _true(F.col("at_current_bar"))
        nowhere = ~at_bar & (F.coalesce(F.size("cohorts"), F.lit(0)) < 1)
        out["delivery"] = {"current": at_bar, "gateOnly": _true(F.col("gate_only")), "none": nowhere}.get(f["delivery"], F.lit(True))
    if get("carried_over"):
        out["carried_over"] = _true(F.col("carried_over")) == F.lit(f["carried_over"] == "yes")
    if get("delivered"):
        sent = _true(F.col("delivered"))
        out["delivered"] = {"yes": sent, "ready": ready_for_delivery(held=not asked_failed), "no": ~sent}.get(f["delivered"], F.lit(True))
    if get("connector"):
        kind = connector_type(F.col("connector"), F.col("delivered_type"), F.col("bench"))
        out["connector"] = {"yes": _true(kind), "no": _true(~kind)}.get(f["connector"], kind.isNull())
    if get("bench"):
        b = f["bench"]
        out["bench"] = F.col("bench").isNull() if b == "none" else _true(F.col("bench_side" if b in ("company", "computer") else "bench") == b)
    if get("glm"):
        g, passes = f["glm"], F.col("glm_passes")
        between = _true((passes > 0) & (passes < F.col("glm_trials")))
        out["glm"] = passes.isNull() if g == "none" else between if g == "band" else _true(passes.cast("string") == g)
    if get("search"):
        out["search"] = free_text(["name", "owner", "why", "findings"], f["search"])
    if get("start") or get("end"):
        # A day compares as text does: an undated row is before every day.
        start, end = get("start"), get("end")
        day = F.col("decided")
        lower = _true(day >= F.lit(start).cast("date")) if start else F.lit(True)
        upper = (day.isNull() | (day <= F.lit(end).cast("date"))) if end else F.lit(True)
        out["date"] = lower & upper
    return out


def filter_truth(rows: DataFrame, f: Mapping[str, str]) -> DataFrame:
    return rows.where(all_of(list(truth_facets(f).values())))


NO_VALUE = "(none)"
# Values that stay on offer at zero.
OFFERED = {
    "state": ("accepted", "rejected", "error", "running", "legacy accepted"),
    "delivered": ("yes", "ready", "no"),
    "delivery": ("current", "gateOnly", "none"),
}


def facet_values(f: Mapping[str, str]) -> dict[str, Column]:
    """The values of each facet that a row counts under, as an array; filtering by one of them keeps the row."""
    plain = lambda name: F.array(F.coalesce(F.col(name).cast("string"), F.lit(NO_VALUE)))
    listed = lambda name: F.when(F.size(name) > 0, F.array_distinct(name)).otherwise(F.array(F.lit(NO_VALUE)))
    held = lambda pairs: F.array_compact(F.array(*[F.when(test, F.lit(value)) for value, test in pairs]))
    sent, at_bar, flagged = (_true(F.col(n)) for n in ("delivered", "at_current_bar", "possible_duplicate"))
    kind = connector_type(F.col("connector"), F.col("delivered_type"), F.col("bench"))
    ready = ready_for_delivery(held=f.get("gate_era") != FAILED_GATE)
    passes = F.col("glm_passes")
    return {
        **{name: plain(name) for name in ("state", "domain", "owner", "confidence", "gate_era")},
        "finding": listed("findings"),
        "cohort": listed("cohorts"),
        "delivered": held([("yes", sent), ("ready", ready), ("no", ~sent)]),
        "delivery": held([("current", at_bar), ("gateOnly", _true(F.col("gate_only"))), ("none", ~at_bar & (F.coalesce(F.size("cohorts"), F.lit(0)) < 1))]),
        "carried_over": F.array(F.when(_true(F.col("carried_over")), "yes").otherwise("no")),
        "duplicate": held([("yes", flagged), ("no", ~flagged), ("likely", _true(F.col("duplicate_tier") == "likely"))]),
        "connector": F.array(F.when(kind, "yes").when(~kind, "no").otherwise("unknown")),
        "bench": F.array_compact(F.array(F.coalesce("bench", F.lit("none")), F.when(F.col("bench").isNotNull(), F.col("bench_side")))),
        "glm": F.array_compact(F.array(F.coalesce(passes.cast("string"), F.lit("none")), F.when(_true((passes > 0) & (passes < F.col("glm_trials"))), F.lit("band")))),
    }


def facet_counts(rows: DataFrame, f: Mapping[str, str], facets: list[str]) -> DataFrame:
    """(facet, value, n): counts per value with that facet's own filter removed.

    One pass: a row that passes all other facets is exploded into its values of a facet;
    list facets count it under each of theirs. Offered values stay at zero. The failed gate
    stands among the gate eras and is counted with itself as the filter, as filtering would.
    """
    tests, values = truth_facets(f), facet_values(f)
    others = lambda of, facet: all_of([p for name, p in of.items() if name != facet])
    nothing = F.array().cast("array<struct<facet: string, value: string, n: int>>")
    parts = [F.when(others(tests, facet), _entries(facet, values[facet])).otherwise(nothing) for facet in facets]
    if "gate_era" in facets:
        failed = truth_facets({**f, "gate_era": FAILED_GATE})
        parts.append(F.when(all_of(list(failed.values())), _entries("gate_era", F.array(F.lit(FAILED_GATE)))).otherwise(nothing))
    counted = rows.select(F.inline(F.concat(*parts)))
    offered = [(facet, value, 0) for facet in facets for value in OFFERED.get(facet, ())]
    if offered:
        counted = counted.union(rows.sparkSession.createDataFrame(offered, "facet string, value string, n int"))
    return counted.groupBy("facet", "value").agg(F.sum("n").alias("n"))


def _entries(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"), F.lit(1).alias("n")))


def filter_delivery(rows: DataFrame, f: Mapping[str, str]) -> DataFrame:
    """Delivered packages by facet; ``(not recorded)`` is a value like any other."""
    tests = [
        recorded(F.col(k)) == f[k]
        for k in ("batch", "category", "type", "difficulty", "acceptance", "priority", "trainer", "source", "score")
        if f.get(k)
    ]
    if f.get("flagged"):
        flagged = F.size("flags") > 0
        tests.append(flagged if f["flagged"] == "yes" else ~flagged)
    if f.get("search"):
        tests.append(free_text(["task", "package_name", "sha256", "trainer", "category", "batch"], f["search"]))
    return rows.where(all_of(tests))


def filter_finalisation(rows: DataFrame, f: Mapping) -> DataFrame:
    """Folders by population, owner, bench, ownership, type, domain, date and copies."""
    tests = [F.col(k) == f[k] for k in ("outcome", "cohort", "bench", "ownership", "type", "domain") if f.get(k)]
    if f.get("emails") is not None:
        tests.append(F.lower("owner").isin(*f["emails"]))
    if f.get("search"):
        tests.append(free_text(["declared_short", "declared_name", "folder", "owner", "sha256"], f["search"]))
    tests.append(date_range(F.col("updated"), f.get("start"), f.get("end")))
    mode = f.get("duplicates")
    if mode:
        tests.append(~F.col("duplicate") if mode == "unique" else F.col("duplicate") if mode == "duplicates" else F.col("group_size") > 1)
    return rows.where(_true(all_of(tests)))


def filter_console(rows: DataFrame, f: Mapping) -> DataFrame:
    """Console tasks by legacy scope, status, owner, type, bench, evidence and date."""
    tests = []
    if f.get("legacy") != "all":
        tests.append(F.col("legacy") if f.get("legacy") == "only" else ~F.col("legacy"))
    tests += [F.col(c) == f[k] for k, c in (("status", "status"), ("type", "task_type"), ("trainer", "owner"), ("bench", "bench")) if f.get(k)]
    kinds = {
        "delivered": F.col("folders") > 0,
        "undelivered": F.col("folders") == 0,
        "disagree": F.col("disagrees"),
        "offroster": F.col("owner").isNotNull() & ~F.col("on_roster"),
    }
    if f.get("evidence") in kinds:
        tests.append(kinds[f["evidence"]])
    if f.get("search"):
        tests.append(free_text(["key", "owner"], f["search"]))
    tests.append(date_range(F.col("day"), f.get("start"), f.get("end")))
    return rows.where(_true(all_of(tests)))


def filter_ledger(rows: DataFrame, f: Mapping) -> DataFrame:
    """Ledger tasks by payment, type, validity, repeats, bench, person and text."""
    tests = [F.col(c) == f[k] for k, c in (("bench", "bench"), ("payment", "payment_state")) if f.get(k)]
    if f.get("type"):
        tests.append(F.coalesce("type", F.lit("Not recorded")) == f["type"])
    if f.get("validity"):
        tests.append(F.col("valid") == F.lit(f["validity"] == "valid"))
    if f.get("duplicates"):
        tests.append(F.col("duplicate_rows") > 0 if f["duplicates"] == "duplicates" else F.col("duplicate_rows") == 0)
    if f.get("emails") is not None:
        tests.append(F.col("email").isin(*f["emails"]))
    if f.get("search"):
        tests.append(free_text(["task", "email", "cj"], f["search"]))
    return rows.where(_true(all_of(tests)))


def filter_people(rows: DataFrame, payment: str | None = None, search: str | None = None) -> DataFrame:
    """People by payment state and text, most owed first."""
    states = {
        "pending": F.col("pending_tasks") > 0, "paid": F.col("paid_tasks") > 0,
        "no-paid": F.col("paid_tasks") == 0, "no-accepted": F.col("accepted_tasks") == 0,
    }
    tests = [states[payment]] if payment else []
    if search:
        tests.append(free_text(["name", "email", "team", "manager"], search))
    return rows.where(all_of(tests)).orderBy(F.col("pending_amount").desc(), F.col("accepted_tasks").desc(), "email")


def find_folders(folders: Postings, term: str, limit: int | None = None) -> DataFrame:
    """Folder paths that contain a term of three characters or more; the first ``limit`` if a page asks for so many."""
    found = folders.search(term).orderBy("path")
    return found if limit is None else found.limit(limit)


# ------------------------------------------------------- earlier manifests' work
def exclusion_key(value: Column) -> Column:
    """The key an earlier manifest's entry is excluded by."""
    text = plain_key(value)
    bare = lambda c: F.regexp_replace(c, r"^(harbor|obi)/", "")
    return (
        F.when(text.startswith("folder:"), text)
        .when(text.startswith("task:"), F.concat(F.lit("task:"), stem(bare(F.regexp_replace(text, "^task:", "")))))
        .otherwise(stem(bare(text)))
    )


def names_from_delivery(manifest: DataFrame) -> DataFrame:
    """(value): every name a delivery manifest's entries claim, folders and names."""
    folder_of_uri = F.regexp_extract("source_uri", r"/tasks/[^/]+/([^/]+)/[^/]+$", 1)
    leaf = F.regexp_replace(F.substring_index(F.coalesce("original_filename", "package_path"), "/", -1), r"(?i)\.zip$", "")
    bare = lambda c: F.regexp_replace(c, r"(?i)^(harbor|obi)/", "")
    folders = F.transform(
        spellings(F.col("source_folder"), folder_of_uri, bare(F.col("task_id")), leaf), lambda x: F.concat(F.lit("folder:"), plain_key(x))
    )
    names = spellings(bare(F.col("task_name")), bare(F.col("task_id")))
    return manifest.select(F.explode(F.concat(folders, names)).alias("value")).distinct()


def exclude_previous(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows that no earlier manifest names, by task, folder or name in any spelling."""
    keys = names.select(exclusion_key(F.col("value")).alias("key")).distinct()
    bare = lambda c: stem(plain_key(F.regexp_replace(F.trim(c), r"(?i)^(harbor|obi)/", "")))
    own = spellings(
        manifest_task_key(F.col("package_task"), F.col("cohort_folder"), F.col("name")),
        F.concat(F.lit("folder:"), plain_key(F.col("cohort_folder"))),
        bare(F.col("name")),
        bare(F.col("package_task")),
    )
    named = rows.select("id", F.explode(own).alias("key")).join(keys, "key", "left_semi").select("id").distinct()
    return rows.join(named, "id", "left_anti")
