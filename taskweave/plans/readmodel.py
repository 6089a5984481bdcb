"""Selections, figures, series, orders and set operations over published rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import packages as K
from taskweave.operators import audits as U
from taskweave.operators import figures as G
from taskweave.operators import filters as S
from taskweave.operators import ordering as O
from taskweave.operators import owners as W
from taskweave.operators import segments as B
from taskweave.operators import series as D
from taskweave.operators import state as ST
from taskweave.operators.postings import Postings
from taskweave.plans import fragments as X
from taskweave.plans.delivered import _TRACE, traced
from taskweave.plans.packages import CTYPE
from taskweave.plans.people import _FINDUP, _PEOPLE, _ROWS, books
from taskweave.plans.people import rows as payout_rows
from taskweave.plans.registry import query
from taskweave.sources import listings as L

c = F.col
STATES = ["accepted", "legacy accepted", "rejected", "running", "queued", "error", "no QC decision"]
COLLECT = "at_current_bar and state in ('accepted', 'legacy accepted')"
TKEY = f"coalesce('folder:' || cohort_folder, 'audit:' || delivered_task, 'name:' || {X.stem('lower(name)')})"
MKEY = f"coalesce('task:' || {X.stem('package_task')}, 'folder:' || cohort_folder, {X.stem('lower(name)')})"
PREFER = "decided desc nulls last, runs desc, id"


def delivery_rows(t):
    """Delivered packages with the columns the delivery view shows."""
    return t.r3_deliveries.select(
        "*",
        K.merged_category(c("category")).alias("cat"),
        K.score_bucket(c("bucket"), c("glm")).alias("score"),
        K.row_flags(*map(c, ("owner_contested", "ambiguous", "unverified", "version_dependent"))).alias("flags"),
        F.when(F.lower("trainer") != "unattributed", c("trainer")).alias("named"),
        F.round(c("size_bytes") / 1e6, 2).alias("size_mb"),
    ).drop("category", "trainer").withColumnsRenamed({"cat": "category", "named": "trainer"})


DEL = """del as (select * replace (case category when 'Code' then 'Engineering' when 'Law' then 'Legal' when 'Non-Connector · Legal' then 'Legal' else category end as category, case when lower(trainer) <> 'unattributed' then trainer end as trainer),
  coalesce(bucket, cast(glm as string) || '/4', '(not recorded)') as score, owner_contested or ambiguous or unverified or version_dependent as is_flagged, round(size_bytes / 1e6, 2) as size_mb from r3_deliveries)"""


# --------------------------------------------------------------------- filters
FILTERS = {
    "state": ({"state": "accepted"}, "state = 'accepted'"),
    "gate": ({"gate_era": "KESTREL on"}, "gate_era = 'KESTREL on'"),
    "failed gate, ready": ({"gate_era": "GLM-5.3 failed", "delivered": "ready"}, f"glm53_failed and {COLLECT} and not delivered"),
    "owner and dates": ({"owner": "u7@x.com", "start": "2024-01-05", "end": "2024-01-20"}, "owner = 'u7@x.com' and decided between date '2024-01-05' and date '2024-01-20'"),
    "until": ({"end": "2024-01-20"}, "decided is null or decided <= date '2024-01-20'"),
    "likely": ({"duplicate": "likely"}, "duplicate_tier = 'likely'"),
    "not duplicate": ({"duplicate": "no", "confidence": "low"}, "not possible_duplicate and confidence = 'low'"),
    "finding": ({"finding": "HARBOR-CHECK"}, "list_contains(findings, 'HARBOR-CHECK')"),
    "cohort": ({"cohort": "qc_accepted"}, "list_contains(cohorts, 'qc_accepted')"),
    "no package": ({"delivery": "none"}, "not at_current_bar and cohorts is null"),
    "gate only": ({"delivery": "gateOnly", "carried_over": "no"}, "gate_only and not carried_over"),
    "ready": ({"delivered": "ready"}, f"{COLLECT} and not delivered and not glm53_failed"),
    "not delivered": ({"delivered": "no", "domain": "Legal"}, "not delivered and domain = 'Legal'"),
    "connector": ({"connector": "yes"}, f"{CTYPE}"),
    "connector unknown": ({"connector": "unknown"}, f"{CTYPE} is null"),
    "bench side": ({"bench": "company"}, "bench_side = 'company'"),
    "no bench": ({"bench": "none"}, "bench is null"),
    "band": ({"glm": "band"}, "glm_passes > 0 and glm_passes < glm_trials"),
    "no score": ({"glm": "none", "search": " U1"}, "glm_passes is null and (name || ' ' || coalesce(owner, '') || ' ' || why || ' ' || coalesce(array_to_string(findings, ' '), '')) ilike '%u1%'"),
    "score": ({"glm": "2"}, "glm_passes = 2"),
}


@query("f01_filter_truth", " union all ".join(f"select '{k}' as facet, count(*) as n, cast(sum(pos) as bigint) as pos_sum from r10_truth where {w}" for k, (_f, w) in FILTERS.items()))
def _(t):
    rows = t.r10_truth
    flags = [F.when(S.all_of(list(S.truth_facets(f).values())), F.lit(name)) for name, (f, _w) in FILTERS.items()]
    hits = rows.select("pos", F.explode(F.array_compact(F.array(*flags))).alias("facet"))
    return hits.groupBy("facet").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query(
    "f02_filter_delivery",
    f"with {DEL} select id, batch, trainer, score from del where category is null and type = 'Connector' and not is_flagged and (task || coalesce(package_name, '')) ilike '%code%'",
)
def _(t):
    f = {"category": "(not recorded)", "type": "Connector", "flagged": "no", "search": "Code"}
    return S.filter_delivery(delivery_rows(t), f).select("id", "batch", "trainer", "score")


@query(
    "f03_filter_finalisation",
    f"{_FINDUP} select pos from x join g using (name) where outcome = 'accepted' and group_size > 1 and updated between date '2024-01-10' and date '2024-02-05'",
)
def _(t):
    rows = t.r11_folders.join(W.finalisation_duplicates(t.r11_folders), "pos")
    f = {"outcome": "accepted", "duplicates": "groups", "start": "2024-01-10", "end": "2024-02-05"}
    return S.filter_finalisation(rows, f).select("pos")


@query("f05_filter_ledger", f"with {_PEOPLE} select task_key, email from st where payment_state = 'Not itemised' and type is null and valid and bench = 'computer' and task ilike '%code%'")
def _(t):
    from taskweave.operators.payouts import payment_state

    ledger, _requests, people = books(t)
    f = {"payment": "Not itemised", "type": "Not recorded", "validity": "valid", "bench": "computer", "search": "CODE"}
    return S.filter_ledger(payment_state(ledger, people), f).select("task_key", "email")


@query("f06_date_range", "select event_id from events where cast(ts as date) between date '2024-01-03' and date '2024-01-09'")
def _(t):
    return t.events.where(S.date_range(F.to_date("ts"), "2024-01-03", "2024-01-09")).select("event_id")


@query("f07_free_text", "select doc_id from documents where (coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')) ilike '%tion en%'")
def _(t):
    return t.documents.where(S.free_text(["lang", "source", "text"], " tiON en ")).select("doc_id")


@query("f08_ready_for_delivery", f"select id from r10_truth where {COLLECT} and not delivered and not glm53_failed")
def _(t):
    return t.r10_truth.where(S.ready_for_delivery()).select("id")


@query(
    "f09_exclude_previous",
    f"""with e as (select distinct 'folder:' || lower(folder) as key from r16_manifest union select distinct 'folder:' || lower(coalesce(task_id, '')) from r16_manifest where task_id is not null
  union select {X.stem("lower(name)")} from r16_manifest union select {X.stem("lower(task_id)")} from r16_manifest where task_id is not null)
select id from r10_truth where {MKEY} not in (select key from e) and coalesce('folder:' || cohort_folder, '') not in (select key from e) and {X.stem("lower(name)")} not in (select key from e) and coalesce({X.stem("package_task")}, '') not in (select key from e)""",
)
def _(t):
    m = t.r16_manifest.select(c("name").alias("task_name"), "task_id", c("folder").alias("source_folder"), "source_uri", F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("package_path"))
    return S.exclude_previous(t.r10_truth, S.names_from_delivery(m)).select("id")


# Each facet's filter here, and the values a row counts under, as SQL.
_FACET = {
    "finding": "list_contains(findings, 'HARBOR-CHECK')", "cohort": "list_contains(cohorts, 'qc_accepted')",
    "delivered": "not delivered", "carried_over": "not carried_over",
}
_FACET_FILTER = {"finding": "HARBOR-CHECK", "cohort": "qc_accepted", "delivered": "no", "carried_over": "no"}
_FACET_VALUES = {
    **{name: f"[coalesce({name}, '(none)')]" for name in ("state", "gate_era", "domain", "owner")},
    "finding": "case when len(findings) > 0 then list_distinct(findings) else ['(none)'] end",
    "cohort": "case when len(cohorts) > 0 then list_distinct(cohorts) else ['(none)'] end",
    "delivered": f"[case when delivered then 'yes' end, case when {COLLECT} and not delivered and not glm53_failed then 'ready' end, case when not delivered then 'no' end]",
    "delivery": "[case when at_current_bar then 'current' end, case when gate_only then 'gateOnly' end, case when not at_current_bar and cohorts is null then 'none' end]",
    "carried_over": "[case when carried_over then 'yes' else 'no' end]",
    "duplicate": "[case when possible_duplicate then 'yes' end, case when not possible_duplicate then 'no' end, case when duplicate_tier = 'likely' then 'likely' end]",
    "connector": f"[case when {CTYPE} then 'yes' when not {CTYPE} then 'no' else 'unknown' end]",
    "bench": "[coalesce(bench, 'none'), case when bench is not null then bench_side end]",
    "glm": "[coalesce(cast(glm_passes as string), 'none'), case when glm_passes > 0 and glm_passes < glm_trials then 'band' end]",
}


def _facet_sql(asked: dict) -> str:
    others = lambda facet: " and ".join(["true", *[w for k, w in asked.items() if k != facet]])
    parts = [f"select '{facet}' as facet, value, 1 as n from (select unnest({values}) as value from r10_truth where {others(facet)}) where value is not null" for facet, values in _FACET_VALUES.items()]
    parts.append(f"select 'gate_era', 'GLM-5.3 failed', 1 from r10_truth where glm53_failed and {others('gate_era')}")
    parts += [f"select '{facet}', '{value}', 0" for facet, values in S.OFFERED.items() for value in values]
    return f"select facet, value, cast(sum(n) as bigint) as n from ({' union all '.join(parts)}) group by 1, 2"


@query("f10_facet_counts", _facet_sql(_FACET))
def _(t):
    return S.facet_counts(t.r10_truth, _FACET_FILTER, list(_FACET_VALUES))


@query("f11_filter_people", f"with {_ROWS} select email, pending_amount from pr where pending_tasks > 0 and (name || email || team || manager) ilike '%computer a%'")
def _(t):
    return S.filter_people(payout_rows(t), "pending", "Computer A").select("email", "pending_amount")


@query("f12_find_folders", "select distinct regexp_replace(name, '/[^/]*$', '') as path from r2_objects where regexp_replace(name, '/[^/]*$', '') ilike '%task-1%' order by 1")
def _(t):
    paths = t.r2_objects.select(F.regexp_replace("name", "/[^/]*$", "").alias("path")).distinct()
    return S.find_folders(Postings(paths, c("path")), "TASK-1")


# --------------------------------------------------------------------- figures
_VERS = f"v as (select *, {TKEY} as version_key, row_number() over (partition by {TKEY} order by {PREFER}) as rn, count(*) over (partition by {TKEY}) as versions from r10_truth)"


@query(
    "a10_collapse_by_task",
    f"""with {_VERS} select a.version_key, a.id, a.versions, case when b.id is null then null when a.decided is distinct from b.decided then 'decided later than the others' when a.runs <> b.runs then 'got furthest, tied on decision date'
  else 'tied on date and progress; chosen by identifier' end as chosen_because from v a left join v b on b.version_key = a.version_key and b.rn = 2 where a.rn = 1""",
)
def _(t):
    return G.collapse_by_task(t.r10_truth)


@query("a10_other_versions", f"with {_VERS} select version_key, id from v where rn > 1")
def _(t):
    return G.other_versions(t.r10_truth, G.collapse_by_task(t.r10_truth)).select("version_key", "id")


@query("w02_preferred_row", f"select {TKEY} as key, id from r10_truth qualify row_number() over (partition by {TKEY} order by {PREFER}) = 1")
def _(t):
    return G.preferred_row(t.r10_truth, N.truth_task_key(c("cohort_folder"), c("delivered_task"), c("name")))


@query("a11_task_fold", f"with x as (select count(*) as folders, count(distinct coalesce('task:' || {X.key('package_task')}, 'folder:' || lower(folder))) as tasks from r11_folders) select *, folders - tasks as extra_folders from x")
def _(t):
    return G.task_fold(t.r11_folders)


_FIG = {
    "rows": "true", "accepted": "state = 'accepted'", "legacy_accepted": "state = 'legacy accepted'", "rejected": "state = 'rejected'", "running": "state = 'running'",
    "undecided": "state in ('error', 'no QC decision', 'queued', 'not started')", "carried_over": "carried_over", "gate_only": "gate_only", "at_current_bar": "at_current_bar", "delivered": "delivered",
    "connector_tasks": "connector", "non_connector_tasks": "not connector", "connector_unknown": "connector is null", "maybe_delivered": "maybe_delivered",
    "ready_for_delivery": f"{COLLECT} and not delivered and not glm53_failed", "accepted_at_bar_rows": COLLECT, "delivered_at_bar_rows": f"{COLLECT} and delivered", "unmerged": "unmerged",
    "possible_duplicates": "possible_duplicate", "likely_duplicates": "duplicate_tier = 'likely'", "inferred_dates": "decided_inferred",
}
_FIGD = {
    "ready_names": ("lower(trim(name))", f"{COLLECT} and not delivered and not glm53_failed"), "delivered_names": ("lower(trim(name))", "delivered"), "delivered_tasks": (TKEY, "delivered"),
    "ready_tasks": (TKEY, f"{COLLECT} and not delivered and not glm53_failed"), "glm53_held_tasks": (TKEY, f"{COLLECT} and not delivered and glm53_failed"), "glm53_failed_tasks": (TKEY, "not delivered and glm53_failed"),
    "accepted_at_bar_tasks": (TKEY, COLLECT), "delivered_at_bar_tasks": (TKEY, f"{COLLECT} and delivered"), "owners": ("owner", "true"),
}


@query(
    "a12_truth_figures",
    " union all ".join([f"select '{k}' as measure, count(*) as value from r10_truth where {w}" for k, w in _FIG.items()] + [f"select '{k}', count(distinct {e}) from r10_truth where {w}" for k, (e, w) in _FIGD.items()]),
)
def _(t):
    return G.truth_figures(t.r10_truth)


_DAILY = "daily as (select state, decided, count(*) as n, count(*) filter (where decided_inferred) as i from r10_truth where decided is not null group by 1, 2)"


@query("a13_delta_totals", f"with {_DAILY}, p as (select * from daily qualify row_number() over (partition by state order by n desc, decided) = 1) select d.state, cast(sum(d.n) as bigint) as tasks, cast(sum(d.i) as bigint) as inferred, min(p.decided) as peak_day, min(p.n) as peak from daily d join p using (state) group by 1")
def _(t):
    return G.delta_totals(t.r10_truth)


@query("a13_undated", "select count(*) as rows, count(*) - count(decided) as undated from r10_truth")
def _(t):
    return G.undated(t.r10_truth)


@query(
    "a17_verdict_rate",
    """with x as (select case when grouping(batch) = 1 then 'All batches' else batch end as batch, count(*) as tasks, count(*) filter (where acceptance = 'Accepted') as accepted, count(*) filter (where acceptance = 'Rejected') as rejected from r3_deliveries group by rollup (batch))
select *, tasks - accepted - rejected as pending, cast(floor(accepted * 100 / (accepted + rejected) + 0.5) as bigint) as rate from x""",
)
def _(t):
    return G.verdict_rate(t.r3_deliveries)


@query(
    "a18_category_glm_crosstab",
    f"""with {DEL} select coalesce(category, '(not recorded)') as category, {", ".join(f"count(*) filter (where score = '{i}/4') as \"{i}_of_4\"" for i in range(5))}, count(*) filter (where score = '(not recorded)') as not_recorded, count(*) as sum from del group by 1""",
)
def _(t):
    return G.category_score_crosstab(delivery_rows(t))


@query("a19_tally_by", f"with {DEL} " + " union all ".join(f"select '{d}' as dimension, coalesce({d}, '(not recorded)') as value, count(*) as n from del group by 2" for d in G.DIMENSIONS))
def _(t):
    return G.tally_by(delivery_rows(t))


@query(
    "a20_delivery_summary",
    f"""with {DEL} select count(*) as packages, count(trainer) as attributed, count(*) filter (where ambiguous) as contested, count(*) filter (where is_flagged) as flagged, count(*) filter (where type = 'Connector') as connectors,
  count(*) filter (where difficulty = 'Harder') as harder, count(distinct trainer) as trainers, round(sum(size_mb), 2) as megabytes, cast(floor(count(trainer) * 100 / count(*) + 0.5) as bigint) as coverage from del""",
)
def _(t):
    return G.delivery_summary(delivery_rows(t))


_CUR = """cur as (select case o_custkey % 3 when 0 then 'Company' when 1 then 'Computer' else 'Unassigned' end as bench, case o_orderstatus when 'F' then 'Accepted' when 'P' then 'Rejected' else 'Submitted' end as status from orders)"""


def current_cycles(t):
    return t.orders.selectExpr(
        "case o_custkey % 3 when 0 then 'Company' when 1 then 'Computer' else 'Unassigned' end as bench",
        "case o_orderstatus when 'F' then 'Accepted' when 'P' then 'Rejected' else 'Submitted' end as status",
    )


@query(
    "a38_bench_cards",
    f"""with {_CUR}, fo as (select case pos % 3 when 0 then 'Company' when 1 then 'Computer' else 'Unassigned' end as bench, coalesce(declared_short, folder) as name from r11_folders),
a as (select bench, count(*) as tasks, count(*) filter (where status = 'Accepted') as accepted from cur group by 1), b as (select bench, count(distinct name) as finalised from fo group by 1)
select bench, tasks, accepted, finalised, cast(floor(accepted * 100 / tasks + 0.5) as bigint) as rate, row_number() over (order by accepted desc, tasks desc, bench) as rank from a join b using (bench)""",
)
def _(t):
    folders = t.r11_folders.select(F.expr("case pos % 3 when 0 then 'Company' when 1 then 'Computer' else 'Unassigned' end").alias("bench"), F.coalesce("declared_short", "folder").alias("name"))
    return G.bench_cards(current_cycles(t), folders)


@query("a38_status_mix", f"with {_CUR} select bench, status, count(*) as n from cur group by 1, 2")
def _(t):
    return G.status_mix(current_cycles(t))


@query(
    "w07_rank_medals",
    f"with {_ROWS}, t as (select team, cast(sum(accepted_tasks) as bigint) as accepted, cast(sum(paid_amount) as bigint) as paid from pr group by 1) select team, accepted, paid, row_number() over (order by accepted desc, paid desc, team) as rank from t",
)
def _(t):
    teams = payout_rows(t).groupBy("team").agg(F.sum("accepted_tasks").alias("accepted"), F.sum("paid_amount").alias("paid"))
    return G.rank_medals(teams, ["accepted", "paid"], "team")


@query(
    "a39_carried_over_report",
    """with b as (select * from r10_truth where carried_over) select 'carried_over' as measure, count(*) as value from b union all select 'now_accepted', count(*) from b where state = 'accepted' union all select 'legacy_accepted', count(*) from b where state = 'legacy accepted'
union all select 'rejected', count(*) from b where state = 'rejected' union all select 'unresolved', count(*) from b where state not in ('accepted', 'legacy accepted', 'rejected') union all select 'five_plus', count(*) from b where runs >= 5
union all select 'most_runs', cast(max(runs) as bigint) from b union all select 'median_runs', cast(list_sort(list(runs))[cast(floor(count(*) / 2) as int) + 1] as bigint) from b""",
)
def _(t):
    return G.carried_figures(t.r10_truth)


@query("a39_carried_runs", "select case when runs >= 8 then '8+' else cast(runs as string) end as bucket, state, count(*) as n from r10_truth where carried_over group by 1, 2")
def _(t):
    return G.carried_runs(t.r10_truth)


@query("a39_carried_owners", "select owner, count(*) as n, count(*) filter (where state in ('accepted', 'legacy accepted')) as settled from r10_truth where carried_over and owner is not null group by 1 order by 2 desc, 3 desc, 1")
def _(t):
    return G.carried_owners(t.r10_truth)


@query("a39_carried_reasons", "select 'why' as kind, why as value, count(*) as n from r10_truth where carried_over group by 2 union all select 'finding', f, count(*) from (select unnest(findings) as f from r10_truth where carried_over) group by 2")
def _(t):
    return G.carried_reasons(t.r10_truth)


_BAND = "band as (select task, count(*) filter (where reward = 1.0) as passes, count(*) as trials, count(reward) as read from r8_trials group by 1 having count(reward) > 0)"


@query("a40_glm_band", f"with {_BAND} select * from band")
def _(t):
    return G.glm_band(t.r8_trials)


@query("a40_band_histogram", f"with {_BAND} select cast(passes as string) || '/' || cast(trials as string) as band, count(*) as tasks from band group by 1")
def _(t):
    return G.band_histogram(G.glm_band(t.r8_trials))


@query(
    "a41_glm53_fold",
    """select task, min(passes) filter (where complete) as passes, coalesce(max(passes) filter (where complete) = 0, false) as failed, count(distinct passes = 0) filter (where complete) > 1 as disagree, count(*) as runs from r8_trials group by 1""",
)
def _(t):
    return G.score_fold(t.r8_trials)


_FAM = """n as (select *, family_id as family, coalesce(submitted_at, timestamp '0001-01-01 00:00:00') as moment, trainer like '%@x.com' as person from r13_console),
nf as (select * from n where person), fl as (select family, arg_min(struct_pack(trainer, moment, state), struct_pack(moment, pos)) as f, arg_max(struct_pack(trainer, moment, state), struct_pack(moment, pos)) as l from nf group by 1),
g as (select family, count(*) as submissions, count(distinct name) as distinct_names, count(distinct case when person then trainer end) as trainer_count, count(distinct case when not person and trainer <> '' then trainer end) as machine_submitters,
  arg_max(state, struct_pack(moment, pos)) as final_state, max(moment) as last_any from n group by 1),
fam as (select g.*, f.trainer as first_trainer, l.trainer as last_trainer, f.moment as first_moment, l.moment as last_moment, f.state as first_state, l.state as last_state from g join fl using (family) where submissions >= 2 and trainer_count >= 2)"""


def is_trainer():
    return c("trainer").endswith("@x.com")


def contested(t):
    return U.contested_families(t.r13_console, is_trainer(), "2024-01-25")


@query(
    "a42_contested_families",
    f"""with {_FAM} select family, submissions, distinct_names, trainer_count, machine_submitters, case when cast(last_any as date) >= date '2024-01-25' then 'live' else 'legacy' end as scope, first_trainer, last_trainer, first_state, last_state,
  round((epoch_us(last_moment) - epoch_us(first_moment)) / 3.6e9, 2) as span_hours, final_state, first_trainer <> last_trainer as handover from fam""",
)
def _(t):
    return contested(t).drop("first_at", "last_at")


@query("a42_family_people", "select family_id as family, trainer, count(*) as submissions from r13_console where trainer like '%@x.com' group by 1, 2")
def _(t):
    return U.family_people(t.r13_console, is_trainer())


@query(
    "a43_handovers",
    f"""with {_FAM}, h as (select fam.family, fam.first_trainer, fam.last_trainer, fam.final_state, n.person and n.trainer <> fam.last_trainer and n.moment < fam.last_moment as before, n.state, n.trainer from fam join n using (family) where first_trainer <> last_trainer)
select family, first_trainer, last_trainer, count(*) filter (where before) as attempts_before, count(distinct trainer) filter (where before) as uncredited_trainers,
  count(*) filter (where before) > 0 and count(*) filter (where before and state in ('accepted', 'legacy_accepted')) = 0 as prior_all_unsuccessful, min(final_state) in ('accepted', 'legacy_accepted') as ends_accepted from h group by 1, 2, 3""",
)
def _(t):
    return U.handovers(t.r13_console, contested(t), is_trainer())


@query(
    "a44_name_collisions",
    f"""select {X.key("name")} as task_name, count(*) as submissions, count(distinct family_id) as distinct_families, count(distinct case when trainer like '%@x.com' then trainer end) as distinct_trainers,
  arg_max(trainer, struct_pack(m := coalesce(submitted_at, timestamp '0001-01-01 00:00:00'), p := pos)) as name_keying_credits from r13_console group by 1 having count(distinct family_id) >= 2""",
)
def _(t):
    return U.name_collisions(t.r13_console, is_trainer())


@query(
    "a45_duplicate_ordering_audit",
    f"""with x as (select *, {X.key("name")} as key, coalesce(submitted_at, timestamp '0001-01-01 00:00:00') as moment from r13_console), g as (select key, count(*) as n, max(moment) as last, count(distinct coalesce(cast(submitted_at as date), date '0001-01-01')) as days,
  count(distinct case when trainer like '%@%' then trainer end) as people from x group by 1 having count(*) > 1), t as (select x.key, count(*) as ties, count(distinct state) as states from x join g on g.key = x.key and x.moment = g.last group by 1 having count(*) > 1)
select 'groups' as measure, count(*) as groups from g union all select 'same_day', count(*) from g where days < n union all select 'contested', count(*) from g where people > 1
union all select 'tied_on_latest', count(*) from t union all select 'tied_and_disagree', count(*) from t where states > 1""",
)
def _(t):
    return U.duplicate_ordering_audit(t.r13_console)


@query(
    "a45_fold_listings",
    """select task_id, run_id, state, pos from (select *, row_number() over (partition by task_id, run_id, date_trunc('month', submitted_at) order by case state when 'accepted' then 0 when 'rejected' then 1 when 'error' then 2 when 'running' then 3 else 9 end, pos) as rn from r13_console) where rn = 1""",
)
def _(t):
    monthly = t.r13_console.withColumn("submitted_at", F.date_trunc("month", "submitted_at"))
    return U.fold_listings(monthly).select("task_id", "run_id", "state", "pos")


@query(
    "a50_command_snapshot",
    f"""with f as (select coalesce(declared_short, folder) as name, owner as trainer from r11_folders where updated between date '2024-01-05' and date '2024-02-10') select count(*) as folders, count(distinct name) as tasks, count(*) - count(distinct name) as duplicates,
  count(*) - count(trainer) as unassigned, (select count(*) from r12_cycles where submitted_on between date '1996-01-01' and date '1997-12-31') as current from f""",
)
def _(t):
    folders = t.r11_folders.where(S.date_range(c("updated"), "2024-01-05", "2024-02-10")).select(F.coalesce("declared_short", "folder").alias("name"), c("owner").alias("trainer"))
    return G.command_snapshot(folders, t.r12_cycles.where(S.date_range(c("submitted_on"), "1996-01-01", "1997-12-31")))


_SEGT = "case when bench_side = 'company' then 'company' || case when bench = 'company bench aster' then '-aster' when bench = 'company bench zeta' then '-zeta' else '' end when connector then 'computer-connector' when not connector then 'computer-non-connector' when bench_side = 'computer' then 'computer' else 'unknown' end"
_LEAF = "('company-aster', 'company-zeta', 'computer-connector', 'computer-non-connector')"


def row_segments(t):
    return t.r10_truth.withColumn("segment", K.task_segment(c("bench_side"), c("connector"), K.harness_of([c("bench")], F.array().cast("array<string>"))))


@query(
    "a51_segment_tiles",
    f"""with t as (select *, {_SEGT} as segment from r10_truth), p as (select segment, count(distinct owner) as people from t where segment in {_LEAF} group by 1), l as (select case when bench = 'company' then 'company-zeta' when type = 'Connector' then 'computer-connector' else 'computer-non-connector' end as segment, src_row % 3 as s from r4_ledger),
lg as (select segment, count(*) as ledger, count(*) filter (where s < 2) as paid from l group by 1), g as (select case when segment in {_LEAF} then segment else 'untyped' end as segment, count(*) as tasks, count(*) filter (where state in ('accepted', 'legacy accepted')) as accepted, count(*) filter (where state = 'rejected') as rejected from t group by 1)
select g.*, coalesce(people, 0) as people, coalesce(ledger, 0) as ledger, coalesce(paid, 0) as paid from g left join p using (segment) left join lg using (segment)""",
)
def _(t):
    tasks = row_segments(t)
    people = tasks.where("owner is not null").select(c("owner").alias("email"), "segment")
    ledger = t.r4_ledger.select(
        F.expr("case when bench = 'company' then 'company-zeta' when type = 'Connector' then 'computer-connector' else 'computer-non-connector' end").alias("segment"),
        F.expr("case src_row % 3 when 0 then 'Paid' when 1 then 'Not itemised' else 'Not paid' end").alias("payment_state"),
    )
    return B.segment_tiles(tasks, people, ledger)


@query(
    "a52_makeup_split",
    f"with x as (select *, {CTYPE} as k from r10_truth) select case when k then 'connector' when not k then 'non-connector' else 'not known' end as kind, count(*) as tasks, count(connector) as declared, count(*) - count(connector) as inferred from x group by 1",
)
def _(t):
    return G.makeup_split(t.r10_truth)


@query("a53_kind_columns", "select domain as kind, count(*) as tasks from r10_truth where domain <> 'Not recorded' group by 1")
def _(t):
    return G.kind_columns(t.r10_truth.withColumnRenamed("domain", "domain_kind"))


_FLAGS = " union all ".join(f"select '{n}' as flag, decided from r10_truth where {col}" for n, col in G.FLAGS.items())


@query("a54_flag_cards", f"with f as ({_FLAGS}) select flag, count(*) as tasks, cast(floor(count(*) * 100 / (select count(*) from r10_truth) + 0.5) as bigint) as percent from f group by 1")
def _(t):
    return G.flag_cards(t.r10_truth)


@query(
    "a54_flag_series",
    f"""with f as ({_FLAGS}), d as (select flag, decided, count(*) as n from f where decided is not null group by 1, 2), e as (select flag, max(decided) as last from d group by 1), s as (select flag, last - cast(i as int) as day from e, range(14) r(i))
select s.flag, s.day, coalesce(n, 0) as n from s left join d on d.flag = s.flag and d.decided = s.day""",
)
def _(t):
    return D.last_n_days(G.flag_rows(t.r10_truth), 14, "flag")


# ---------------------------------------------------------------------- series
@query("w03_dense_daily", f"with {_DAILY}, g as (select d.decided as day, s.state from (select distinct decided from daily) d, (select unnest([{', '.join(repr(s) for s in STATES)}]) as state) s) select day, g.state, coalesce(n, 0) as n from g left join daily on daily.decided = day and daily.state = g.state")
def _(t):
    return D.dense_daily(t.r10_truth, STATES)


_LAST = "d as (select cast(o_orderdate as date) as decided, count(*) as n from orders group by 1), s as (select (select max(decided) from d) - cast(i as int) as day from range(30) r(i)), ser as (select day, coalesce(n, 0) as n from s left join d on decided = day)"


@query("w04_last_n_days", f"with {_LAST} select * from ser")
def _(t):
    return D.last_n_days(t.orders.select(F.to_date("o_orderdate").alias("decided")), 30)


@query(
    "w04_half_change",
    f"with {_LAST}, h as (select *, row_number() over (order by day) as i from ser), m as (select avg(n) filter (where i <= 15) as a, avg(n) filter (where i > 15) as b, avg(n) as per_day from h) select cast(floor(per_day + 0.5) as bigint) as per_day, cast(floor((b - a) * 100 / a + 0.5) as bigint) as change from m",
)
def _(t):
    return D.half_change(D.last_n_days(t.orders.select(F.to_date("o_orderdate").alias("decided")), 30))


_SELECT = f"""k as (select *, {MKEY} as key from r10_truth where {COLLECT} and not delivered), out as (select distinct id from k where maybe_delivered and runs > 4), x as (select key, bool_or(id in (select id from out)) as gone, count(*) as stands_for from k group by 1),
rep as (select * from k qualify row_number() over (partition by key order by {PREFER}) = 1), ent as (select rep.key, rep.id, rep.name, rep.owner, rep.state, rep.decided, rep.maybe_delivered, stands_for from rep join x using (key) where not gone)"""


def _counts(entries: str) -> str:
    """The figures of the rows of ``entries``."""
    derived = "name like 'harbor-single-task-%'"
    return f"""count(*) as taken, count(distinct owner) as owners, cast(coalesce(sum(stands_for), 0) as bigint) as rows_represented, cast(coalesce(sum(stands_for - 1), 0) as bigint) as superseded_rows, count(*) filter (where maybe_delivered) as possibly_already_delivered,
  count(*) filter (where {derived}) as names_derived, count(*) filter (where {derived} and not regexp_matches(id, '^family:(.+?)-[0-9a-f]{{6,}}$')) as names_unrecoverable from {entries}"""


def manifest_rows(t):
    return t.r10_truth.where(S.collectable() & ~c("delivered"))


def excluded(t):
    return manifest_rows(t).where("maybe_delivered and runs > 4").select("id")


@query("w05_select_for_manifest", f"with {_SELECT} select key, id, name, owner, state, decided, stands_for, row_number() over (order by decided nulls first, key) as position from ent order by decided nulls first, key limit 100")
def _(t):
    return D.select_for_manifest(manifest_rows(t), excluded(t), 100).select("key", "id", "name", "owner", "state", "decided", "stands_for", "position")


@query(
    "w05_selection_arithmetic",
    f"""with {_SELECT}, e as (select * from ent order by decided nulls first, key limit 100) select (select count(*) from k) as rows_considered, (select count(*) from x) as distinct_tasks, (select count(*) from x where gone) as excluded, (select count(*) from x where not gone) as available,
  cast(100 as bigint) as requested, cast(100 - (select count(*) from e) as bigint) as short_by, {_counts("e")}""",
)
def _(t):
    entries = D.select_for_manifest(manifest_rows(t), excluded(t), 100)
    return D.selection_arithmetic(manifest_rows(t), excluded(t), entries, 100)


@query(
    "w06_cumulative_cleared",
    "with d as (select decided as day, count(*) as settled from r10_truth where carried_over and decided is not null group by 1) select day, settled, cast(floor(sum(settled) over (order by day) * 100 / sum(settled) over () + 0.5) as bigint) as cleared from d",
)
def _(t):
    return D.cumulative_cleared(t.r10_truth.where("carried_over"))


@query(
    "w08_first_last",
    f"""select {X.key("name")} as key, arg_min(trainer, struct_pack(m := coalesce(submitted_at, timestamp '0001-01-01 00:00:00'), p := pos)) as first, arg_max(trainer, struct_pack(m := coalesce(submitted_at, timestamp '0001-01-01 00:00:00'), p := pos)) as last, count(*) - 1 as before_last from r13_console group by 1""",
)
def _(t):
    keyed = t.r13_console.withColumn("key", N.name_key(c("name")))
    at = F.coalesce(c("submitted_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    return D.first_last(keyed, "key", at, "trainer")


@query("w09_manifest_position", "select id, row_number() over (order by case when batch like 'Batch%' then 0 else 1 end, cast(split_part(batch, ' ', 2) as double), batch, pos) as position from r3_deliveries")
def _(t):
    return D.manifest_position(t.r3_deliveries.select("id", "batch", "pos")).select("id", "position")


# --------------------------------------------------------------- orders and sets
@query("o01_sort_rows", "select id, task, size_bytes from r3_deliveries order by size_bytes desc, task, id")
def _(t):
    return O.sort_rows(t.r3_deliveries, "size_bytes", True, ("task", "id")).select("id", "task", "size_bytes")


@query("o02_top_k", "select trainer, count(*) as n from r3_deliveries where trainer like '%@%' group by 1 order by 2 desc, 1 limit 8")
def _(t):
    return O.top_k(t.r3_deliveries, "trainer", 8)


@query("o03_people_order", f"with {_PEOPLE} select email, pending_tasks, paid_tasks from people order by pending_tasks desc, paid_tasks desc, email")
def _(t):
    return O.people_order(books(t)[2]).select("email", "pending_tasks", "paid_tasks")


@query("o04_folder_order", "select id, decided, name from r10_truth order by decided desc nulls last, name")
def _(t):
    return O.folder_order(t.r10_truth.select("id", "decided", "name"))


@query(
    "o05_sample_groups",
    f"select key, submissions from (select {X.key('name')} as key, count(*) as submissions from r13_console group by 1 having count(*) > 1) order by md5(key || ':42'), key limit 100",
)
def _(t):
    return O.sample_groups(t.r13_console, N.name_key(c("name")), 42, 100)


@query(
    "o06_not_found_listing",
    f"{_TRACE} select pos, batch, task, reason from traced where not found",
)
def _(t):
    return O.not_found_listing(traced(t)).select("pos", "batch", "task", "reason")


@query("o07_page", "select id, task from r3_deliveries order by task, id limit 20 offset 60")
def _(t):
    return O.page(t.r3_deliveries.select("id", "task"), ["task", "id"], 3, 20)


@query("u01_union_sources", "select id, batch, trainer, cast(null as string) as folder from r3_deliveries union all select 'M-' || cast(pos as string), batch, null, folder from r16_manifest")
def _(t):
    return O.union_sources(t.r3_deliveries.select("id", "batch", "trainer"), t.r16_manifest.select(F.concat(F.lit("M-"), c("pos").cast("string")).alias("id"), "batch", "folder"))


@query("u02_symmetric_difference", "select o_orderkey as id, case when o_orderpriority = '5-LOW' then 'first' else 'second' end as only_in from orders where (o_orderpriority = '5-LOW') <> (o_orderstatus = 'F')")
def _(t):
    low = t.orders.where("o_orderpriority = '5-LOW'").select(c("o_orderkey").alias("id"))
    return U.symmetric_difference(low, t.orders.where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id")))


@query(
    "u03_intersect_membership",
    f"""with {X.MEMBER}, n as (select distinct key from member where cohort = 'iteration_2'), g as (select distinct key from member where cohort = 'gate_only'), o as (select distinct key from member where cohort in ('iteration_1', 'qc_accepted'))
select 'current' as measure, count(*) as n from n union all select 'gate_only', count(*) from g union all select 'gate_only_also_current', count(*) from g where key in (select key from n) union all select 'retired_only', count(*) from o where key not in (select key from n)""",
)
def _(t):
    return O.membership_overlap(ST.membership(L.read_object_listing(t.r2_objects)), "iteration_2", "gate_only", ["iteration_1", "qc_accepted"])


@query(
    "u04_gap_explained",
    f"""with p as (select distinct {X.key("folder")} as key from r11_folders where cohort = 'iteration_2'), s as (select lower(trim(name)) as key, bool_or(state = 'accepted') as acc, arg_min(state, pos) as held from r10_truth group by 1)
select case when held is null then 'not in scope' else 'canonical state ' || held end as reason, count(*) as packages from p left join s using (key) where not coalesce(acc, false) group by 1""",
)
def _(t):
    return O.gap_explained(t.r11_folders.where("cohort = 'iteration_2'").select(N.name_key(c("folder")).alias("key")), t.r10_truth)


@query("u05_semi_members", f"select id from r3_deliveries where {X.key('task')} in (select {X.key('folder')} from r11_folders)")
def _(t):
    return O.semi_members(t.r3_deliveries, N.name_key(c("task")), t.r11_folders.select(N.name_key(c("folder")).alias("key"))).select("id")


@query("u06_delivered_rows", "select id, batch from r3_deliveries union all select 'M-' || cast(pos as string), batch from r16_manifest where batch not in (select batch from r3_deliveries)")
def _(t):
    drive = t.r16_manifest.select(F.concat(F.lit("M-"), c("pos").cast("string")).alias("id"), "batch")
    audit = t.r3_deliveries.select("id", "batch")
    return O.union_sources(audit, W.uncovered(audit, drive))


@query(
    "j40_folder_segment",
    f"""with own as (select lower(folder) as fk, max(case when pos % 4 = 0 then 'computer-connector' else 'company-zeta' end) as own from r11_folders where cohort = 'iteration_2' group by 1),
nm as (select {X.bkey("name")} as k, case when min(v) = max(v) then min(v) end as v from (select name, {_SEGT} as v from r10_truth) group by 1)
select f.pos, coalesce(own, n1.v, n2.v, 'unknown') as segment from r11_folders f left join own on own.fk = lower(f.folder) left join nm n1 on n1.k = {X.bkey("f.declared_short")} left join nm n2 on n2.k = {X.bkey("f.folder")}""",
)
def _(t):
    from taskweave.operators.lookups import agreed, name_pairs

    own = t.r11_folders.where("cohort = 'iteration_2'").select("folder", F.expr("case when pos % 4 = 0 then 'computer-connector' else 'company-zeta' end").alias("segment"))
    return B.folder_segment(t.r11_folders, own, agreed(name_pairs(row_segments(t), c("segment"), "name"))).select("pos", "segment")
