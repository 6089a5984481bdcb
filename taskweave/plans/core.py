"""Runs to published truth: identity, canonical run, state, figures, checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import runs as R
from taskweave.operators import canonical as C
from taskweave.operators import provenance as P
from taskweave.operators import quality as Q
from taskweave.operators import state as S
from taskweave.plans import fragments as X
from taskweave.plans.registry import query
from taskweave.plans.truth import derive_tasks, publish
from taskweave.plans.views import Tables
from taskweave.session import stored
from taskweave.sources import listings as L

CURRENT, GATE_ONLY = "iteration_2", "gate_only"


def tasks_of(t: Tables):
    member = S.membership(L.read_object_listing(t.r2_objects))
    return derive_tasks(t.r1_runs, member, X.NOW, X.CUT, CURRENT, GATE_ONLY, X.ERAS)


# ---------------------------------------------------------------- the chain
@query(
    "e1_published_truth",
    f"""{X.CHAIN}, dup as (select lower(trim(task_name)) as dn, coalesce(owner, '') as downer, count(*) as members,
  count(distinct day) <= 1 and count(distinct final_state) <= 1 as likely from tasks where in_scope group by 1, 2 having count(*) > 1)
select identity as id, final_state as state, why, day as decided, runs, carried_over, at_bar as at_current_bar, t.era as gate_era,
  d.members is not null as possible_duplicate, case when likely then 'likely' when members is not null then 'possible' else '' end as duplicate_tier, source
from tasks t left join dup d on lower(trim(task_name)) = dn and coalesce(owner, '') = downer where in_scope""",
)
def _(t):
    cols = ["id", "state", "why", "decided", "runs", "carried_over", "at_current_bar", "gate_era", "possible_duplicate", "duplicate_tier", "source"]
    # The flags and the rows both read the tasks, so they are stored once.
    return publish(stored(tasks_of(t), "tasks")).select(*cols)


# ---------------------------------------------------------- scalar run rules
@query("p01_name_key", f"select pos, {X.key('task_name')} as name_key from r1_runs")
def _(t):
    return t.r1_runs.select("pos", N.name_key(F.col("task_name")).alias("name_key"))


@query("p02_norm_name", f"select pos, {X.norm('name')} as norm_name from r10_truth")
def _(t):
    return t.r10_truth.select("pos", N.norm_name(F.col("name")).alias("norm_name"))


@query(
    "p03_is_placeholder",
    """select pos, regexp_matches(name, '(?i)^(harbor-single-task-|autorun-|content-[0-9a-f]{16,}|task\\d*$|task[-_]|g\\d+_|code-c\\d+$|tasks?$)') as delivered,
  regexp_matches(name, '(?i)^(task\\d*|tasks?|harbor-single-task-\\S*|autorun-\\S*|content-[0-9a-f]{16,}|code-c\\d+|g\\d+_\\S*)$') as cohort,
  regexp_matches(lower(name), '^(?:autorun-|harbor-single-task-|content-[0-9a-f]{12,})') as manifest from r10_truth""",
)
def _(t):
    kinds = [N.is_placeholder(F.col("name"), k).alias(k) for k in ("delivered", "cohort", "manifest")]
    return t.r10_truth.select("pos", *kinds)


@query(
    "p04_readable_name",
    """select pos, case when name like 'harbor-single-task-%' and regexp_matches(id, '^family:(.+?)-[0-9a-f]{6,}$') then regexp_extract(id, '^family:(.+?)-[0-9a-f]{6,}$', 1) else name end as readable,
  case when name like 'harbor-single-task-%' then case when regexp_matches(id, '^family:(.+?)-[0-9a-f]{6,}$') then 'derived from the verdict identifier' else 'placeholder; no readable name recorded' end
    else 'pipeline' end as name_source from r10_truth""",
)
def _(t):
    r = N.readable_name(F.col("id"), F.col("name"))
    return t.r10_truth.select("pos", r["name"].alias("readable"), r["source"].alias("name_source"))


@query(
    "p08_decided_day",
    "select pos, cast(coalesce(decided_at, updated_at) as date) as decided_day, decided_at is null as inferred from r1_runs",
)
def _(t):
    return t.r1_runs.select(
        "pos", R.decided_day(F.col("decided_at"), F.col("updated_at")).alias("decided_day"), F.isnull("decided_at").alias("inferred")
    )


@query(
    "p09_assign_identity",
    f"with {X.IDS} select pos, identity, method, case method when 'family_id' then 'high' when 'task_id' then 'low' else 'lowest' end as confidence from ids",
)
def _(t):
    return t.r1_runs.select("pos", R.assign_identity(*map(F.col, ("family_id", "task_id", "task_name", "owner"))).alias("i")).select("pos", "i.*")


@query(
    "p10_wave_depth",
    f"""select pos, {X.DEPTH} as depth, case when decision in ('accepted', 'rejected') then 'decided, so the plan completed'
  else 'reported stage ''' || stage || '''' end as evidence from r1_runs""",
)
def _(t):
    return t.r1_runs.select("pos", R.wave_depth(F.col("decision"), F.col("stage"), F.col("state")).alias("d")).select("pos", "d.*")


@query("p11_outcome_rank", f"select pos, {X.OUTCOME} as outcome_rank from r1_runs")
def _(t):
    return t.r1_runs.select("pos", R.outcome_rank(F.col("state")).alias("outcome_rank"))


@query(
    "p12_derive_state",
    f"""with f as (select pos, decision = 'accepted' or state = 'accepted' as acc, decision = 'rejected' or state = 'rejected' as rej, state, updated_at as moment,
  pos % 7 = 0 as at_bar, pos % 5 = 0 as gate_only, pos % 3 = 0 as anywhere from r1_runs)
select pos, case when acc and (at_bar or moment > timestamp '{X.NOW}' - interval 30 minutes) then 'accepted' when acc then 'legacy accepted' when rej then 'rejected'
    when state in ('running', 'queued', 'error') then state else 'no QC decision' end as final_state,
  case when acc and at_bar then 'accepted and its package is in the current bar'
    when acc and moment > timestamp '{X.NOW}' - interval 30 minutes then 'accepted within the grace window; package not written yet'
    when acc and gate_only then 'acceptance withdrawn: GLM-5.2 gate only, awaiting KESTREL re-gate' when acc and anywhere then 'delivered only to a retired bar'
    when acc then 'accepted but no package delivered anywhere' when rej then 'reached a QC decision and failed it'
    when state = 'running' then 'in a stage, no decision yet' when state = 'queued' then 'admitted, waiting on a slot'
    when state = 'error' then 'parked or crashed before a decision' else 'verdict reports a submission state only' end as predicate from f""",
)
def _(t):
    s = R.derive_state(
        F.col("decision"), F.col("state"), F.col("updated_at").cast("timestamp"), F.expr("pos % 7 = 0"), F.expr("pos % 5 = 0"),
        F.expr("pos % 3 = 0"), F.lit(X.NOW).cast("timestamp"),
    )
    return t.r1_runs.select("pos", s["finalState"].alias("final_state"), s["statePredicate"].alias("predicate"))


@query(
    "p13_scope_flags",
    f"""select pos, cast(updated_at as date) >= date '{X.CUT}' as in_scope, decided_at is not null and cast(updated_at as date) >= date '{X.CUT}'
  and cast(decided_at as date) - 10 < date '{X.CUT}' as carried_over from r1_runs""",
)
def _(t):
    s = R.scope_flags(F.to_date("updated_at"), F.date_sub("decided_at", 10), F.lit(X.CUT).cast("date"))
    return t.r1_runs.select("pos", s["inScope"].alias("in_scope"), s["carriedOver"].alias("carried_over"))


@query(
    "p14_normalise_finding",
    """select pos, code, case when regexp_matches(code, ':[0-9a-f]{8,}$') then regexp_replace(code, ':[0-9a-f]{8,}$', '')
    when code like 'HARBOR-CHECK%' then 'HARBOR-CHECK' else code end as family, regexp_replace(code, ':[0-9a-f]{8,}$', '') as tag
from (select pos, unnest(finding_codes) as code from r1_runs)""",
)
def _(t):
    f = R.normalise_finding(F.col("code"))
    return t.r1_runs.select("pos", F.explode("finding_codes").alias("code")).select("pos", "code", f["family"].alias("family"), f["code"].alias("tag"))


@query(
    "p15_domain_of",
    """select pos, case split_part(lower(name), '-', 1) when 'code' then 'Engineering' when 'fin' then 'Finance' when 'law' then 'Legal' when 'health' then 'Health'
  when 'gen' then 'Other' when 'bus' then 'Other' else 'Not recorded' end as domain from r10_truth""",
)
def _(t):
    return t.r10_truth.select("pos", R.one_domain(R.domain_of(F.col("name"))).alias("domain"))


@query(
    "p16_domain_of_package",
    """select pos, case regexp_extract(lower(task), '^([a-z]+)-', 1) when 'code' then 'Engineering' when 'tech' then 'Engineering' when 'fin' then 'Finance'
  when 'law' then 'Legal' when 'health' then 'Health' else 'Other' end as domain from r3_deliveries""",
)
def _(t):
    return t.r3_deliveries.select("pos", R.domain_of_package(F.col("task")).alias("domain"))


@query(
    "p18_gate_hints",
    """select conv_id, turn, lower(text) like '%glm-5.2%' as glm52, lower(text) like '%kestrel%' as kestrel, lower(text) like '%calibration%' as calibration,
  lower(text) like '%oracle%' as oracle from conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", R.gate_hints(F.col("text")).alias("h")).select("conv_id", "turn", "h.*")


@query(
    "p19_cycle_status",
    """with x as (select id, lower(coalesce(submission_status, '')) as a, lower(coalesce(decision, '')) as b, lower(coalesce(raw_status, '')) as r from r12_cycles)
select id, case when 'accepted' in (a, b) and 'rejected' in (a, b) then 'Conflicting verdict' when 'accepted' in (a, b) then 'Accepted' when 'rejected' in (a, b) then 'Rejected'
  when r = 'waiting_for_trainer_edit' then 'Rejected' when r = 'infrastructure_error' then 'Failed' when r = 'done' then 'Submitted' when r = 'running' then 'Running'
  when r = 'queued' then 'Queued' when r = 'on_hold_now' then 'On Hold Now' else 'Unknown' end as status from x""",
)
def _(t):
    return t.r12_cycles.select("id", R.cycle_status(*map(F.col, ("submission_status", "decision", "raw_status"))).alias("status"))


@query(
    "p20_type_and_domain",
    """select doc_id, case when doc_id % 5 = 0 then 'Connector' when regexp_matches(lower(source || '-' || cast(doc_id as string)), '(^|[-_])(ach|plaid|card|wire|check|debit|credit|bank|account|transfer|payment|bill|savings|ofac|kyc|merchant|transaction)([-_]|$)') then 'Connector'
  when regexp_matches(lower(source), '^(code|fin|health|law|gen|bus)-') then 'Non-connector' else 'Not recorded' end as task_type,
  case when doc_id % 3 = 0 then lang else case split_part(lower(source || '-' || cast(doc_id as string)), '-', 1) when 'code' then 'Code' when 'fin' then 'Finance' when 'law' then 'Law' when 'health' then 'Health' when 'bus' then 'Business' else 'General' end end as category
from documents""",
)
def _(t):
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    own = F.when(F.expr("doc_id % 5 = 0"), F.lit("Connector"))
    return t.documents.select(
        "doc_id",
        R.task_type_of(F.lit(None).cast("string"), own, name).alias("task_type"),
        R.category_of(name, F.when(F.expr("doc_id % 3 = 0"), F.col("lang"))).alias("category"),
    )


@query("p37_is_person", "select pos, trainer like '%@%' and not regexp_matches(trainer, '^dev@localhost$') as person from r13_console")
def _(t):
    return t.r13_console.select("pos", N.is_person(F.col("trainer")).alias("person"))


@query("p38_runs_bucket", "select pos, case when runs >= 8 then '8+' else cast(runs as string) end as bucket from r10_truth")
def _(t):
    return t.r10_truth.select("pos", N.runs_bucket(F.col("runs")).alias("bucket"))


# -------------------------------------------------- canonical run and roll-up
@query("a01_canonical_run", f"with {X.IDS}, {X.RANKED} select identity, source, state, depth, outcome from ranked where rn = 1")
def _(t):
    return C.canonical_run(C.with_identity(t.r1_runs)).select("identity", "source", "state", "depth", "outcome")


@query(
    "w01_rank_runs",
    f"""with {X.IDS}, {X.RANKED} select w.identity, w.pos as winner, r.pos as runner_up,
  case when r.pos is null then 'only run' when w.depth > r.depth then 'further through the plan' when w.outcome > r.outcome then 'better outcome at the same depth'
    when w.moment > r.moment then 'later decision, tied on progress and outcome' else 'tied on every axis; first by sort order' end as canonical_reason
from ranked w left join ranked r on r.identity = w.identity and r.rn = 2 where w.rn = 1""",
)
def _(t):
    return C.rank_runs(C.with_identity(t.r1_runs))


@query(
    "a02_identity_rollup",
    f"""with {X.IDS} select identity, count(*) as runs, bool_or(state = 'accepted' or decision = 'accepted') as ever_accepted, count(distinct owner) as owners,
  min(day) as first_decided_day, max(day) as last_decided_day, cast(max(moment) filter (where coalesce(nullif(decision, ''), state) = 'accepted') as date) as accepted_on
from ids group by identity""",
)
def _(t):
    return C.identity_rollup(C.with_identity(t.r1_runs)).withColumn("accepted_on", F.to_date("accepted_at")).drop("accepted_at")


@query(
    "a02_identity_findings",
    f"""with {X.IDS}, {X.RANKED}, f as (select identity, rn, unnest(finding_codes) as c from ranked)
select identity, case when regexp_matches(c, ':[0-9a-f]{{8,}}$') then regexp_replace(c, ':[0-9a-f]{{8,}}$', '') when c like 'HARBOR-CHECK%' then 'HARBOR-CHECK' else c end as family,
  bool_or(rn = 1) as on_canonical, bool_or(rn > 1) as on_other from f group by 1, 2""",
)
def _(t):
    ids = C.with_identity(t.r1_runs)
    return C.identity_findings(ids, C.canonical_run(ids))


@query("a02_other_runs", f"with {X.IDS}, {X.RANKED} select identity, source, state, decision, day as decided_day, owner from ranked where rn > 1")
def _(t):
    ids = C.with_identity(t.r1_runs)
    return C.other_runs(ids, C.canonical_run(ids))


@query("a02_identity_owners", f"with {X.IDS} select distinct identity, owner from ids where owner is not null")
def _(t):
    return C.identity_owners(C.with_identity(t.r1_runs))


@query(
    "a03_identity_coverage",
    f"""with {X.IDS}, {X.MEMBER}, k as (select *, {X.key('task_name')} as key from ids), per as (select identity, min(method) as method, count(distinct owner) as owners, max(day) as last from ids group by 1)
select 'rows_by:' || method as measure, count(*) as value from ids group by method union all select 'identities_by:' || method, count(distinct identity) from ids group by method
union all select 'families_spanning_owners', count(*) from per where method = 'family_id' and owners > 1
union all select 'in_scope_identities', count(*) from per where last >= date '{X.CUT}' union all select 'legacy_identities', count(*) from per where last < date '{X.CUT}'
union all select 'names_fusing_identities', count(*) from (select key from k group by key having count(distinct identity) > 1)
union all select 'weak_rows', count(*) from ids where method <> 'family_id'
union all select 'weak_rows_with_package', count(*) from k where method <> 'family_id' and key in (select key from member)
union all select 'inferred_rows', count(*) from ids where decided_at is null""",
)
def _(t):
    packaged = S.membership(L.read_object_listing(t.r2_objects))
    return C.identity_coverage(C.with_identity(t.r1_runs), packaged, X.CUT)


@query(
    "a04_scope_split",
    f"""with {X.IDS}, m as (select identity, max(day) as d from ids group by 1) select count(*) filter (where d >= date '{X.CUT}') as in_scope,
  count(*) filter (where d < date '{X.CUT}') as legacy from m""",
)
def _(t):
    return C.scope_split(C.with_identity(t.r1_runs), X.CUT)


# ------------------------------------------------------- membership and state
@query(
    "j01_join_membership",
    f"""{X.CHAIN} select identity, at_bar, gate_only, cohorts, packages from flat""",
)
def _(t):
    member = S.membership(L.read_object_listing(t.r2_objects))
    joined = S.join_membership(C.canonical_run(C.with_identity(t.r1_runs)), member, CURRENT, GATE_ONLY)
    return joined.select("identity", "at_bar", "gate_only", "cohorts", "packages")


@query("j19_gate_era", f"select pos, {X.ERA} as era from (select *, coalesce(decided_at, updated_at) as moment from r1_runs)")
def _(t):
    at = F.coalesce("decided_at", "updated_at").cast("timestamp")
    return t.r1_runs.select("pos", S.gate_era(at, X.ERAS).alias("era"))


@query(
    "a05_state_partition",
    f"""{X.CHAIN} select 'state' as dimension, final_state as value, count(*) as tasks from tasks where in_scope group by 2
union all select 'predicate', why, count(*) from tasks where in_scope group by 2 union all select 'era', era, count(*) from tasks where in_scope group by 2""",
)
def _(t):
    return S.state_partition(tasks_of(t))


@query(
    "a06_vocabulary",
    """with v as (select 'state' as field, state as value from r10_truth union all select 'gate_era', gate_era from r10_truth
  union all select 'domain', domain from r10_truth union all select 'confidence', confidence from r10_truth union all select 'owner', coalesce(owner, '(none)') from r10_truth
  union all select 'findings', unnest(findings) from r10_truth where findings is not null union all select 'findings', '(none)' from r10_truth where findings is null
  union all select 'cohorts', unnest(cohorts) from r10_truth where cohorts is not null union all select 'cohorts', '(none)' from r10_truth where cohorts is null)
select field, value, count(*) as n from v group by 1, 2""",
)
def _(t):
    return P.vocabulary(t.r10_truth, ["state", "gate_era", "domain", "confidence", "owner"], ["findings", "cohorts"])


def _step(label, pos, cond):
    return f"select '{label}' as label, {pos} as pos, count(*) as count from tasks where {cond}"


_CHAIN_SQL = " union all ".join(
    _step(label, i + 1, " and ".join(conds[: i + 1]))
    for label, conds in {
        "Accepted": ["in_scope", "ever_accepted", "final_state = 'accepted'"],
        "Legacy accepted": ["in_scope", "ever_accepted", "final_state = 'legacy accepted'"],
        "Rejected": ["in_scope", "final_state = 'rejected'"],
        "No QC decision": ["in_scope", "final_state in ('error', 'no QC decision')"],
        "Running": ["in_scope", "final_state = 'running'"],
        "Carried over": ["in_scope", "carried_over"],
        "Awaiting re-gate": ["in_scope", "gate_only"],
    }.items()
    for i in range(len(conds))
)


@query("a07_provenance_chain", f"{X.CHAIN} select label, cast(pos as bigint) as pos, count from ({_CHAIN_SQL})")
def _(t):
    return P.provenance_chain(tasks_of(t), P.headline_figures(X.CUT)).select("label", "pos", "count")


@query(
    "a08_duplicate_tiers",
    f"""{X.CHAIN} select lower(trim(task_name)) as dup_name, coalesce(owner, '') as dup_owner, count(*) as members, count(distinct day) = 1 as same_day,
  count(distinct final_state) = 1 as same_state, bool_and(method = 'family_id') as all_family_keyed,
  case when count(distinct day) = 1 and count(distinct final_state) = 1 then 'likely' else 'possible' end as tier
from tasks where in_scope group by 1, 2 having count(*) > 1""",
)
def _(t):
    return P.duplicate_groups(tasks_of(t))


@query(
    "a09_reconciled_partition",
    f"""{X.CHAIN}, c as (select count(*) filter (where final_state in ('accepted', 'legacy accepted', 'rejected', 'running')) as headline,
  count(*) filter (where final_state in ('error', 'no QC decision', 'queued')) as undecided, count(*) as in_scope from tasks where in_scope)
select *, headline + undecided = in_scope as reconciles from c""",
)
def _(t):
    return P.reconciled_partition(tasks_of(t))


# -------------------------------------------------------------------- checks
@query(
    "q01_check_partition",
    """select 'undeclared_state' as check, count(*) as failures from r10_truth where state not in ('accepted', 'legacy accepted', 'rejected', 'running', 'error', 'no QC decision', 'queued', 'not started')
union all select 'no_state', count(*) from r10_truth where state is null or state = ''""".replace("as check", 'as "check"'),
)
def _(t):
    return Q.check_partition(t.r10_truth)


@query(
    "q02_check_scope",
    f"""select count(*) filter (where decided is null or decided < date '{X.CUT}') as before_cut, count(*) filter (where decided_inferred) as inferred_dates, count(*) as rows from r10_truth""",
)
def _(t):
    return Q.check_scope(t.r10_truth, X.CUT)


@query(
    "q03_check_chains",
    f"""{X.CHAIN}, c as ({_CHAIN_SQL}), g as (select *, lag(count) over (partition by label order by pos) as before from c),
v as (select label, count as value from c qualify row_number() over (partition by label order by pos desc) = 1)
select label, count(*) filter (where count > before) as growing_steps, min(count) as ends_at, min(count) = any_value(value) as ends_at_value from g join v using (label) group by label""",
)
def _(t):
    chains = P.provenance_chain(tasks_of(t), P.headline_figures(X.CUT)).withColumn("fan_out", F.lit(False))
    values = chains.groupBy("label").agg(F.max_by("count", "pos").alias("value"))
    return Q.check_chains(chains, values)


@query(
    "q04_check_figures_match_rows",
    f"""{X.CHAIN}, v as (select label, final_state as state, n from (values ('Accepted', 'accepted'), ('Legacy accepted', 'legacy accepted'), ('Rejected', 'rejected'), ('Running', 'running')) p(label, s)
  join (select final_state, count(*) as n from tasks where in_scope group by 1) on s = final_state)
select label, n as value, n as rows, true as agrees from v""",
)
def _(t):
    tasks = tasks_of(t)
    named = {"Accepted": "accepted", "Legacy accepted": "legacy accepted", "Rejected": "rejected", "Running": "running"}
    figures = P.provenance_chain(tasks, P.headline_figures(X.CUT)).groupBy("label").agg(F.max_by("count", "pos").alias("value"))
    figures = figures.withColumn("state", R.lookup(F.col("label"), named)).where("state is not null")
    return Q.check_figures_match_rows(figures, tasks)


@query("q05_check_unique", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return Q.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "q06_check_sums",
    """select batch, count(*) as total, count(*) filter (where acceptance = 'Accepted') as accepted, count(*) filter (where acceptance = 'Rejected') as rejected,
  count(*) filter (where acceptance = 'Pending') as pending, count(*) filter (where acceptance in ('Accepted', 'Rejected', 'Pending')) = count(*) as adds_up from r3_deliveries group by batch""",
)
def _(t):
    names = {"accepted": "Accepted", "rejected": "Rejected", "pending": "Pending"}
    counts = t.r3_deliveries.groupBy("batch").agg(F.count("*").alias("total"), *[F.count_if(F.col("acceptance") == v).alias(k) for k, v in names.items()])
    return Q.check_sums(counts, "total", list(names))


@query(
    "q07_check_provenance",
    """select 'no_source' as "check", count(*) as failures from r10_truth where source not like '\\_v/%' escape '\\' union all select 'no_why', count(*) from r10_truth where why is null or why = ''
union all select 'no_canonical_reason', count(*) from r10_truth where canonical_reason is null""",
)
def _(t):
    return Q.check_provenance(t.r10_truth, "_v/")


@query(
    "q08_check_vocabulary",
    """with o as (select distinct finding as value from (select unnest(findings) as finding from r10_truth) union select 'offered only'), u as (select distinct o_orderpriority as value from orders union select distinct unnest(findings) from r10_truth)
select value, 'offered but absent' as problem from (select value from o except select value from u) union all select value, 'present but not offered' from (select value from u except select value from o)""",
)
def _(t):
    findings = t.r10_truth.select(F.explode("findings").alias("value"))
    offered = findings.distinct().union(t.region.select(F.lit("offered only")).distinct())
    return Q.check_vocabulary(offered, findings.union(t.orders.select("o_orderpriority")))


@query(
    "q09_check_orphans",
    f"""with {X.MEMBER} select distinct {X.key('task_name')} as key from r1_runs where {X.key('task_name')} not in (select key from member)""",
)
def _(t):
    claims = t.r1_runs.select(N.name_key(F.col("task_name")).alias("key"))
    return Q.check_orphans(claims, S.membership(L.read_object_listing(t.r2_objects)))


@query(
    "q10_stale_index",
    """select type as "index", max(delivered_on) <> (select max(delivered_on) from r3_deliveries) as stale from r3_deliveries where bench = 'company' group by type""",
)
def _(t):
    d = t.r3_deliveries
    built = d.where("bench = 'company'").groupBy(F.col("type").alias("index")).agg(F.max("delivered_on").alias("built_for"))
    # A row per type, so the newest day over all is found among these.
    newest = d.where("type is not null").groupBy(F.col("type").alias("index")).agg(F.max("delivered_on").alias("day"))
    current = F.max("day").over(W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return Q.stale_index(built, newest.select("index", current.alias("current")))
