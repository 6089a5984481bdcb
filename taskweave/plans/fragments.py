"""SQL fragments the oracle texts share."""

SUFFIX = r"(-(final|v\d+|\d{4,}|copy|new|fixed|updated))+$"
CUT = "2024-01-15"
NOW = "2024-01-30 00:00:00"
ERAS = (("", "Opus gate"), ("2024-01-08 00:00:00", "GLM-5.2 gate only"), ("2024-01-16 12:00:00", "KESTREL on"), ("2024-01-24 05:06:54", "KESTREL full"))


def key(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '^(harbor/)?(obi/)?', '')"


def bkey(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '^(harbor|obi)/', '')"


def stem(c: str) -> str:
    return f"regexp_replace({c}, '{SUFFIX}', '')"


def norm(c: str) -> str:
    return stem(key(c))


DEPTH = """case when decision in ('accepted', 'rejected') then 9
 when stage = 'intake' then 0 when stage = 'gate' then 3 when stage = 'e2b' then 5 when stage = 'package' then 9
 when state in ('accepted', 'rejected') then 9 else 0 end"""
OUTCOME = "case state when 'accepted' then 3 when 'rejected' then 2 when 'running' then 1 when 'queued' then 1 else 0 end"
IDENTITY = f"""case when family_id is not null then 'family:' || family_id when task_id is not null then 'task:' || task_id
 else 'declared:' || {key("task_name")} || '|' || coalesce(owner, 'unowned') end"""
METHOD = "case when family_id is not null then 'family_id' when task_id is not null then 'task_id' else 'name+owner' end"

# Runs with identity and rank, then one canonical run and a roll-up per identity.
IDS = f"""ids as (select *, {IDENTITY} as identity, {METHOD} as method, {DEPTH} as depth, {OUTCOME} as outcome,
  coalesce(decided_at, updated_at) as moment, cast(coalesce(decided_at, updated_at) as date) as day from r1_runs)"""
RANKED = """ranked as (select *, row_number() over (partition by identity order by depth desc, outcome desc, moment desc, pos) as rn,
  count(*) over (partition by identity) as n from ids)"""
MEMBER = f"""member as (select {key("split_part(name, '/', 3)")} as key, split_part(name, '/', 2) as cohort, count(*) as files,
  count(*) filter (where name like '%.zip') as packages, max(updated) filter (where name like '%.zip') as updated
  from r2_objects where length(name) - length(replace(name, '/', '')) >= 3 group by 1, 2)"""
ERA = (
    "case when moment >= timestamp '2024-01-24 05:06:54' then 'KESTREL full' when moment >= timestamp '2024-01-16 12:00:00' then 'KESTREL on' "
    "when moment >= timestamp '2024-01-08 00:00:00' then 'GLM-5.2 gate only' else 'Opus gate' end"
)
# One derived task per identity (needs IDS, RANKED and MEMBER before it).
TASKS = f"""roll as (select identity, count(*) as runs, bool_or(state = 'accepted' or decision = 'accepted') as ever_accepted, min(day) as first_day,
  max(moment) filter (where coalesce(nullif(decision, ''), state) = 'accepted') as accepted_at from ids group by identity),
perkey as (select key, bool_or(cohort = 'iteration_2') as at_bar, bool_or(cohort = 'gate_only') as gate_only, count(distinct cohort) as cohorts,
  cast(sum(packages) as bigint) as packages from member group by key),
flat as (select r.*, roll.runs, ever_accepted, first_day, accepted_at, coalesce(at_bar, false) as at_bar, coalesce(p.gate_only, false) as gate_only,
  coalesce(cohorts, 0) as cohorts, coalesce(packages, 0) as packages,
  (decision = 'accepted' or state = 'accepted') as acc, (decision = 'rejected' or state = 'rejected') as rej
  from ranked r join roll using (identity) left join perkey p on p.key = {key("r.task_name")} where rn = 1),
tasks as (select *, day >= date '{CUT}' as in_scope, first_day < date '{CUT}' and day >= date '{CUT}' as carried_over, {ERA} as era,
  case when acc and at_bar then 'accepted' when acc and accepted_at > timestamp '{NOW}' - interval 30 minutes then 'accepted'
    when acc then 'legacy accepted' when rej then 'rejected' when state in ('running', 'queued', 'error') then state else 'no QC decision' end as final_state,
  case when acc and at_bar then 'accepted and its package is in the current bar'
    when acc and accepted_at > timestamp '{NOW}' - interval 30 minutes then 'accepted within the grace window; package not written yet'
    when acc and gate_only then 'acceptance withdrawn: GLM-5.2 gate only, awaiting KESTREL re-gate'
    when acc and cohorts > 0 then 'delivered only to a retired bar' when acc then 'accepted but no package delivered anywhere'
    when rej then 'reached a QC decision and failed it' when state = 'running' then 'in a stage, no decision yet'
    when state = 'queued' then 'admitted, waiting on a slot' when state = 'error' then 'parked or crashed before a decision'
    else 'verdict reports a submission state only' end as why from flat)"""
CHAIN = f"with {IDS}, {RANKED}, {MEMBER}, {TASKS}"
