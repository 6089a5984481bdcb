"""Owners, sheets, reviews, the console, evaluations and payouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import packages as K
from taskweave.functions import runs as R
from taskweave.operators import lookups as J
from taskweave.operators import owners as O
from taskweave.operators import payouts as P
from taskweave.operators import segments as G
from taskweave.plans import fragments as X
from taskweave.plans.registry import query

c = F.col
PERSON = "{0} like '%@%' and not regexp_matches({0}, '(?i)gserviceaccount\\.com$|^companybench@|^dev@localhost$|harbor-operator')"


def person(col):
    return PERSON.format(col)


def one(keys_cte: str, people_cte: str, name: str) -> str:
    """Oracle: per row the one person its (id, key) rows name in (key, person)."""
    return f"""{name} as (select k.id, case when count(distinct p.person) = 1 then min(p.person) end as person, count(distinct p.person) as named from {keys_cte} k join {people_cte} p using (key) group by k.id)"""


def drive_rows(t):
    ref = K.source_ref(c("source_uri"), F.lit(None).cast("string"), F.lit(None).cast("string"), "bucket")
    return t.r3_deliveries.withColumn("source_folder", ref["folder"])


_OWNERS = f"""with ks as (select id, {X.bkey("task")} as key from r3_deliveries union select id, {X.bkey("package_name")} from r3_deliveries where package_name is not null),
rec as (select {X.bkey("task")} as key, trainer as person from r12_cycles where {person("trainer")}), ver as (select {X.bkey("name")} as key, owner as person from r10_truth where {person("owner")}),
{one("ks", "rec", "r1")}, {one("ks", "ver", "r2")},
ob as (select sha256, arg_max(owner, pos) as owner, arg_max(owner_contested, pos) as contested from (select *, coalesce(owner, '') as o from r11_folders) group by 1),
lf as (select sha256, max(pos) as pos from r11_folders group by 1), obj as (select f.sha256, f.owner, f.owner_contested from r11_folders f join lf using (sha256, pos)),
w as (select d.id, case when {person("obj.owner")} and not obj.owner_contested then obj.owner end as own, r1.person as p1, r1.named as n1, r2.person as p2, r2.named as n2 from r3_deliveries d left join obj on obj.sha256 = d.source_object left join r1 on r1.id = d.id left join r2 on r2.id = d.id),
owners as (select id, case when own is not null then 'object' when n1 > 0 then 'records' when n2 > 0 then 'verdict' end as route, case when own is not null then own when n1 > 0 then p1 else p2 end as trainer from w),
attributed as (select id, case when route is null then 'unattributed' when trainer is not null then 'attributed' else 'contested' end as state, route, trainer,
  case when route is not null and trainer is null then 'Contested' when route = 'object' then 'GCS package owner' when route = 'records' then 'GCS trainer records' when route = 'verdict' then 'GCS verdict owner' end as source from owners)"""


def attributed(t):
    return O.owner_waterfall(drive_rows(t), t.r11_folders, t.r12_cycles, t.r10_truth)


@query("j20_owner_waterfall", f"{_OWNERS} select * from attributed")
def _(t):
    return attributed(t)


@query("j20_owner_candidates", f"select distinct {X.bkey('task')} as key, trainer as person from r12_cycles where {person('trainer')}")
def _(t):
    return O.owner_candidates(t.r12_cycles, "task", "trainer")


@query(
    "j21_fill_owner_if_unique",
    f"""with o as (select lower(trim(name)) as key, owner as person from r10_truth where owner is not null), ks as (select id, lower(trim(task)) as key from r3_deliveries), {one("ks", "o", "f")},
x as (select d.*, f.person, f.named, case when not (d.trainer is null or lower(d.trainer) = 'unattributed' or ambiguous or source = 'Contested') then 'untouched' when f.named is null then 'not in pipeline' when f.named = 1 then 'resolved' else 'still ambiguous' end as outcome
  from r3_deliveries d left join f using (id))
select id, case when outcome = 'resolved' then person else trainer end as trainer, case when outcome = 'resolved' then 'GCS verdict owner' else source end as source, outcome from x""",
)
def _(t):
    return O.fill_owner_if_unique(t.r3_deliveries, t.r10_truth)


@query(
    "j22_attribute_folders",
    f"""with rec as (select lower(trim(task)) as key, trainer as person from r12_cycles), ks as (select pos as id, lower(trim(coalesce(declared_short, folder))) as key from r11_folders), {one("ks", "rec", "f")}
select x.pos, f.person as owner, coalesce(named > 1, false) as owner_contested, case when named = 1 then 'name match' when named > 1 then 'contested' else 'unattributed' end as owner_basis from r11_folders x left join f on f.id = x.pos""",
)
def _(t):
    return O.attribute_folders(t.r11_folders, t.r12_cycles)


_VARIANTS = """select {id}, {who} unnest([v, replace(v, '_', '-'), y, replace(y, '_', '-'), regexp_replace(y, '(-v\\d+|-fixed|-final)+$', ''), regexp_replace(replace(y, '_', '-'), '(-v\\d+|-fixed|-final)+$', '')]) as key
  from (select *, regexp_replace(v, '^task-', '') as y from (select {id}, {who} regexp_replace({col}, '\\.zip$', '') as v from {src}))"""
_SHEET = f"""sv as (select pos, trainer, regexp_replace(replace(lower(sheet_name), '_', '-'), '^task-', '') as a, lower(sheet_name) as b from r14_sheet),
ent as (select unnest([b, replace(b, '_', '-'), regexp_replace(b, '(-v\\d+|-fixed|-final)+$', ''), a, regexp_replace(a, '(-v\\d+|-fixed|-final)+$', '')]) as key, trainer as person from sv),
dn as (select id, unnest([lower(task), lower(package_name), case when source_uri like 'gs://bucket/%' then split_part(source_uri, '/', 6) end, regexp_replace(lower(list_last(string_split(package_path, '/'))), '\\.zip$', '')]) as n from r3_deliveries),
ur as (select id, unnest([case when source_uri like '%.zip' then regexp_replace(lower(list_last(string_split(source_uri, '/'))), '\\.zip$', '') else list_last(string_split(source_uri, '/')) end]) as n from r3_deliveries),
rk as (select distinct id, key from (select id, unnest([n, replace(n, '_', '-'), regexp_replace(regexp_replace(n, '^task-', ''), '(-v\\d+|-fixed|-final)+$', '')]) as key from (select * from dn union all select * from ur where n is not null) where n is not null) where length(key) > 6),
{one("rk", "ent", "sh")}, hit as (select distinct rk.id from rk join ent using (key))"""


@query(
    "j23_sheet_trainer",
    f"""with {_SHEET}, x as (select d.*, sh.person, coalesce(sh.named = 1 and (lower(trainer) = 'unattributed' or (bench = 'company' and lower(trainer) <> sh.person)), false) as takes, lower(trainer) <> 'unattributed' as has from r3_deliveries d left join sh using (id))
select id, case when takes then person when has then trainer end as trainer, case when takes then 'Trainer credit sheet' else source end as source, case when takes and has then trainer end as bucket_trainer, takes as from_sheet from x""",
)
def _(t):
    return O.sheet_trainer(drive_rows(t), O.sheet_entries(t.r14_sheet))


@query(
    "j24_sheet_coverage",
    f"""{_OWNERS}, {_SHEET}, x as (select d.bench, a.state, case when a.state <> 'attributed' then case when sh.named = 1 then 'filled' when sh.named > 1 then 'sheet names several' when hit.id is not null then 'sheet row with no trainer' else 'not in the sheet' end
   when sh.named = 1 and sh.person <> lower(a.trainer) then case when d.bench = 'company' then 'replaced' else 'sheet disagrees' end end as outcome
  from r3_deliveries d join attributed a using (id) left join sh using (id) left join hit using (id))
select bench, state, outcome, count(*) as n from x where outcome is not null group by 1, 2, 3""",
)
def _(t):
    return O.sheet_coverage(drive_rows(t), O.sheet_entries(t.r14_sheet), attributed(t))


@query(
    "j25_review_override",
    f"""with r as (select *, {X.bkey("task")} as key from r15_reviews), j as (select d.id, d.trainer as was, d.source, lower(d.trainer) <> 'unattributed' as has, case when a.batch is not null then a.trainer else b.trainer end as trainer, coalesce(a.batch, b.batch) is not null as hit,
  coalesce(a.trainer_type, b.trainer_type) as kind from r3_deliveries d left join r a on a.batch = d.batch and a.key = {X.bkey("d.task")} left join r b on b.batch = d.batch and b.key = {X.bkey("d.package_name")})
select id, coalesce(trainer, case when has then was end) as trainer, case when trainer is not null then 'Trainer review' else source end as source, case when hit and trainer is null then kind end as reviewed_no_trainer,
  case when trainer is not null and has and lower(was) <> trainer then was end as bucket_trainer from j""",
)
def _(t):
    return O.review_override(t.r3_deliveries, t.r15_reviews)


_FEEDBACK = f"""fb as (select batch, {X.bkey("task")} as k, arg_max(acceptance, pos) as acceptance, arg_max(priority, pos) as priority from r3_deliveries where acceptance in ('Accepted', 'Rejected') group by 1, 2)"""


@query(
    "j26_client_feedback",
    f"""with {_FEEDBACK} select d.id, coalesce(a.acceptance, b.acceptance, d.acceptance) as acceptance, coalesce(a.priority, b.priority, d.priority) as priority, coalesce(a.batch, b.batch) is not null as judged
from r3_deliveries d left join fb a on a.batch = d.batch and a.k = {X.bkey("d.task")} left join fb b on b.batch = d.batch and b.k = {X.bkey("d.package_name")}""",
)
def _(t):
    return O.client_feedback(t.r3_deliveries, t.r3_deliveries)


@query(
    "j27_merge_deliveries",
    f"""with share as (select distinct batch, {X.bkey("name")} as key from r16_manifest)
select id, batch, case when exists (select 1 from share s where s.batch = a.batch and s.key = {X.bkey("a.task")}) then 'company' else bench end as bench, false as from_manifest from r3_deliveries a
union all select 'M-' || cast(pos as string), batch, 'computer', true from r16_manifest where batch not in (select batch from r3_deliveries)""",
)
def _(t):
    drive = t.r16_manifest.select(F.concat(F.lit("M-"), c("pos").cast("string")).alias("id"), "batch", c("name").alias("task"), F.lit("computer").alias("bench"))
    share = t.r16_manifest.select("batch", N.bench_key(c("name")).alias("key"))
    return O.merge_deliveries(t.r3_deliveries.select("id", "batch", "task", "bench"), drive, share).drop("task")


_CONSOLE = f"""ck as (select lower(trainer) as who, unnest([{X.bkey("name")}, {X.bkey("task_id")}, {X.bkey("family_id")}, {X.bkey("run_id")}]) as key from r13_console where trainer like '%@%'),
co as (select key, case when count(distinct who) = 1 then min(who) end as owner, count(distinct who) > 1 as contested from ck group by 1),
cl as (select *, {X.bkey("name")} as key, row_number() over (partition by {X.bkey("name")} order by submitted_at desc nulls last, pos) as rn from r13_console)"""
_STATUS = "case state when 'accepted' then 'Accepted' when 'rejected' then 'Rejected' when 'error' then 'Failed' when 'running' then 'Running' when 'legacy_accepted' then 'Legacy accepted' else 'Queued' end"


@query("a46_console_owners", f"with {_CONSOLE} select * from co")
def _(t):
    return O.console_owners(t.r13_console)


@query("a46_console_latest", f"with {_CONSOLE} select key, {_STATUS} as status, cast(submitted_at as date) as day, pos from cl where rn = 1")
def _(t):
    latest = O.console_latest(t.r13_console)
    return latest.select("key", O.console_status(c("state")).alias("status"), F.to_date("submitted_at").alias("day"), "pos")


@query(
    "j28_finalisation_owner",
    f"""with {_CONSOLE}, tr as (select lower(email) as email, max(team) as team from r6_roster group by 1),
al as (select alias, min(email) as email from (select lower(email) as email, unnest([regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(split_part(lower(email), '@', 1), '[^a-z0-9]', '', 'g')]) as alias from r6_roster) group by 1 having count(distinct email) = 1),
b as (select f.pos, f.owner as given, f.owner_contested, coalesce(o1.owner, o2.owner) as oc from r11_folders f left join co o1 on o1.key = {X.bkey("coalesce(f.declared_short, f.folder)")} left join co o2 on o2.key = {X.bkey("f.declared_name")}),
e as (select b.*, lower(coalesce(oc, given)) as email, owner_contested and oc is null as contested, case when oc is null then regexp_replace(lower(given), '[^a-z0-9]', '', 'g') end as alias from b),
t2 as (select e.*, case when not contested then coalesce(tr.team, t3.team) end as team from e left join tr on tr.email = e.email left join al on al.alias = e.alias left join tr t3 on t3.email = al.email)
select pos, email as owner, case when contested then 'conflict' when team is not null then 'linked' when email is not null then 'unlinked' else 'missing' end as ownership,
  case when contested then 'Contested owner' when oc is not null then 'Harbor Console submitter' when given is not null then 'Name match only' else 'No trainer record' end as attribution,
  case when team = 'Company' then 'company' when team in ('Computer A', 'Computer B') then 'computer' else 'unassigned' end as bench from t2""",
)
def _(t):
    return O.finalisation_owner(t.r11_folders, t.r6_roster, O.console_owners(t.r13_console))


_CYCLE_STATUS = """case when 'accepted' in (a, b) and 'rejected' in (a, b) then 'Conflicting verdict' when 'accepted' in (a, b) then 'Accepted' when 'rejected' in (a, b) then 'Rejected'
  when r = 'waiting_for_trainer_edit' then 'Rejected' when r = 'infrastructure_error' then 'Failed' when r = 'done' then 'Submitted' when r = 'running' then 'Running'
  when r = 'queued' then 'Queued' when r = 'on_hold_now' then 'On Hold Now' else 'Unknown' end"""
_CYC = f"""cy as (select *, {_CYCLE_STATUS} as status from (select *, lower(coalesce(submission_status, '')) as a, lower(coalesce(decision, '')) as b, lower(coalesce(raw_status, '')) as r from r12_cycles))"""
_EVIDENCE = f"""{_CONSOLE}, {_CYC}, lg as (select {X.bkey("task")} as key, count(*) as cycles, max(attempt) as attempts from cy group by 1), ls as (select distinct {X.bkey("task")} as key, status from cy),
fo as (select {X.bkey("coalesce(declared_short, folder)")} as key, count(*) as folders, cast(sum(archives) as bigint) as archives from r11_folders group by 1), n as (select {X.bkey("name")} as key, count(*) as submissions from r13_console group by 1),
m as (select cl.key, {_STATUS} as status, cast(submitted_at as date) as day, nullif(lower(trainer), '') as owner, coalesce(task_type, 'Not recorded') as task_type from cl where rn = 1),
evidence as (select m.key, m.status, m.day, day is null or day < date '2024-01-10' as legacy, m.owner, r.email is not null as on_roster, case when r.team = 'Company' then 'company' when r.team in ('Computer A', 'Computer B') then 'computer' else 'unassigned' end as bench,
  m.task_type, submissions, coalesce(cycles, 0) as cycles, coalesce(attempts, 0) as attempts, coalesce(cycles, 0) > 0 and ls.key is null as disagrees, coalesce(folders, 0) as folders, coalesce(archives, 0) as archives
  from m join n using (key) left join lg using (key) left join ls on ls.key = m.key and ls.status = m.status left join fo on fo.key = m.key left join r6_roster r on lower(r.email) = m.owner)"""


def evidence(t):
    cycles = t.r12_cycles.select("task", R.cycle_status(c("submission_status"), c("decision"), c("raw_status")).alias("status"), "attempt")
    folders = t.r11_folders.select(F.coalesce("declared_short", "folder").alias("name"), "archives")
    return O.console_evidence(t.r13_console, cycles, folders, t.r6_roster, "2024-01-10")


@query("j29_console_evidence", f"with {_EVIDENCE} select * from evidence")
def _(t):
    return evidence(t)


@query(
    "f04_filter_console",
    f"with {_EVIDENCE} select 'delivered' as evidence, count(*) as tasks from evidence where not legacy and folders > 0 union all select 'undelivered', count(*) from evidence where not legacy and folders = 0 "
    "union all select 'disagree', count(*) from evidence where not legacy and disagrees union all select 'offroster', count(*) from evidence where not legacy and owner is not null and not on_roster "
    "union all select 'legacy only', count(*) from evidence where legacy",
)
def _(t):
    from taskweave.operators.filters import filter_console

    rows = evidence(t)
    kinds = ("delivered", "undelivered", "disagree", "offroster")
    out = None
    for kind in kinds:
        one_kind = filter_console(rows, {"evidence": kind}).agg(F.lit(kind).alias("evidence"), F.count("*").alias("tasks"))
        out = one_kind if out is None else out.unionByName(one_kind)
    return out.unionByName(filter_console(rows, {"legacy": "only"}).agg(F.lit("legacy only").alias("evidence"), F.count("*").alias("tasks")))


@query(
    "a25_console_statuses",
    f"""with {_EVIDENCE}, kept as (select key, status from evidence where not legacy), subs as (select {X.bkey("name")} as key, {_STATUS} as status from r13_console where submitted_at >= timestamp '2024-01-10 00:00:00'), s as (select * from subs where key in (select key from kept))
select 'task' as unit, status, count(*) as n from kept group by 2 union all select 'submission', status, count(*) from s group by 2
union all select 'repeat tasks', '', count(*) from (select key from s group by 1 having count(*) > 1)""",
)
def _(t):
    kept = evidence(t).where("not legacy").select("key", "status")
    in_scope = F.coalesce(F.to_date("submitted_at") >= F.lit("2024-01-10").cast("date"), F.lit(False))
    return O.console_statuses(t.r13_console, kept, in_scope)


# ------------------------------------------------------------------ evaluations
@query(
    "a21_latest_per_family",
    """select owner_key, coalesce(family_id, task_id) as family, id, attempt from r12_cycles
qualify row_number() over (partition by owner_key, coalesce(family_id, task_id) order by sequence desc, submitted_on desc, attempt desc, id desc) = 1""",
)
def _(t):
    return O.latest_per_family(t.r12_cycles).select("owner_key", "family", "id", "attempt")


@query(
    "a22_unique_runs",
    """with f as (select distinct l_partkey % 3000 as owner_key, l_orderkey as id, l_returnflag as status from lineitem) select owner_key, id, count(*) as versions from f group by 1, 2 having count(*) > 1""",
)
def _(t):
    runs = t.lineitem.select((c("l_partkey") % 3000).alias("owner_key"), c("l_orderkey").alias("id"), c("l_returnflag").alias("status"))
    return O.unique_runs(runs, ["owner_key", "id"])[1]


@query(
    "a23_cohort_totals",
    """with f as (select * replace (case when pos % 7 > 0 then cohort end as cohort) from r11_folders)
select case when grouping(cohort) = 1 then 'All' else coalesce(cohort, '(not recorded)') end as cohort, count(*) as tasks, count(*) filter (where outcome = 'accepted') as accepted, count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'unsubmitted') as unsubmitted,
  count(*) filter (where outcome = 'promoted') as promoted, count(*) filter (where outcome in ('accepted', 'rejected')) as graded, cast(sum(archives) as bigint) as archives from f group by rollup (cohort)""",
)
def _(t):
    # Some cohorts are not recorded.
    return O.cohort_totals(t.r11_folders.withColumn("cohort", F.when(c("pos") % 7 > 0, c("cohort"))))


_FINDUP = f"""with x as (select *, {X.bkey("coalesce(declared_short, folder)")} as name from r11_folders), g as (select name, arg_max(pos, updated - date '2000-01-01' + 0.0 - pos / 1e9) as counted, count(*) as group_size, count(distinct cohort_label) as cohorts_for_task from x group by 1)"""


@query("a24_finalisation_duplicates", f"{_FINDUP} select pos, name, pos <> counted as duplicate, group_size, counted, cohorts_for_task from x join g using (name)")
def _(t):
    return O.finalisation_duplicates(t.r11_folders)


@query(
    "a47_client_acceptance",
    """with p as (select o_orderpriority as priority, count(*) as n from orders group by 1) select 'priority' as measure, priority as value, n from p
union all select 'accepted', '', count(*) from orders where o_orderpriority = '5-LOW' union all select 'disagree', '', (select count(*) from orders where (o_orderpriority = '5-LOW') <> (o_orderstatus = 'F'))""",
)
def _(t):
    from taskweave.operators.audits import client_acceptance

    layer = t.orders.where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id"))
    return client_acceptance(t.orders.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("priority")), layer, "5-LOW")


# ---------------------------------------------------------------------- payouts
_LED = """led as (select lower(task) as task_key, email, count(*) - 1 as duplicate_rows, arg_min(valid, src_row) as valid, arg_min(type, src_row) filter (where type is not null) as type, arg_min(cj, src_row) filter (where cj is not null) as cj,
  arg_min(bench, src_row) as bench, arg_min(task, src_row) as task from r4_ledger group by 1, 2)"""
_REQ = """cjo as (select cj, email from r6_roster), req as (select coalesce(o.email, r.email) as email, r.email as tracker_email, coalesce(o.email <> r.email, false) as email_mismatch, r.cj, requested_on, paid_tasks, paid_amount from r5_requests r left join cjo o using (cj))"""
_PEOPLE = f"""{_LED}, {_REQ}, li as (select email, count(*) as listed from led group by 1), tk as (select email, count(*) as n, cast(sum(paid_tasks) as bigint) as t from req group by 1),
pb as (select coalesce(li.email, p.email) as email, coalesce(listed, 0) as listed, coalesce(p.paid_tasks, 0) as paid from li full join r5_paid p on p.email = li.email),
people as (select pb.email, listed as listed_tasks, listed as accepted_tasks, paid as paid_tasks, paid * 300 as paid_amount, least(paid, listed) as itemised_paid_tasks, greatest(paid - listed, 0) as unitemised_paid_tasks,
  coalesce(n, 0) as payment_requests, coalesce(t, 0) as tracker_tasks, coalesce(t, 0) <> paid as tracker_mismatch, greatest(listed - paid, 0) as pending_tasks, greatest(listed - paid, 0) * 300 as pending_amount from pb left join tk using (email)),
st as (select led.*, case when p.paid_tasks >= p.listed_tasks and p.paid_tasks > 0 then 'Paid' when p.paid_tasks > 0 then 'Not itemised' else 'Not paid' end as payment_state from led left join people p using (email))"""


def cjs(t):
    return t.r6_roster.select("email", "cj", c("email").alias("row"))


def books(t):
    """(ledger, requests, people) of the driver's ledger."""
    ledger = P.collapse_ledger(t.r4_ledger)
    requests = P.resolve_payment_owner(t.r5_requests, cjs(t))
    return ledger, requests, P.people_balance(ledger, t.r5_paid, requests)


@query("a26_collapse_ledger", f"with {_LED} select * from led")
def _(t):
    return P.collapse_ledger(t.r4_ledger).drop("accepted")


@query("j30_resolve_payment_owner", f"with {_REQ} select * from req")
def _(t):
    return P.resolve_payment_owner(t.r5_requests, cjs(t))


@query("a27_people_balance", f"with {_PEOPLE} select * from people")
def _(t):
    return books(t)[2]


@query("a28_payment_state", f"with {_PEOPLE} select task_key, email, payment_state from st")
def _(t):
    ledger, _requests, people = books(t)
    return P.payment_state(ledger, people).select("task_key", "email", "payment_state")


_SUMS = ["accepted_tasks", "paid_tasks", "paid_amount", "payment_requests", "itemised_paid_tasks", "unitemised_paid_tasks", "pending_tasks", "pending_amount"]


@query(
    "a29_ledger_totals",
    f"with {_PEOPLE} select 'source_rows' as measure, count(*) as value from r4_ledger union all select 'ledger_tasks', count(*) from led union all select 'duplicate_rows', cast(sum(duplicate_rows) as bigint) from led "
    "union all select 'invalid_tasks', count(*) from led where not valid union all select 'tracker_mismatches', count(*) from people where tracker_mismatch "
    + " ".join(f"union all select '{s}', cast(sum({s}) as bigint) from people" for s in _SUMS),
)
def _(t):
    ledger, _requests, people = books(t)
    return P.ledger_totals(t.r4_ledger, ledger, people)


_SEG = """case when bench = 'company' then 'company' when type = 'Connector' then 'computer-connector' when type = 'Non-connector' then 'computer-non-connector' when bench = 'computer' then 'computer' else 'unknown' end"""
_SPLIT = f"""{_PEOPLE}, sg as (select *, {_SEG} as segment from st), lv as (select email, segment, count(*) filter (where payment_state = 'Paid') as itemised, count(*) filter (where payment_state = 'Not paid') as unpaid, count(*) filter (where payment_state = 'Not itemised') as open from sg group by 1, 2),
pp as (select p.email, p.paid_tasks, coalesce(sum(itemised), 0) as it, coalesce(sum(open), 0) as op, count(*) filter (where open > 0) as places from people p left join lv using (email) group by 1, 2),
ps as (select *, least(greatest(paid_tasks - it, 0), op) as open_paid, greatest(greatest(paid_tasks - it, 0) - least(greatest(paid_tasks - it, 0), op), 0) as extra from pp),
split as (select email, segment, cast(itemised + case when places = 1 and open > 0 then open_paid else 0 end as bigint) as paid, cast(unpaid + case when places = 1 and open > 0 then op - open_paid else 0 end as bigint) as pending from lv join ps using (email)
  union all select email, '(unplaced)', cast(extra + case when places > 1 then open_paid else 0 end as bigint), cast(case when places > 1 then op - open_paid else 0 end as bigint) from ps),
sp as (select * from split where paid > 0 or pending > 0)"""


def split(t):
    ledger, _requests, people = books(t)
    flag = F.when(c("type") == "Connector", True).when(c("type") == "Non-connector", False)
    stated = P.payment_state(ledger, people).withColumn("segment", K.task_segment(c("bench"), flag, F.lit(None).cast("string")))
    return P.payout_split(stated, people)


@query("a30_payout_split", f"with {_SPLIT} select * from sp")
def _(t):
    return split(t)


def _money(bucket, name):
    return f"""with {_SPLIT} select {bucket} as {name}, cast(sum(paid) as bigint) as paid_tasks, cast(sum(pending) as bigint) as pending_tasks, cast(sum(paid) * 300 as bigint) as paid, cast(sum(pending) * 300 as bigint) as pending, count(distinct email) as people from sp group by 1"""


@query("a31_segment_money", _money("segment", "segment"))
def _(t):
    return P.money_by(split(t), c("segment"), "segment")


@query("a31_bench_money", _money("case when segment like 'company%' then 'company' when segment like 'computer%' then 'computer' else 'unassigned' end", "bench"))
def _(t):
    return P.money_by(split(t), P.bench_of_segment(c("segment")), "bench")


_ROWS = f"""{_LED}, pr as (select r.*, coalesce(a.n, 0) as accepted_tasks, coalesce(p.paid_tasks, 0) as paid_tasks, coalesce(p.paid_amount, 0) as paid_amount, greatest(coalesce(a.n, 0) - coalesce(p.paid_tasks, 0), 0) as pending_tasks,
  greatest(coalesce(a.n, 0) - coalesce(p.paid_tasks, 0), 0) * 300 as pending_amount from r6_roster r left join (select email, count(*) as n from led group by 1) a using (email) left join r5_paid p using (email))"""


def rows(t):
    return P.payout_rows(t.r6_roster, P.collapse_ledger(t.r4_ledger), t.r5_paid)


@query("a32_payout_rows", f"with {_ROWS} select email, accepted_tasks, paid_tasks, paid_amount, pending_tasks, pending_amount from pr")
def _(t):
    return rows(t).select("email", "accepted_tasks", "paid_tasks", "paid_amount", "pending_tasks", "pending_amount")


@query(
    "a33_bench_shares",
    f"""with {_LED}, s as (select email, count(*) filter (where bench = 'company') as a, count(*) filter (where bench = 'computer') as b from led group by 1)
select email, case when a + b > 0 then a / (a + b) else 0.0e0 end as company, case when a + b > 0 then b / (a + b) else 0.0e0 end as computer, case when a + b > 0 then 0.0e0 else 1.0e0 end as unassigned from s""",
)
def _(t):
    shares = P.bench_shares(P.collapse_ledger(t.r4_ledger))
    return shares.select("email", *[c(x).cast("double").alias(x) for x in ("company", "computer", "unassigned")])


@query(
    "a34_person_segments",
    f"""with l as (select lower(email) as email, {_SEG} as segment from r4_ledger), t as (select lower(owner) as email, case when bench_side = 'company' then 'company' when connector then 'computer-connector' when not connector then 'computer-non-connector' when bench_side = 'computer' then 'computer' else 'unknown' end as segment from r10_truth where owner is not null)
select email, segment from l where segment <> 'unknown' union select email, segment from t where segment <> 'unknown'""",
)
def _(t):
    none = F.lit(None).cast("string")
    flag = F.when(c("type") == "Connector", True).when(c("type") == "Non-connector", False)
    ledger = t.r4_ledger.select("email", K.task_segment(c("bench"), flag, none).alias("segment"))
    tasks = t.r10_truth.select(c("owner").alias("email"), K.task_segment(c("bench_side"), c("connector"), none).alias("segment"))
    return G.person_segments(ledger, tasks)


@query(
    "a35_team_scorecard",
    f"""with {_ROWS} select team, cast(sum(accepted_tasks) as bigint) as accepted, cast(sum(paid_amount) as bigint) as paid, cast(sum(pending_amount) as bigint) as owed, count(*) filter (where status = 'Active') as active, count(distinct manager) as managers, count(*) as people,
  cast(floor(sum(paid_amount) * 100 / (sum(paid_amount) + sum(pending_amount)) + 0.5) as bigint) as settled from pr group by team""",
)
def _(t):
    return P.team_scorecard(rows(t))


@query(
    "a36_roster_summary",
    """select 'trainers' as measure, 'active' as key, count(*) filter (where status = 'Active') as n from r6_roster union all select 'trainers', 'total', count(*) from r6_roster union all select 'team', team, count(*) from r6_roster group by 2
union all select 'status', status, count(*) from (select coalesce(nullif(raw_status, ''), 'Unknown') as status from r12_cycles union all select coalesce(state, 'Unknown') from r13_console) group by 2""",
)
def _(t):
    return P.roster_summary(t.r6_roster, t.r12_cycles.select(c("raw_status").alias("status")), t.r13_console.select(c("state").alias("status")))


@query("a37_plan_vs_actual", "select bench, cast(sum(plan) as bigint) as planned, cast(sum(actual) as bigint) as done, sum(actual) / sum(plan) as share from r9_plan where day between date '1995-03-01' and date '1997-06-30' group by 1")
def _(t):
    return P.plan_vs_actual(t.r9_plan, "1995-03-01", "1997-06-30")


@query(
    "a55_payout_summary",
    f"""with {_ROWS}, m as (select cast(sum(accepted_tasks) as bigint) as accepted_tasks, cast(sum(paid_tasks) as bigint) as paid_tasks, cast(sum(paid_amount) as bigint) as paid, cast(sum(pending_amount) as bigint) as upcoming, count(*) filter (where accepted_tasks > 0 or paid_tasks > 0) as people from pr),
d as (select count(*) as requests, min(requested_on) as first_request, max(requested_on) as last_request from r5_requests) select m.*, cast(floor(paid * 100 / (paid + upcoming) + 0.5) as bigint) as settled, d.* from m, d""",
)
def _(t):
    return P.payout_summary(rows(t), t.r5_requests)


@query("a56_team_money", f"with {_ROWS} select team, cast(sum(paid_amount) as bigint) as paid, cast(sum(pending_amount) as bigint) as owed, count(*) as people from pr where paid_amount > 0 or pending_amount > 0 group by 1")
def _(t):
    return P.team_money(rows(t))


@query(
    "a57_ledger_strip",
    f"""with {_PEOPLE} select count(*) as tasks, count(*) filter (where payment_state = 'Paid') as paid, count(*) filter (where payment_state = 'Not itemised') as not_itemised, count(*) filter (where payment_state = 'Not paid') as not_paid,
  count(*) filter (where not valid) as invalid, cast(sum(duplicate_rows) as bigint) as folded_rows from st""",
)
def _(t):
    ledger, _requests, people = books(t)
    return P.ledger_strip(P.payment_state(ledger, people))
