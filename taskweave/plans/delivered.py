"""Deliveries against tasks, manifests against the bucket, folders against verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import packages as K
from taskweave.operators import delivered as D
from taskweave.operators import lookups as J
from taskweave.plans import fragments as X
from taskweave.plans.registry import query
from taskweave.sources.package_text import package_facts

c = F.col
READY = "at_current_bar and state in ('accepted', 'legacy accepted') and not delivered"
_S = X.stem

_BASE = f"""with a as (select pos, task, lower(trim(task)) as k, {_S("lower(trim(task))")} as st from r3_deliveries),
tr as (select id, name, lower(trim(name)) as k, {_S("lower(trim(name))")} as st, lower(id) || '/' || lower(source) as hay from r10_truth),
amb as (select st from tr group by st having count(distinct k) > 1), named as (select k from tr union select st from tr),
cand as (select distinct k from a where length(k) > 14 and st not in (select st from amb) and k not in (select k from named)),
hp as (select id, hay, '|' || regexp_replace(hay, '[^0-9a-z]', '|', 'g') || '|' as pad from tr), cp as (select k, '|' || regexp_replace(k, '[^0-9a-z]', '|', 'g') || '|' as pad from cand),
emb as (select hp.id, cp.k from hp join cp on contains(hp.hay, cp.k) and contains(hp.pad, cp.pad))"""
_HITS = f"""{_BASE}, hits as (select a.pos, tr.id, 0 as m from a join tr on a.k = tr.k union all select a.pos, tr.id, 1 from a join tr on a.st = tr.st where a.st not in (select st from amb)
  union all select a.pos, emb.id, 2 from a join emb on a.k = emb.k),
pairs as (select pos, id, min(m) as m from hits group by 1, 2), win as (select id, min(pos) as pos from pairs group by 1), matched as (select distinct pos from win),
lastm as (select id, arg_max(m, pos) as m from pairs where pos in (select pos from matched) group by 1)"""
_METHOD = "case m when 0 then 'name' when 1 then 'normalised name' when 2 then 'embedded in the verdict identifier' end"


def audit(t):
    return t.r3_deliveries.select("pos", "task", "batch", "acceptance")


def ready(t):
    return t.r10_truth.where(READY)


@query(
    "j02_classify_connector",
    f"""with s as (select pos, is_connector, connector_services as svc, unnest([declared_short, folder, declared_name]) as sp from r11_folders where is_connector is not null),
e as (select {X.key("sp")} as k, arg_min(is_connector, pos) as f from s where sp is not null group by 1), l as (select {X.norm("sp")} as k, arg_min(is_connector, pos) as f from s where sp is not null group by 1),
v as (select k, arg_min(svc, pos) as svc from (select {X.key("sp")} as k, svc, pos from s where svc is not null and sp is not null union all select {X.norm("sp")}, svc, pos from s where svc is not null and sp is not null) group by k)
select id, coalesce(e.f, l.f, connector) as is_connector, case when e.f is not null then 'name' when l.f is not null then 'normalised name' when connector is not null then 'ingest chain' else 'no package scanned' end as via,
  case when coalesce(e.f, l.f, connector) then array_to_string(list_sort(coalesce(v1.svc, v2.svc)), ',') end as services
from r10_truth t left join e on e.k = {X.key("t.name")} left join l on l.k = {X.norm("t.name")} left join v v1 on v1.k = {X.key("t.name")} left join v v2 on v2.k = {X.norm("t.name")}""",
)
def _(t):
    return J.classify_connector(t.r10_truth, t.r11_folders).select("id", "is_connector", "via", F.array_join("found_services", ",").alias("services"))


_CLASSIFIED = """with s as (select pos, is_connector, unnest([declared_short, folder, declared_name]) as sp from r11_folders where is_connector is not null),
e as (select %s as k, arg_min(is_connector, pos) as f from s where sp is not null group by 1), l as (select %s as k, arg_min(is_connector, pos) as f from s where sp is not null group by 1),
z as (select t.*, e.f as ef, l.f as lf, coalesce(e.f, l.f, connector) as v from r10_truth t left join e on e.k = %s left join l on l.k = %s)""" % (
    X.key("sp"), X.norm("sp"), X.key("t.name"), X.norm("t.name"),
)


@query(
    "a49_agreement",
    f"""{_CLASSIFIED} select count(*) as tasks, count(v) as classified, count(*) filter (where v) as connector, count(*) filter (where not v) as non_connector,
  count(*) - count(v) as unknown, count(*) filter (where at_current_bar) as at_bar, count(v) filter (where at_current_bar) as classified_at_bar, count(ef) as by_name,
  count(*) filter (where ef is null and lf is not null) as by_stem, count(*) filter (where ef is null and lf is null and connector is not null) as by_chain from z""",
)
def _(t):
    return J.connector_agreement(J.classify_connector(t.r10_truth, t.r11_folders))


@query(
    "a49_services_used",
    f"""{_CLASSIFIED.replace("select pos, is_connector, unnest", "select pos, is_connector, connector_services as svc, unnest")},
v as (select k, arg_min(svc, pos) as svc from (select {X.key("sp")} as k, svc, pos from s where svc is not null and sp is not null union all select {X.norm("sp")}, svc, pos from s where svc is not null and sp is not null) group by k)
select service, count(*) as tasks from (select unnest(coalesce(v1.svc, v2.svc)) as service from z left join v v1 on v1.k = {X.key("z.name")} left join v v2 on v2.k = {X.norm("z.name")} where z.v) group by 1""",
)
def _(t):
    return J.services_used(J.classify_connector(t.r10_truth, t.r11_folders))


@query("j03_join_delivered", f"{_HITS} select win.id, {_METHOD} as method, a.task as delivered_task from win join a using (pos) join lastm using (id)")
def _(t):
    return D.join_delivered(audit(t), t.r10_truth)[0]


@query("j04_norm_collision", f"{_BASE} select st as stem, count(distinct k) as spellings from tr group by st having count(distinct k) > 1")
def _(t):
    return D.name_collisions(t.r10_truth)


@query("j05_embedded_name_join", f"{_BASE} select id, k as value from emb")
def _(t):
    names = D.audit_keys(audit(t), t.r10_truth).where(c("kind") == D.BY_ID)
    hay = F.concat(N.plain_key(c("id")), F.lit("/"), N.plain_key(c("source")))
    return D.embedded_in(t.r10_truth, "id", hay, names)


@query(
    "j06_first_claimant",
    f"""{_HITS}, held as (select pairs.pos, min(m) as m, min(a.task) as holder from pairs join win using (id) join a on a.pos = win.pos group by 1)
select a.pos, mt.pos is not null as matched, case when mt.pos is not null then {_METHOD} end as method, case when mt.pos is null then holder end as claimed_by,
  case when mt.pos is not null then null when holder is not null then 'its only pipeline rows are already claimed by ' || holder when a.st in (select st from amb) then 'several pipeline names share this normalised name'
    else 'no task decided in the pipeline window carries this name' end as reason
from a left join held on held.pos = a.pos left join matched mt on mt.pos = a.pos""",
)
def _(t):
    return D.join_delivered(audit(t), t.r10_truth)[1].select("pos", "matched", "method", "claimed_by", "reason")


@query(
    "j07_whereabouts",
    f"""with s as (select outcome, cohort_label, folder, unnest([declared_short, folder, declared_name]) as sp from r11_folders),
k as (select distinct outcome, cohort_label, folder, lower(trim(sp)) as k from s where sp is not null union select outcome, cohort_label, folder, {_S("lower(trim(sp))")} from s where sp is not null),
g as (select k, array_to_string(list_sort(list(distinct outcome)), ',') as outcomes, array_to_string(list_sort(list(distinct cohort_label)), ',') as cohorts, count(distinct folder) as folders from k group by k)
select pos, coalesce(a.k, b.k) is not null as in_bucket, case when a.k is not null then a.outcomes else b.outcomes end as outcomes, case when a.k is not null then a.cohorts else b.cohorts end as cohorts,
  case when a.k is not null then a.folders else b.folders end as folders from r3_deliveries d left join g a on a.k = lower(trim(d.task)) left join g b on b.k = {_S("lower(trim(d.task))")}""",
)
def _(t):
    w = D.whereabouts(audit(t), t.r11_folders)
    return w.select("pos", "in_bucket", F.array_join("outcomes", ",").alias("outcomes"), F.array_join("cohorts", ",").alias("cohorts"), "folders")


_CLAIMS = f"""with sp as (select pos, task, batch, 0 as n, lower(trim(task)) as key from m union all select pos, task, batch, 1, lower(trim(task_id)) from m where task_id is not null union all select pos, task, batch, 2, lower(trim(folder)) from m),
bk as (select key, arg_min(task, pos * 10 + n) as task, arg_min(batch, pos * 10 + n) as batch from sp group by key),
p as (select id, name, lower(trim(name)) as k0, regexp_replace(lower(id), '^[^:]*:', '') as k1, regexp_replace(regexp_replace(lower(id), '^[^:]*:', ''), '-[0-9a-f]{{6,}}$', '') as k2 from r10_truth where {READY}),
h as (select id, name, k0, coalesce(b0.task, b1.task, b2.task) as task, case when b0.task is not null then b0.batch when b1.task is not null then b1.batch else b2.batch end as batch
  from p left join bk b0 on b0.key = k0 left join bk b1 on b1.key = k1 left join bk b2 on b2.key = k2),
v as (select *, {_S("k0")} = {_S("lower(task)")} and k0 <> lower(task) as version_of, k0 = lower(task) or regexp_matches(k0, '^(harbor-single-task-|autorun-|content-[0-9a-f]{{16,}}|task\\d*$|task[-_]|g\\d+_|code-c\\d+$|tasks?$)') as own from h where task is not null),
claims as (select id, task, batch, not version_of and own as claimed, case when not version_of and own then 'claimed' when version_of then 'a version of a delivered name' else 'matched through the family id' end as rule from v)"""
_CLAIMS = _CLAIMS.replace("with sp as", "with m as (select pos, name as task, task_id, folder, batch from r16_manifest), sp as")


def claims(t):
    return D.manifest_claims(t.r10_truth, t.r16_manifest, t.r10_truth.where("delivered"))


@query("j08_manifest_claims", f"{_CLAIMS} select id, task, batch, claimed, rule from claims")
def _(t):
    return claims(t).drop("name")


@query(
    "j08_placed_by_manifest",
    f"""{_CLAIMS}, n as (select task, count(*) as n from claims where claimed group by task), u as (select pos, task, row_number() over (partition by task order by pos) as rn from r3_deliveries)
select pos, task from u join n using (task) where rn <= n""",
)
def _(t):
    return D.placed_by_manifest(t.r3_deliveries.select("pos", "task"), claims(t))


@query(
    "j09_suspect_embedded",
    f"""with cand as (select distinct lower(trim(task)) as k from r3_deliveries where length(trim(task)) > 14), cp as (select k, '|' || regexp_replace(k, '[^0-9a-z]', '|', 'g') || '|' as pad from cand),
r as (select id, lower(id) as hay, '|' || regexp_replace(lower(id), '[^0-9a-z]', '|', 'g') || '|' as pad from r10_truth where {READY})
select id, arg_max(k, length(k)) as audited from r join cp on contains(hay, k) and contains(r.pad, cp.pad) group by id""",
)
def _(t):
    return D.suspect_embedded(ready(t), audit(t))


@query(
    "j10_suspect_version",
    f"""with tw as (select {_S("lower(trim(name))")} as st, arg_min(name, id) as twin from r10_truth where delivered group by 1)
select id, twin from r10_truth join tw on tw.st = {_S("lower(trim(name))")} where {READY} and lower(trim(name)) <> lower(trim(twin))""",
)
def _(t):
    by_name = t.r10_truth.where("delivered").select("id", F.lit(D.BY_NAME).alias("method"))
    return D.suspect_version(ready(t), t.r10_truth, by_name)


_CHECKED = f"""with bh as (select sha256 as h, max(pos) as pos from r11_folders group by 1), bt as (select substr(sha256, 1, 12) as h, min(pos) as pos from r11_folders group by 1), bf as (select folder as h, min(pos) as pos from r11_folders group by 1),
k as (select m.pos, m.batch, m.source_uri, m.folder, m.object_hash, coalesce(h1.pos, h2.pos, h3.pos, case when length(split_part(batch_id, '-', 2)) = 12 then bt.pos end) as hit, bf.pos as fpos from r16_manifest m left join bh h1 on h1.h = m.sha256
  left join bh h2 on h2.h = m.object_hash left join bh h3 on h3.h = replace(m.original_filename, '.zip', '') left join bt on bt.h = split_part(batch_id, '-', 2) left join bf on bf.h = m.folder),
ls as (select name as uri, split_part(name, '/', 6) as folder, regexp_extract(name, '([0-9a-f]{{64}})', 1) as h from r17_listing),
checked as (select k.pos, k.batch, case when hit is not null then 'hash' when fpos is not null then 'folder' else 'absent' end as bucket_state, f.outcome as bucket_outcome, f.cohort_label as bucket_cohort,
  case when k.source_uri in (select uri from ls) then 'object' when (k.folder, k.object_hash) in (select (folder, h) from ls) then 'moved' when k.folder in (select folder from ls) then 'repackaged' else 'absent' end as live_state
  from k left join r11_folders f on f.pos = coalesce(hit, fpos))"""


def checked(t):
    seen = D.bucket_check(t.r16_manifest, t.r11_folders)
    none = t.r16_manifest.select("name", F.lit(None).cast("string").alias("state"), F.lit(None).cast("date").alias("checked_on"))
    return D.live_check(seen, t.r17_listing, none, F.lit("2024-02-01").cast("date"))


@query("j11_bucket_check", f"{_CHECKED} select pos, bucket_state, bucket_outcome, bucket_cohort from checked")
def _(t):
    return D.bucket_check(t.r16_manifest, t.r11_folders).select("pos", "bucket_state", "bucket_outcome", "bucket_cohort")


@query("j12_live_check", f"{_CHECKED} select pos, live_state, date '2024-02-01' as live_checked_on from checked")
def _(t):
    return checked(t).select("pos", "live_state", "live_checked_on")


@query(
    "a48_manifest_counts",
    f"""{_CHECKED} select case when grouping(batch) = 1 then 'All' else coalesce(batch, '(not recorded)') end as batch, count(*) as tasks, count(*) filter (where bucket_state = 'hash') as verified, count(*) filter (where bucket_state = 'folder') as repackaged,
  count(*) filter (where bucket_state = 'absent') as absent, count(*) filter (where live_state in ('object', 'moved')) as live_confirmed, count(*) filter (where live_state in ('absent', 'repackaged')) as live_missing
from (select * replace (case when pos % 7 > 0 then batch end as batch) from checked) group by rollup (batch)""",
)
def _(t):
    # Some batches are not recorded.
    return D.manifest_counts(checked(t).withColumn("batch", F.when(c("pos") % 7 > 0, c("batch"))))


_FOLD = f"""with sp as (select distinct {X.key("folder")} as fk, unnest([k for k in [{X.key("folder")}, {X.key("declared_short")}, {X.key("declared_name")}, {X.norm("folder")}, {X.norm("declared_short")}, {X.norm("declared_name")}] if k <> '']) as key from r18_scans),
f as (select * from sp union select fk, unnest([fk, {X.stem("fk")}]) from (select {X.key("folder")} as fk from r19_accepted) where fk not in (select fk from sp)),
tl as (select *, regexp_replace({X.key("id")}, '^[^:]*:', '') as tail from r10_truth),
v as (select id, state, decided, runs, owner, unnest(list_distinct([{X.key("name")}, {X.norm("name")}, tail, regexp_replace(tail, '-[0-9a-f]{{6,}}$', '')])) as key from tl),
p as (select distinct f.fk, v.id, v.state, v.decided, v.runs, v.owner from f join v using (key)),
b as (select *, row_number() over (partition by fk order by decided desc nulls last, runs desc, id desc) as rn from p),
g as (select fk, count(*) as verdicts, array_to_string(list_sort(list(distinct state)), ',') as states from p group by 1),
s as (select folder as fk, batch, connector, row_number() over (partition by folder order by pos desc) as rn from r16_manifest where prefix = 'iteration_2'),
w as (select {X.key("folder")} as fk, is_connector, array_to_string(list_sort(connector_services), ',') as services, row_number() over (partition by {X.key("folder")} order by pos desc) as rn from r18_scans),
rd as (select package_id, case when toml like '%mcp_servers = []%' or toml not like '%mcp_servers%' then false when toml like '%# mcp_servers to come%' then null else true end as connector,
  case when toml like '%[[environment.mcp_servers]]%' then 'a [[mcp_servers]] table with entries' when toml like '%mcp_servers = ["%' then 'a non-empty mcp_servers list' when toml like '%mcp_servers = []%' then 'mcp_servers declared and empty'
    when toml not like '%mcp_servers%' then 'task.toml declares no mcp_servers at all' end as basis from r7_package_text),
folded as (select x.folder, regexp_matches(x.folder, '^(task\\d*|tasks?|harbor-single-task-\\S*|autorun-\\S*|content-[0-9a-f]{{16,}}|code-c\\d+|g\\d+_\\S*)$') as placeholder_name,
  coalesce(w.is_connector, s.connector, rd.connector) as connector, case when w.is_connector is not null then 'the folder’s own package' when s.connector is not null then 'the delivery manifest that packaged it'
    when rd.connector is not null then 'its task.toml, read directly (' || basis || ')' end as connector_via, coalesce(services, '') as services,
  coalesce(verdicts, 0) as verdicts, b.state, b.decided, b.owner, coalesce(states, '') as states, s.fk is not null as delivered, s.batch
  from (select *, {X.key("folder")} as fk from r19_accepted) x left join g on g.fk = x.fk left join b on b.fk = x.fk and b.rn = 1 left join s on s.fk = x.fk and s.rn = 1 left join w on w.fk = x.fk and w.rn = 1 left join rd using (package_id))"""


def folded(t):
    facts = package_facts(t.r7_package_text.select("package_id", "toml", "dockerfile"), "package_id")
    reads = t.r19_accepted.join(facts, "package_id").select("folder", "connector", "basis")
    sent = t.r16_manifest.where("prefix = 'iteration_2'")
    return D.cohort_fold(t.r19_accepted.select("folder"), t.r18_scans, t.r10_truth, sent, reads)


@query("j13_cohort_fold", f"{_FOLD} select * from folded")
def _(t):
    return folded(t).withColumn("states", F.array_join("states", ",")).withColumn("services", F.array_join("services", ","))


@query(
    "a14_cohort_counts",
    f"""{_FOLD} select count(*) as packages, count(state) as decided, count(*) - count(state) as before_cut, count(*) filter (where state = 'accepted') as latest_accepted,
  count(*) filter (where state = 'legacy accepted') as latest_legacy_accepted, count(*) filter (where state = 'rejected') as latest_rejected,
  count(*) filter (where state not in ('accepted', 'legacy accepted', 'rejected')) as latest_other, count(*) filter (where states like '%,%') as disagree_across_runs,
  count(*) filter (where placeholder_name) as placeholder_names, count(*) filter (where delivered) as delivered, count(*) filter (where not delivered) as not_delivered, count(*) filter (where connector) as connector_tasks,
  count(*) filter (where not connector) as non_connector_tasks, count(*) filter (where connector is null) as connector_unknown, count(*) filter (where connector_via like 'the delivery%') as connector_from_manifest,
  count(*) filter (where connector_via like 'its task.toml%') as connector_from_package from folded""",
)
def _(t):
    return D.cohort_counts(folded(t))


@query(
    "j14_cohort_rows",
    f"""with v as (select id, name, owner, decided, runs, unnest(list_distinct([{X.key("name")}, {X.norm("name")}])) as key from r10_truth),
b as (select * from v qualify row_number() over (partition by key order by decided desc nulls last, runs desc, id) = 1)
select f.pos, coalesce(a.id, l.id, 'folder:' || folder) as id, coalesce(a.name, l.name, folder) as name, case when a.id is not null then a.owner else l.owner end as owner,
  case when a.id is not null then a.decided else l.decided end as decided, cast(coalesce(a.runs, l.runs, 0) as int) as runs, a.id is null and l.id is null as no_verdict
from r11_folders f left join b a on a.key = {X.key("f.folder")} left join b l on l.key = {X.norm("f.folder")}""",
)
def _(t):
    return D.cohort_rows(t.r11_folders, t.r10_truth).select("pos", "id", "name", "owner", "decided", "runs", "no_verdict")


_DUP = "with n as (select package_task, count(*) as n from r11_folders where package_task is not null group by 1), d as (select f.*, coalesce(n > 1, false) as dup, n from r11_folders f left join n using (package_task))"


@query("j16_duplicate_folders", f"{_DUP} select pos, case when dup then n - 1 else 0 end as duplicate_siblings, dup as possible_duplicate, case when dup then 'confirmed' else '' end as duplicate_tier from d")
def _(t):
    return D.duplicate_folders(t.r11_folders).select("pos", "duplicate_siblings", "possible_duplicate", "duplicate_tier")


@query(
    "j15_carry_duplicates",
    f"""{_DUP}, fk as (select pos, package_task, n - 1 as siblings, unnest(list_distinct([{X.key("folder")}, {X.norm("folder")}, {X.key("package_task")}])) as key from d where dup),
rk as (select id, unnest(list_distinct([{X.key("name")}, {X.norm("name")}, {X.key("regexp_replace(id, '^(task|family|folder):', '')")}])) as key from r10_truth)
select id, arg_min(package_task, pos) as package_task, arg_min(siblings, pos) as duplicate_siblings from rk join fk using (key) group by id""",
)
def _(t):
    return D.carry_duplicates(t.r10_truth, D.duplicate_folders(t.r11_folders))


_DELIV = f"""dl as (select pos, task, package_name, batch, type, difficulty, batch like 'CompanyBench%' as audited, case when source_uri like 'gs://bucket/%' then split_part(source_uri, '/', 5) end as source_prefix,
  case when source_uri like 'gs://bucket/%' then split_part(source_uri, '/', 6) end as source_folder, case when source_uri like 'gs://bucket/%' then 'pipeline' when source_uri is not null then 'elsewhere' end as source_kind from r3_deliveries),
ex as (select pos, {X.key("source_folder")} as key from dl where source_prefix = 'iteration_2'), nm as (select pos, {X.key("task")} as key from dl union select pos, {X.key("package_name")} from dl where package_name is not null),
fo as (select pos, folder, {X.key("folder")} as fk, {X.key("package_task")} as pk, pos % 10 = 0 as index_delivered from r11_folders)"""


def deliveries(t):
    ref = K.source_ref(c("source_uri"), F.lit(None).cast("string"), F.lit(None).cast("string"), "bucket")
    return t.r3_deliveries.withColumn("r", ref).select(
        "pos", "task", "package_name", "batch", "type", "difficulty", c("batch").startswith("CompanyBench").alias("audited"),
        c("r.prefix").alias("source_prefix"), c("r.folder").alias("source_folder"), c("r.kind").alias("source_kind"),
    )


def accepted_folders(t):
    return t.r11_folders.select("pos", "folder", "package_task", F.expr("pos % 10 = 0").alias("index_delivered"))


def gone_packages(t):
    return deliveries(t).where("audited and difficulty is null").select("batch", N.name_key(c("task")).alias("key"))


_TRACE_FOLDERS = f"""with {_DELIV}, h as (select fo.pos, 0 as n, min(ex.pos) as d from fo join ex on ex.key = fo.fk group by 1 union all select fo.pos, 1, min(nm.pos) from fo join nm on nm.key = fo.fk group by 1
  union all select fo.pos, 2, min(nm.pos) from fo join nm on nm.key = fo.pk group by 1),
hit as (select * from h qualify row_number() over (partition by pos order by n) = 1),
traced as (select fo.pos, fo.folder, r.package_task, case when index_delivered then 'manifest' when n = 0 then 'folder' when n > 0 then 'name' end as delivered_by, dl.batch as delivered_batch,
  case dl.type when 'Connector' then true when 'Non-connector' then false end as delivered_type from fo join r11_folders r using (pos) left join hit on hit.pos = fo.pos left join dl on dl.pos = hit.d)"""


@query("j17_trace_folders", f"{_TRACE_FOLDERS} select pos, delivered_by is not null as delivered, delivered_by, delivered_batch, delivered_type from traced")
def _(t):
    return D.trace_folders(accepted_folders(t), deliveries(t), "iteration_2").drop("folder", "package_task", "index_delivered")


_TRACE = f"""with {_DELIV}, r as (select ex.pos, fo.pos as f from ex join fo on fo.fk = ex.key union all select nm.pos, fo.pos from nm join fo on fo.fk = nm.key union all select nm.pos, fo.pos from nm join fo on fo.pk = nm.key),
b as (select pos, min(f) as f from r group by 1), gone as (select distinct batch, {X.key("task")} as k from dl where audited and difficulty is null),
x as (select dl.*, b.f, fo.folder, case when audited then (dl.batch, {X.key("task")}) not in (select (batch, k) from gone) else b.f is not null end as found from dl left join b on b.pos = dl.pos left join fo on fo.pos = b.f),
traced as (select pos, batch, task, found, folder, case when found then null when audited then 'gone' when source_prefix = 'iteration_2' and {X.key("source_folder")} not in (select fk from fo) then 'gone'
  when source_kind = 'elsewhere' then 'elsewhere' else 'unnamed' end as reason from x)"""


def traced(t):
    return D.trace_deliveries(accepted_folders(t), deliveries(t), "iteration_2", gone_packages(t))


@query("j17_trace_deliveries", f"{_TRACE} select * from traced")
def _(t):
    return traced(t)


@query(
    "a15_delivery_join_counts",
    f"""{_TRACE} select count(*) as delivered, count(*) filter (where found) as found, count(*) filter (where not found) as missing, count(*) filter (where reason = 'gone') as gone,
  count(*) filter (where reason = 'elsewhere') as elsewhere, count(*) filter (where reason = 'unnamed') as unnamed, count(distinct batch) as batches from traced""",
)
def _(t):
    return D.trace_counts(traced(t))


@query(
    "a16_cohort_split",
    f"""{_TRACE_FOLDERS}, named as (select distinct package_task from traced where delivered_by <> 'name')
select count(*) as packages, count(delivered_by) as delivered, count(*) - count(delivered_by) as not_delivered, count(*) filter (where delivered_by <> 'name') as by_manifest,
  count(*) filter (where delivered_by = 'name') as by_name, count(*) filter (where delivered_by = 'name' and package_task in (select package_task from named where package_task is not null)) as copies from traced""",
)
def _(t):
    return D.cohort_split(D.trace_folders(accepted_folders(t), deliveries(t), "iteration_2"))


@query(
    "j18_mark_rows_delivered",
    f"""with {_DELIV}, ks as (select pos, task, batch, {X.key("task")} as key from dl where not audited union all select pos, task, batch, {X.key("package_name")} from dl where not audited and package_name is not null
  union all select pos, task, batch, {X.key("source_folder")} from dl where not audited and source_prefix = 'iteration_2'), b as (select key, min(pos) as pos from ks group by 1),
j as (select t.id, t.delivered, t.delivered_task, not delivered and not maybe_delivered as open, coalesce(b1.pos, b2.pos) as pos from r10_truth t left join b b1 on b1.key = {X.key("t.name")} left join b b2 on b2.key = {X.key("t.package_task")})
select j.id, j.delivered or (open and dl.pos is not null) as delivered, case when open and dl.pos is not null then dl.task else j.delivered_task end as delivered_task,
  case when open and dl.pos is not null then dl.batch || ': the task name it carries' end as delivered_via from j left join dl on dl.pos = j.pos""",
)
def _(t):
    return D.mark_rows_delivered(t.r10_truth, deliveries(t), "iteration_2")


# ------------------------------------------------------------ shared look-ups
@query(
    "j31_agreed_lookup",
    f"""with d as (select {X.bkey("task")} as k, bench as v from r3_deliveries union all select {X.bkey("package_name")}, bench from r3_deliveries where package_name is not null),
b as (select {X.bkey("name")} as k, bench_side as v from r10_truth where bench_side is not null), da as (select k, case when min(v) = max(v) then min(v) end as v from d group by 1), ba as (select k, case when min(v) = max(v) then min(v) end as v from b group by 1)
select l.src_row, coalesce(da.v, ba.v) as looked_up from r4_ledger l left join da on da.k = {X.bkey("l.task")} left join ba on ba.k = {X.bkey("l.task")}""",
)
def _(t):
    delivered = J.agreed(J.name_pairs(t.r3_deliveries, c("bench"), "task", "package_name"))
    built = J.agreed(J.name_pairs(t.r10_truth, c("bench_side"), "name"))
    return J.lookup_by_priority(t.r4_ledger, "src_row", ["task"], [delivered, built], "looked_up").select("src_row", "looked_up")


@query(
    "j32_bench_of_row",
    f"""with dk as (select k, case when min(v) = max(v) then min(v) end as v from (select {X.bkey("task")} as k, family as v from r3_deliveries where bench = 'computer' and family in ('real-aster', 'real-zeta', 'real', 'synthetic')
   union all select {X.bkey("package_name")}, family from r3_deliveries where bench = 'computer' and family in ('real-aster', 'real-zeta', 'real', 'synthetic') and package_name is not null) group by 1),
db as (select k, case when min(v) = max(v) then min(v) end as v from (select {X.bkey("task")} as k, bench as v from r3_deliveries where family is not null union all select {X.bkey("package_name")}, bench from r3_deliveries where family is not null and package_name is not null) group by 1),
b as (select {X.bkey("name")} as k, case when min(bench_side) = max(bench_side) then min(bench_side) end as v from r10_truth where bench_side is not null group by 1),
x as (select t.id, t.bench, t.bench_side, t.delivered, t.services, coalesce(k1.v, k2.v, k3.v) as kind, db1.v as sent, db2.v as dname, b.v as bname from r10_truth t left join dk k1 on k1.k = {X.bkey("t.delivered_task")} left join dk k2 on k2.k = {X.bkey("t.package_task")}
  left join dk k3 on k3.k = {X.bkey("t.name")} left join db db1 on db1.k = {X.bkey("t.delivered_task")} left join db db2 on db2.k = {X.bkey("t.name")} left join b on b.k = {X.bkey("t.name")}),
i as (select *, case when bench in ('company bench aster', 'company bench zeta') then 'company' when bench in ('computer bench synth', 'computer bench real') then case when list_contains(services, 'zeta3-sql-gym') then 'company' else 'computer' end end as image from x)
select id, case when kind <> 'synthetic' then 'computer' else coalesce(image, case when delivered then sent end, bench_side, dname, bname) end as bench_of_row from i""",
)
def _(t):
    from taskweave.operators.segments import bench_of_rows

    return bench_of_rows(t.r10_truth, t.r3_deliveries).select("id", "bench_of_row")


@query(
    "j33_package_images",
    """with r as (select lower(task) as key, 'reg/' || case o_custkey % 3 when 0 then 'aster:' when 1 then 'real-data:' else 'python:' end || cast(o_orderkey % 3 as string) as image, o_custkey % 3 as f
  from (select o_custkey, o_orderkey, 'task-' || cast(case when o_custkey % 2 = 0 then o_custkey else o_custkey % 40 end as string) as task from orders))
select key, count(distinct image) as images, case when count(distinct f) = 1 then min(image) end as image from r group by 1""",
)
def _(t):
    name = F.expr("'task-' || cast(case when o_custkey % 2 = 0 then o_custkey else o_custkey % 40 end as string)")
    image = F.expr("'reg/' || case o_custkey % 3 when 0 then 'aster:' when 1 then 'real-data:' else 'python:' end || cast(o_orderkey % 3 as string)")
    readings = t.orders.select(N.bench_key(name).alias("key"), image.alias("image"))
    return J.package_images(readings.withColumn("family", K.family_of_image(c("image"))))


_IMAGE = "'reg/' || case {0} when 0 then 'aster:' when 1 then 'real-data:' when 2 then 'connectors-rl-gym/x:' else 'python:' end || cast(pos % 5 as string)"
IMAGES_READ = f"""d as (select pos, batch, lower(list_last(string_split(package_path, '/'))) as zip, substr(sha256, 1, 12) as archive, task, package_name from r3_deliveries),
cp as (select batch, zip, min(case when pos % 11 = 0 then {_IMAGE.format("pos % 4")} end) as delivered, min(case when pos % 11 = 1 then {_IMAGE.format("pos % 4")} end) as earlier from d where pos % 11 < 2 group by 1, 2),
ar as (select archive, min({_IMAGE.format("pos % 4")}) as archived from d where pos % 13 = 0 group by 1),
rd as (select {X.bkey("task")} as key, min({_IMAGE.format("pos // 11 % 4")}) as image, min(pos // 11 % 4) as lo, max(pos // 11 % 4) as hi from d where pos % 7 = 0 group by 1),
ks as (select pos, {X.bkey("task")} as key from d union select pos, {X.bkey("package_name")} from d where package_name is not null),
sc as (select pos, min(image) as scanned, min(lo) as lo, max(hi) as hi from ks join rd using (key) group by 1),
im as (select d.pos, case when delivered is not null then delivered when archived is not null then archived when lo = hi then scanned else earlier end as image,
  case when delivered is not null then 'the image in the package (delivered zip on Drive)' when archived is not null then 'the image in the package (the archive the manifest names)' when lo = hi then 'the image in the package'
    when earlier is not null then 'the image in the package (earlier copy on Drive)' when scanned is not null then 'package versions disagree' end as read_from
  from d left join cp using (batch, zip) left join ar using (archive) left join sc on sc.pos = d.pos)"""


def images_read(t):
    """(pos, image, read_from) of each delivered package."""
    image = lambda which: F.expr(_IMAGE.format(which))
    d = t.r3_deliveries.select("pos", "batch", F.substring_index("package_path", "/", -1).alias("zip"), F.substring("sha256", 1, 12).alias("archive"), "task", "package_name")
    copies = d.where("pos % 11 < 2").select("batch", "zip", image("pos % 4").alias("image"), F.when(c("pos") % 11 == 0, J.DELIVERED_ZIP).otherwise("earlier copy").alias("read_from"))
    archives = d.where("pos % 13 = 0").select("archive", image("pos % 4").alias("image"))
    readings = d.where("pos % 7 = 0").select(N.bench_key(c("task")).alias("key"), image("floor(pos / 11) % 4").alias("image"))
    return J.image_of_packages(d, ["task", "package_name"], copies, archives, readings.withColumn("family", K.family_of_image(c("image"))))


@query("j33_image_of_packages", f"with {IMAGES_READ} select * from im")
def _(t):
    return images_read(t)


@query(
    "j34_glm_trials_join",
    """with rp as (select distinct 'auto-' || cast(l_orderkey as string) as batch, 'task-' || cast(l_partkey % 20 as string) as task from lineitem),
rw as (select 'auto-' || cast(l_orderkey as string) as batch, 'task-' || cast(l_partkey % 20 as string) as task, count(*) as trials, count(*) filter (where l_returnflag = 'A') as passes from lineitem where l_linestatus = 'F' group by 1, 2),
t as (select o_orderkey as id, 'auto-' || cast(o_orderkey as string) as batch, 'task-' || cast(o_custkey % 20 as string) as name from orders), n as (select batch, count(*) as n, min(task) as only from rp group by 1),
j as (select t.id, t.batch, n.n, case when rp.task is not null then t.name when n.n = 1 then n.only end as chosen from t left join n using (batch) left join rp on rp.batch = t.batch and rp.task = t.name)
select id, chosen, trials, passes, case when n is null then 'no gate report for this batch' when chosen is null then 'the batch holds several tasks and none matches this name' when trials is null then 'the gate report records no GLM trials'
  else 'read from the trial files' end as reason from j left join rw on rw.batch = j.batch and rw.task = j.chosen""",
)
def _(t):
    batch, task = F.concat(F.lit("auto-"), c("l_orderkey").cast("string")), F.concat(F.lit("task-"), (c("l_partkey") % 20).cast("string"))
    reports = t.lineitem.select(batch.alias("batch"), task.alias("task")).distinct()
    rewards = (
        t.lineitem.where("l_linestatus = 'F'").groupBy(batch.alias("batch"), task.alias("task"))
        .agg(F.count("*").alias("trials"), F.count_if(c("l_returnflag") == "A").alias("passes"))
    )
    rows = t.orders.select(
        c("o_orderkey").alias("id"), F.concat(F.lit("auto-"), c("o_orderkey").cast("string")).alias("batch"), F.concat(F.lit("task-"), (c("o_custkey") % 20).cast("string")).alias("name")
    )
    return J.trials_join(rows, reports, rewards).select("id", "chosen", "trials", "passes", "reason")


@query(
    "j35_glm53_lookup",
    f"""with sc as (select distinct {X.bkey("declared_short")} as key, length(declared_short) as value from r11_folders where declared_short is not null),
al as (select key, task from (select {X.bkey("folder")} as key, min({X.bkey("declared_short")}) as task, max({X.bkey("declared_short")}) as other from r11_folders where declared_short is not null and folder <> declared_short group by 1) where task = other and key not in (select key from sc)),
tb as (select key, value from sc union all select al.key, sc.value from al join sc on sc.key = al.task),
p as (select id, 0 as n, {X.bkey("name")} as k from r10_truth union all select id, 1, {X.bkey("package_task")} from r10_truth union all select id, 2, {X.bkey("delivered_task")} from r10_truth union all select id, 3, {X.bkey("cohort_folder")} from r10_truth),
q as (select id, n * 3 as n, k from p union all select id, n * 3 + 1, regexp_replace(k, '(-v\\d+)+$', '') from p union all select id, n * 3 + 2, regexp_replace(k, '(-for-qc(-v\\d+)?|-v\\d+)+$', '') from p),
h as (select id, arg_min(value, n) as score from q join tb on tb.key = q.k group by 1) select t.id, h.score from r10_truth t left join h using (id)""",
)
def _(t):
    f = t.r11_folders.where("declared_short is not null").select(N.bench_key(c("declared_short")).alias("task"), N.bench_key(c("folder")).alias("package_key"), F.length("declared_short").cast("bigint").alias("value"))
    scores = f.groupBy(c("task").alias("key")).agg(F.min("value").alias("value"))
    names = ["name", "package_task", "delivered_task", "cohort_folder"]
    return J.score_lookup(t.r10_truth, "id", names, scores, J.package_aliases(f)).select("id", "score")


@query(
    "j39_merge_snapshot",
    """with both_ as (select user_id as key, event_type as answer, event_id as version from events where event_type <> 'error' union all select user_id, 'reread', event_id + 1000000 from events where event_type = 'error')
select key, arg_max(answer, version) as answer, max(version) as version from both_ group by 1""",
)
def _(t):
    e = t.events
    old = e.where("event_type <> 'error'").select(c("user_id").alias("key"), c("event_type").alias("answer"), c("event_id").alias("version"))
    new = e.where("event_type = 'error'").select(c("user_id").alias("key"), F.lit("reread").alias("answer"), (c("event_id") + 1000000).alias("version"))
    return J.merge_snapshot(old, new, "version")


@query(
    "j39_work_left",
    """with known as (select distinct o_custkey as key from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'), miss as (select o_custkey as key, max(cast(o_orderdate as date)) as checked_on from orders where o_orderstatus = 'P' group by 1)
select c_custkey as key from customer where c_custkey not in (select key from known) and c_custkey not in (select key from miss where date_diff('day', checked_on, date '1998-08-01') < 200)""",
)
def _(t):
    known = t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("key")).distinct()
    misses = t.orders.where("o_orderstatus = 'P'").groupBy(c("o_custkey").alias("key")).agg(F.max(F.to_date("o_orderdate")).alias("checked_on"))
    return J.work_left(t.customer.select(c("c_custkey").alias("key")), known, misses, F.lit("1998-08-01").cast("date"), 200)
