"""Sources, sinks, streams and SQL functions, run over the driver tables.

Sources read files that Spark wrote from the tables; sinks return what a
reader finds after the write.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions.register import register_rules
from taskweave.operators import quality as Q
from taskweave.plans import fragments as X
from taskweave.plans.delivered import IMAGES_READ, images_read
from taskweave.plans.packages import BENCH
from taskweave.plans.readmodel import _SELECT, _counts, delivery_rows, excluded, manifest_rows
from taskweave.plans.registry import query
from taskweave.session import output_path
from taskweave.sinks import exports as E
from taskweave.sinks import handover as H
from taskweave.sinks import publish as P
from taskweave.sources import listings as L
from taskweave.sources import manifests as M
from taskweave.sources import records as R
from taskweave.sources import tables as T
from taskweave.sources.refresh import refresh_verdicts
from taskweave.streaming import jobs as J

c = F.col
SCHEMA_NAME = "verdict/v2"


# --------------------------------------------------------------------- verdicts
def verdict_files(t):
    """Envelopes of one verdict per event: no task, one task or two; some cut short."""
    each = F.transform(
        F.sequence(F.lit(1), c("n")),
        lambda i: F.struct(
            F.concat(F.lit("task-"), c("event_id").cast("string"), F.lit("-"), i.cast("string")).alias("task"),
            F.when(i == 1, "accepted").otherwise("rejected").alias("decision"),
            F.array(F.struct(F.lit("HARBOR-CHECK-3").alias("code")), F.struct(F.lit(None).cast("string").alias("code"))).alias("findings"),
            F.when(i == 1, F.lit(7)).alias("blocking_findings"),
        ),
    )
    e = t.events.withColumn("n", F.expr("cast(event_id % 3 as int)"))
    body = F.to_json(
        F.struct(
            F.when(F.expr("event_id % 50 = 0"), "verdict/v1").otherwise(SCHEMA_NAME).alias("schema"),
            c("event_type").alias("state"),
            F.when(F.expr("event_id % 5 > 0"), c("ts").cast("string")).alias("decided_at"),
            c("ts").cast("string").alias("updated_at"),
            F.concat(F.lit("U"), c("user_id").cast("string"), F.lit("@x.com")).alias("owner"),
            F.when(c("n") > 0, each).alias("tasks"),
            F.when(F.expr("event_id % 9 = 0"), "GLM-5.2 calibration").alias("note"),
        )
    )
    cut = F.when(F.expr("event_id % 101 = 0"), F.substring(body, 1, 25)).otherwise(body)
    name = F.concat(F.lit("_v/"), c("event_id").cast("string"), F.lit(".json"))
    path = output_path(t.spark, "verdicts")
    e.select(F.to_json(F.struct(name.alias("name"), F.lit("2024-02-01").alias("updated"), cut.alias("body")))).write.text(path)
    return path


_DOCS = "d as (select *, event_id % 3 as n from events where event_id % 101 <> 0)"


_VERDICTS = f"""with {_DOCS}, x as (select *, unnest(case when n = 0 then [0] else range(1, n + 1) end) as i from d)
select '_v/' || cast(event_id as string) || '.json' as source, cast(event_id as string) as submission, cast(greatest(i - 1, 0) as int) as task_pos, event_type as state, event_id % 5 = 0 as decided_inferred, 'u' || cast(user_id as string) || '@x.com' as owner,
  case when n > 0 then 'task-' || cast(event_id as string) || '-' || cast(i as string) end as task_name, case when n = 0 then '' when i = 1 then 'accepted' else 'rejected' end as decision, n > 0 as per_task_decision,
  case when n = 0 then '' else 'HARBOR-CHECK-3' end as codes, case when i = 1 then cast(7 as bigint) end as blocking_findings, event_id % 9 = 0 as glm52, cast(ts as date) as updated_on from x"""


@query("s01_read_verdicts", _VERDICTS)
def _(t):
    return verdict_columns(R.verdict_rows(R.read_envelopes(t.spark, verdict_files(t))))


@query("s01_refresh_verdicts", _VERDICTS)
def _(t):
    """Three runs: the first purchases and views, then everything with some of the documents changed, then nothing new."""
    docs = R.read_envelopes(t.spark, verdict_files(t))
    root = output_path(t.spark, "verdict-rows")
    early = F.col("body").contains('"purchase"') | F.col("body").contains('"view"')
    before = docs.where(early).withColumn("updated", F.when(F.length("name") % 2 == 0, F.lit("2024-01-01")).otherwise(c("updated")))
    for listed in (before, docs, docs):
        refresh_verdicts(listed, lambda changed, d=listed: d.join(changed.select("name"), "name", "left_semi"), root)
    return verdict_columns(P.read_published(t.spark, root))


def verdict_columns(rows):
    return rows.select(
        "source", "submission", "task_pos", "state", "decided_inferred", "owner", "task_name", "decision", "per_task_decision",
        F.array_join("finding_codes", "|").alias("codes"), "blocking_findings", c("gate.glm52").alias("glm52"), F.to_date("updated_at").alias("updated_on"),
    )


@query(
    "s02_ingest_coverage",
    f"""with {_DOCS}, a as (select count(*) as objects_listed, (select count(*) from d) as objects_read, count(*) - (select count(*) from d) as objects_failed, (select count(*) from d where event_id % 50 = 0) as unexpected_schema,
  (select cast(sum(greatest(n, 1)) as bigint) from d) as rows, (select cast(sum(n) as bigint) from d) as rows_with_decision, (select count(*) from d where n = 0) as rows_without_decision from events)
unpivot a on objects_listed, objects_read, objects_failed, unexpected_schema, rows, rows_with_decision, rows_without_decision into name measure value value""",
)
def _(t):
    return R.ingest_coverage(R.read_envelopes(t.spark, verdict_files(t)), SCHEMA_NAME)


# --------------------------------------------------------------------- listings
@query(
    "s03_read_object_listing",
    """with p as (select name, string_split(name, '/') as s from r2_objects) select name, s[2] as cohort, case when len(s) > 3 then s[3] end as folder, case when len(s) > 3 then array_to_string(s[4:], '/') end as tail,
  len(s) > 3 and name like '%.zip' as is_zip, len(s) <= 3 as is_sentinel from p""",
)
def _(t):
    path = output_path(t.spark, "listing")
    t.r2_objects.select("name").write.text(path)
    return L.read_object_listing(L.read_listing_text(t.spark, path))


@query("s04_folders_from_listing", "select distinct split_part(name, '/', 3) as folder from r2_objects where name like 'tasks/iteration_2/%/%'")
def _(t):
    return L.folders_from_listing(t.r2_objects, "iteration_2")


@query(
    "s05_canonical_archives",
    """with z as (select split_part(name, '/', 2) as cohort, split_part(name, '/', 3) as folder, regexp_replace(split_part(name, '/', 4), '\\.zip$', '') as sha, size_bytes, updated from r2_objects where name like '%.zip' and name not like '%/review_handoff/%')
select cohort, folder, count(*) over (partition by cohort, folder) as archives, sha, size_bytes, updated from z qualify row_number() over (partition by cohort, folder order by updated desc, sha desc) = 1""",
)
def _(t):
    return L.canonical_archives(t.r2_objects)


# -------------------------------------------------------------------- manifests
@query(
    "s06_read_batch_manifests",
    """select batch, name, prefix, folder, case when pos % 3 = 0 then connector else pos % 4 = 1 or pos % 5 = 2 end as connector, case when pos % 2 = 0 then 'Legal' else case when pos % 5 = 2 then 'connector' else 'finance' end end as category,
  case pos % 3 when 0 then 'pass' when 1 then 'fail' end as reported_qc, md5(cast(pos % 1000 as string)) || md5(cast(pos % 1000 + 1 as string)) as object_hash from r16_manifest where not (pos % 3 = 0 and connector is null)
union all select batch, name, prefix, folder, pos % 4 = 1 or pos % 5 = 2, case when pos % 2 = 0 then 'Legal' else case when pos % 5 = 2 then 'connector' else 'finance' end end, 'pass', md5(cast(pos % 1000 as string)) || md5(cast(pos % 1000 + 1 as string)) from r16_manifest where pos % 3 = 0 and connector is null""",
)
def _(t):
    task = F.struct(
        c("name").alias("task_name"), "task_id", "sha256", "source_uri", F.when(F.expr("pos % 3 = 0"), c("connector")).alias("is_connector"),
        F.when(F.expr("pos % 4 = 1"), "connector").alias("execution_type"), F.when(F.expr("pos % 5 = 2"), "connector").otherwise("finance").alias("category_normalized"),
        F.when(F.expr("pos % 2 = 0"), "Legal").otherwise("").alias("category"), F.when(F.expr("pos % 3 = 0"), "pass").alias("reported_qc"), F.when(F.expr("pos % 3 = 1"), "fail").alias("qc_status_reported"),
    )
    # A document lists at most a hundred tasks of its batch.
    docs = t.r16_manifest.groupBy("batch", F.expr("floor(pos / 100)").alias("part")).agg(F.collect_list(task).alias("tasks"))
    path = output_path(t.spark, "manifests")
    docs.select("batch", F.to_json(F.struct("tasks")).alias("value")).write.partitionBy("batch").text(path)
    return M.read_batch_manifests(t.spark, path).select("batch", "name", "prefix", "folder", "connector", "category", "reported_qc", "object_hash")


def drive_tasks(t):
    """Flat manifest tasks; two batches carry layouts that must be refused. The package's image comes with how it was read."""
    bad = F.expr("batch = 'Batch 4.1' and pos % 3 = 0")
    again = F.expr("batch = 'CompanyBench 6.1'")
    read = images_read(t).withColumnsRenamed({"image": "package_image", "read_from": "image_read_from"})
    return t.r3_deliveries.join(read, "pos").select(
        "batch", c("pos").alias("index"), F.when(again, F.concat(F.lit("pkg-"), (c("pos") % 50).cast("string"))).otherwise(c("package_name")).alias("task_id"),
        F.concat(F.lit("harbor/"), "task").alias("task_name"), "package_path", F.when(~bad, c("sha256")).alias("sha256"), "size_bytes", F.lower("difficulty").alias("difficulty"),
        c("glm").alias("successes"), F.when(F.expr("pos % 4 = 0"), F.lit(False)).alias("connector"),
        F.when(F.expr("pos % 3 = 0"), "synthetic set").when(F.expr("pos % 7 < 2"), "real set").otherwise("").alias("declared"),
        F.when(F.expr("pos % 6 = 1"), "reg/aster:1").alias("image"), "package_image", "image_read_from", "connectors", "source_uri",
    )


_CLASS = "case pos % 5 when 0 then 'Connector' when 1 then 'Non-Connector' when 2 then 'Non-Connector' when 3 then 'Synthetic' else 'Aster' end"
_DRIVE = f"""m as (select *, case when batch = 'CompanyBench 6.1' then 'pkg-' || cast(pos % 50 as string) else package_name end as tid, case when batch = 'Batch 4.1' and pos % 3 = 0 then null else sha256 end as sha_, {_CLASS} as klass from r3_deliveries),
p as (select batch, count(*) as n, count(*) filter (where sha_ is null) as lacking, min(pos) filter (where sha_ is null) as first_bad, count(coalesce(tid, 'pkg_' || cast(pos as string))) - count(distinct coalesce(tid, 'pkg_' || cast(pos as string))) as repeats from m group by 1)"""
_FAMILY = f"""{IMAGES_READ}, {_DRIVE}, ok as (select m.*, im.image, im.read_from, case when image like '%aster%' then 'real-aster' when image like '%rl-gym%' then 'synthetic' when image like '%real-data%' then 'real' end as own, pos % 3 > 0 and pos % 7 < 2 as real,
  case when read_from = 'package versions disagree' then 'the image in the package' else read_from end as how from m join p using (batch) join im using (pos) where lacking = 0 and repeats = 0),
g as (select *, case when pos % 6 = 1 then 0 when pos % 4 = 0 or klass = 'Non-Connector' then 1 when klass = 'Aster' then 2 when pos % 3 = 0 or klass = 'Synthetic' then 3 when own = 'real-aster' then 4 when own = 'synthetic' and not real then 5 when own = 'synthetic' then 6
  when real and list_contains(connectors, 'zeta3-sql-gym') then 7 when real and (list_contains(connectors, 'github-gym') or list_contains(connectors, 'linear') or list_contains(connectors, 'notion')) then 8 when real then 9 when image is not null and own is null then 10 else 11 end as rule from ok),
w as (select *, ['real-aster', 'non-connector', 'real-aster', 'synthetic', 'real-aster', 'synthetic', 'real', 'real-zeta', 'real-aster', 'real', 'non-connector', null][rule + 1] as fam,
  case when rule = 0 then 'the image the manifest records' when rule in (1, 2, 3, 9) then 'the manifest' when rule in (4, 5) then how when rule = 6 then 'the manifest says real, ' || how || ' is synthetic' when rule in (7, 8) then 'the connectors the manifest lists'
    when rule = 10 then 'the image in the package (no connector harness)' end as said from g),
f as (select *, case when read_from = 'package versions disagree' and coalesce(said, 'the manifest') = 'the manifest' then case when fam is null then 'not classified: the bucket holds versions of the task on different images' else 'the manifest; the bucket holds versions of the task on different images' end else said end as fam_from from w)"""


@query(
    "s07_manifest_problems",
    f"""with {_DRIVE} select batch, case when lacking > 0 then cast(lacking as string) || ' of ' || cast(n as string) || ' tasks lack a package_path, sha256 or size_bytes (first at index ' || cast(first_bad as string) || '); layout not recognised'
  else 'a package appears twice in the manifest' end as reason from p where lacking > 0 or repeats > 0""",
)
def _(t):
    return M.manifest_problems(drive_tasks(t))


@query(
    "s07_normalise_drive_manifest",
    f"""with {_FAMILY},
placed as (select *, case when fam = 'non-connector' then case when klass = 'Non-Connector' then case pos % 5 when 1 then 'Legal' else 'Engineering' end else case split_part(task, '-', 1) when 'code' then 'Engineering' when 'fin' then 'Finance' when 'law' then 'Legal' else 'Other' end end end as dom from f)
select case when batch like 'CompanyBench%' then 'CB' else 'B' end || regexp_replace(batch, '\\D', '', 'g') || '-' || case when pos < 100 then lpad(cast(pos as string), 3, '0') else cast(pos as string) end as id, task,
  case when coalesce(tid, 'pkg_' || cast(pos as string)) <> task then coalesce(tid, 'pkg_' || cast(pos as string)) end as package_name, batch, klass as class, fam as family, fam_from as family_from, dom as domain, case when fam = 'non-connector' then 'Non-connector' else 'Connector' end as type,
  case when fam like 'real%' then 'company' else 'computer' end as bench, case fam when 'real-aster' then 'aster' when 'real-zeta' then 'zeta' end as harness,
  case when fam = 'non-connector' then 'Non-Connector · ' || dom when fam like 'real%' then 'CompanyBench' when fam = 'synthetic' then 'Synthetic' else 'Connector · not classified' end as category,
  case when difficulty is not null then difficulty when pos % 5 = 0 then 'Harder' when pos % 5 in (1, 3) then 'Easier' when pos % 5 = 2 then 'Harder' end as difficulty, coalesce(cast(glm as string) || '/4', '(not recorded)') as score, substr(sha_, 1, 16) as sha, round(size_bytes / 1e6, 2) as size_mb from placed""",
)
def _(t):
    rows = M.normalise_manifest(drive_tasks(t), "bucket")
    return rows.select("id", "task", "package_name", "batch", "class", "family", "family_from", "domain", "type", "bench", "harness", "category", "difficulty", "score", "sha", "size_mb")


def zip_files(t):
    """Files found per batch: by package file, declared name or original name, or none."""
    name = F.expr("case pos % 4 when 0 then 'PKG_' || cast(pos as string) || '.zip' when 1 then task || '.zip' when 2 then 'original-' || cast(pos as string) || '.zip' else 'stray-' || cast(pos as string) || '.zip' end")
    return t.r3_deliveries.select("batch", name.alias("name"), c("bench").alias("path"))


def zip_tasks(t):
    return t.r3_deliveries.select(
        "batch", c("pos").alias("index"), "package_path", c("package_name").alias("task_id"), F.concat(F.lit("obi/"), "task").alias("task_name"),
        F.concat(F.lit("original-"), c("pos").cast("string"), F.lit(".zip")).alias("original_filename"),
    )


_LOCATE = """z as (select batch, lower(case pos % 4 when 0 then 'PKG_' || cast(pos as string) || '.zip' when 1 then task || '.zip' when 2 then 'original-' || cast(pos as string) || '.zip' else 'stray-' || cast(pos as string) || '.zip' end) as key, bench as path from r3_deliveries),
w as (select batch, key, max(path) as path from z group by 1, 2), k as (select distinct batch, pos, unnest([lower(list_last(string_split(package_path, '/'))), lower(package_name) || '.zip', lower(task) || '.zip', 'original-' || cast(pos as string) || '.zip']) as key from r3_deliveries),
h as (select k.batch, k.pos, arg_min(w.path, k.key) as location from k join w using (batch, key) group by 1, 2)"""


@query("j36_locate_packages", f"with {_LOCATE} select d.batch, d.pos as index, h.location from r3_deliveries d left join h using (batch, pos)")
def _(t):
    placed, left_out, _stray = M.locate_packages(zip_tasks(t), zip_files(t))
    return placed.select("batch", "index", "location").unionByName(left_out.select("batch", "index", F.lit(None).cast("string").alias("location")))


@query("j36_stray_files", f"with {_LOCATE} select batch, key from w where (batch, key) not in (select (batch, key) from k where key is not null)")
def _(t):
    return M.locate_packages(zip_tasks(t), zip_files(t))[2].select("batch", "key")


@query(
    "j37_batch_candidates",
    """with f as (select 'Batch ' || cast(c_custkey % 400 as string) as batch, 'folder ' || cast(c_custkey as string) || case when c_custkey % 1000 = 7 then ' dedup' else '' end as folder, case when c_custkey % 11 > 0 then cast(c_custkey % 200 as string) || case when c_nationkey = 3 then 'x' else '' end end as raw from customer),
g as (select batch, count(*) as n, count(*) filter (where folder like '%dedup%') as dd, min(folder) filter (where folder like '%dedup%') as df, count(distinct coalesce(raw, '?')) as v, bool_or(raw is null) as unread, arg_min(folder, length(folder) * 1000000 + cast(regexp_extract(folder, '[0-9]+', 0) as int)) as short from f group by 1)
select batch, case when n = 1 then 'only folder' when dd = 1 then 'the dedup copy is used' when v = 1 and not unread then 'identical manifest; read once' else 'different manifests; none published' end as decision,
  case when n = 1 then short when dd = 1 then df when v = 1 and not unread then short end as folder from g""",
)
def _(t):
    folders = t.customer.selectExpr(
        "'Batch ' || cast(c_custkey % 400 as string) as batch", "'folder ' || cast(c_custkey as string) || case when c_custkey % 1000 = 7 then ' dedup' else '' end as folder",
        "case when c_custkey % 11 > 0 then cast(c_custkey % 200 as string) || case when c_nationkey = 3 then 'x' else '' end end as raw",
    )
    return M.batch_candidates(folders)


# ------------------------------------------------------------- evaluation records
def _write_docs(t, name, body, df):
    path = output_path(t.spark, "documents")
    df.select(F.to_json(F.struct(name.alias("name"), F.lit("").alias("updated"), body.alias("body")))).write.text(path)
    return R.read_envelopes(t.spark, path)


@query(
    "s08_read_evaluation_cycles",
    """with x as (select *, unnest(range(0, o_orderkey % 3 + 1)) as i from orders) select 'run-' || cast(o_orderkey as string) || '-' || cast(i as string) as id, 'o' || cast(o_custkey as string) as owner_key, 'law-task-' || cast(o_orderkey % 9 as string) as task, 'u' || cast(o_custkey as string) || '@x.com' as trainer,
  case when i = 0 then 'Accepted' when i = 1 then 'Submitted' else 'Rejected' end as status, cast(i as bigint) as attempt, cast(o_orderdate as date) as submitted_on, 'Law' as category from x""",
)
def _(t):
    cycle = lambda i: F.struct(
        F.concat_ws("-", F.lit("run"), c("o_orderkey").cast("string"), i.cast("string")).alias("run_id"),
        F.concat(F.lit("law-task-"), (c("o_orderkey") % 9).cast("string")).alias("task_id"),
        F.when(i == 1, "done").otherwise("waiting_for_trainer_edit").alias("status"), i.alias("attempt"), c("o_orderdate").cast("string").alias("enqueued_at"),
        F.struct(F.when(i == 0, "ACCEPTED").alias("status"), F.concat(F.lit("U"), c("o_custkey").cast("string"), F.lit("@x.com")).alias("submitted_by")).alias("submission"),
    )
    cycles = F.transform(F.sequence(F.lit(0).cast("bigint"), c("o_orderkey") % 3), cycle)
    name = F.concat(F.lit("trainer/evaluations/o"), c("o_custkey").cast("string"), F.lit("/ledger.json"))
    docs = _write_docs(t, name, F.to_json(F.struct(cycles.alias("cycles"))), t.orders)
    return R.evaluation_cycles(docs).select("id", "owner_key", "task", "trainer", "status", "attempt", "submitted_on", "category")


@query(
    "s08_read_legacy_runs",
    """select 'run-' || cast(o_orderkey as string) as id, 'u' || cast(o_custkey as string) || '@x.com' as trainer, case when o_orderkey % 4 = 0 then 'Unknown' else 't-' || cast(o_orderkey as string) end as task,
  case o_orderstatus when 'F' then 'Failed' when 'P' then 'On Hold' else 'Queued' end as status, 'Unknown' as task_type, cast(o_orderdate as date) as submitted_on from orders where o_orderkey % 3 <> 1""",
)
def _(t):
    record = F.struct(
        F.when(F.expr("o_orderkey % 4 > 0"), F.concat(F.lit("t-"), c("o_orderkey").cast("string"))).alias("task_id"),
        F.expr("case o_orderstatus when 'F' then 'infrastructure_error' when 'P' then 'on_hold' else 'queued' end").alias("status"), c("o_orderdate").cast("string").alias("created_at"),
    )
    wrapper = F.struct(F.when(F.expr("o_orderkey % 3 = 1"), "note").otherwise("run").alias("kind"), F.concat(F.lit("run-"), c("o_orderkey").cast("string")).alias("object_name"), record.alias("record"))
    body = F.to_json(F.struct(F.concat(F.lit("U"), c("o_custkey").cast("string"), F.lit("@X.com")).alias("owner_email"), F.array(wrapper).alias("records")))
    return R.legacy_runs(_write_docs(t, c("o_orderkey").cast("string"), body, t.orders))


@query(
    "s09_read_trainer_records",
    """select 'doc-' || cast(c_custkey as string) as source, case when c_custkey % 3 = 0 then 'own-' || cast(c_custkey as string) else 'rec-' || cast(c_custkey as string) end as task, 'fam-' || cast(c_custkey as string) as family_id, lower(c_name) as trainer from customer where c_custkey % 3 = 0 or c_custkey % 5 > 0""",
)
def _(t):
    record = lambda name: F.struct(F.struct(name.alias("task_name"), F.concat(F.lit("fam-"), c("c_custkey").cast("string")).alias("family_id")).alias("record"))
    named = F.when(F.expr("c_custkey % 5 > 0"), F.concat(F.lit("rec-"), c("c_custkey").cast("string")))
    own = F.when(F.expr("c_custkey % 3 = 0"), F.concat(F.lit("own-"), c("c_custkey").cast("string")))
    body = F.to_json(F.struct(c("c_name").alias("owner_email"), own.alias("task_name"), F.array(record(F.lit("")), record(named)).alias("records")))
    return R.trainer_records(_write_docs(t, F.concat(F.lit("doc-"), c("c_custkey").cast("string")), body, t.customer))


# ------------------------------------------------------------------------ tables
@query("s10_read_reference_tables", "select batch, task, trainer, confidence from r15_reviews")
def _(t):
    path = output_path(t.spark, "reviews")
    t.r15_reviews.select("batch", "task", "trainer", "confidence").write.option("header", True).option("sep", "\t").csv(path)
    return T.read_reference_table(t.spark, path, ["batch", "task", "trainer", "confidence"])


@query("s10_repeated_keys", "select lower(task) as task, lower(email) as email, count(*) as n from r4_ledger group by 1, 2 having count(*) > 1")
def _(t):
    path = output_path(t.spark, "table")
    t.r4_ledger.select("task", "email").write.option("header", True).option("sep", "\t").csv(path)
    return T.repeated_keys(T.read_reference_table(t.spark, path, ["task", "email"]), ["task", "email"])


@query(
    "s11_read_workbook_tab",
    """select lower(email) as email, case when cj is not null then regexp_replace(cj, 'cj-', '') end as cj, requested_on, paid_tasks, cast(paid_amount + case when paid_tasks = 2 then 1 else 0 end as double) as paid_amount, paid_tasks <> 2 as priced from r5_requests""",
)
def _(t):
    path = output_path(t.spark, "tab")
    sheet = t.r5_requests.select(
        F.concat(F.lit(" "), F.upper("email"), F.lit(" ")).alias("email"), F.concat(F.replace("cj", F.lit("cj-"), F.lit("")), F.lit(".0")).alias("cj"),
        F.concat(c("requested_on").cast("string"), F.lit(" 00:00:00")).alias("requested_on"), F.concat(c("paid_tasks").cast("string"), F.lit(".0")).alias("tasks"),
        (c("paid_amount") + F.when(c("paid_tasks") == 2, 1).otherwise(0)).cast("string").alias("amount"),
    )
    sheet.write.option("header", True).csv(path)
    tab = T.read_reference_table(t.spark, path, ["email", "cj", "requested_on", "tasks", "amount"], sep=",")
    return T.payment_tab(tab).withColumn("paid_amount", c("paid_amount").cast("double"))


@query("s12_extract_embedded_json", "select o_orderkey as page, 'task-' || cast(o_orderkey % 50 as string) as task, 'Batch ' || cast(i as string) as batch from (select *, unnest(range(0, o_custkey % 3)) as i from orders)")
def _(t):
    each = F.transform(
        F.sequence(F.lit(1).cast("bigint"), c("o_custkey") % 3),
        lambda i: F.struct(F.concat(F.lit("task-"), (c("o_orderkey") % 50).cast("string")).alias("task"), F.concat(F.lit("Batch "), (i - 1).cast("string")).alias("batch"), F.lit("not kept").alias("secret")),
    )
    block = F.to_json(F.struct(F.when(F.expr("o_custkey % 3 > 0"), each).alias("rows"), F.lit(1).alias("summary")))
    html = F.concat(F.lit('<html><script>var a=1</script>\n<script id="data" type="application/json">'), block, F.lit("</script></html>"))
    return T.embedded_rows(t.orders.select(c("o_orderkey").alias("page"), html.alias("html")), "task:string, batch:string")


@query(
    "s14_scan_roll_up",
    """select 'Computer bench' as section, c_name as label, round(c_acctbal, 2) as value from customer where c_acctbal <> 0 union all select 'Company bench', c_mktsegment, cast(c_nationkey as double) from customer where c_nationkey <> 0""",
)
def _(t):
    sheet = t.customer.select(c("c_name").alias("c1"), F.round("c_acctbal", 2).cast("string").alias("c3"), c("c_mktsegment").alias("c13"), c("c_nationkey").cast("string").alias("c15"))
    return T.scan_roll_up(sheet, {"Computer bench": ("c1", "c3"), "Company bench": ("c13", "c15")})


@query("s15_read_plan", "with m as (select bench, cast(month(day) as string) as day, cast(sum(plan) as bigint) as plan, cast(sum(actual) as bigint) as actual from r9_plan group by 1, 2) select * from m")
def _(t):
    months = [str(m) for m in range(1, 13)]
    kinds = t.r9_plan.unpivot(["bench", "day"], ["plan", "actual"], "kind", "value")
    wide = kinds.groupBy("bench", "kind").agg(*[F.sum(F.when(F.month("day") == int(m), c("value"))).alias(m) for m in months])
    return T.read_plan(wide, months)


# ------------------------------------------------------------------------- sinks
_G = "regexp_replace(coalesce({0}, ''), '^([=+\\-@])', '''\\1')"


def csv_rows(t):
    """Published rows in the export's shape; some names start like a formula."""
    name = F.when(F.expr("pos % 25 = 0"), F.concat(F.lit("-"), "name")).when(F.expr("pos % 40 = 1"), F.concat(F.lit('say "hi", '), "name")).otherwise(c("name"))
    return t.r10_truth.withColumn("name", name).select(
        "*", F.when(c("delivered"), "name").alias("delivered_via"), c("findings").alias("findings_prior"), F.lit(2).alias("duplicate_siblings"), F.lit(1).alias("versions"),
        F.array(F.lit("a"), F.lit("b")).alias("other_versions"), F.lit("latest").alias("chosen_because"),
    )


@query(
    "k01_truth_csv",
    f"""select {_G.format("case when pos % 25 = 0 then '-' || name when pos % 40 = 1 then 'say \"hi\", ' || name else name end")} as task_name, state, coalesce(owner, '') as trainer, coalesce(cast(decided as string), '') as decided,
  case when connector then 'yes' when not connector then 'no' else '' end as connector, coalesce(array_to_string(services, ' | '), '') as connector_services, case when domain = 'Not recorded' then '' else domain end as domain, coalesce(array_to_string(findings, ' | '), '') as findings,
  case when possible_duplicate then '2' else '' end as duplicate_siblings, case when unmerged then 'unmerged: keyed on the submission id' else 'keyed by the pipeline family id' end as identity, id as task_id from r10_truth""",
)
def _(t):
    path = output_path(t.spark, "truth-csv")
    cells = E.truth_cells(csv_rows(t))
    E.write_csv(cells, path)
    back = t.spark.read.schema(cells.schema).csv(path, header=True, escape='"').na.fill("")
    return back.select("task_name", "state", "trainer", "decided", "connector", "connector_services", "domain", "findings", "duplicate_siblings", "identity", "task_id")


@query(
    "k02_audit_csv",
    """select task, batch, coalesce(case category when 'Code' then 'Engineering' when 'Law' then 'Legal' when 'Non-Connector · Legal' then 'Legal' else category end, '') as category, coalesce(bucket, cast(glm as string) || '/4', '(not recorded)') as glm, acceptance,
  coalesce(case when lower(trainer) <> 'unattributed' then trainer end, '') as trainer, coalesce(array_to_string(connectors, ' | '), '') as connectors,
  concat_ws(' | ', case when owner_contested then 'owner still contested' end, case when ambiguous then 'contested owner' end, case when unverified then 'unverified' end, case when version_dependent then 'version dependent' end) as flags, substr(sha256, 1, 16) as sha from r3_deliveries""",
)
def _(t):
    path = output_path(t.spark, "audit-csv")
    rows = delivery_rows(t).select("*", F.substring("sha256", 1, 16).alias("sha"), F.lit(1).alias("versions"), F.lit(None).cast("string").alias("feedback_url"))
    cells = E.audit_cells(rows.orderBy("batch", "task", "id"))
    E.write_csv(cells, path)
    back = t.spark.read.schema(cells.schema).csv(path, header=True, escape='"').na.fill("")
    return back.select("task", "batch", "category", "glm", "acceptance", "trainer", "connectors", "flags", "sha")


def handed_over(t, part: str):
    """One part of a hand-over, read back from its published version."""
    root = output_path(t.spark, "hand-over")
    H.publish_hand_over(manifest_rows(t), excluded(t), None, root)
    return P.read_published(t.spark, root, part)


@query("k03_ready_manifest", f"with {_SELECT} select key, id, stands_for, row_number() over (order by decided nulls first, key) as position from ent")
def _(t):
    return handed_over(t, "entries").select("key", "id", "stands_for", "position")


@query("k03_stands_for", f"with {_SELECT} select key, id from k where key in (select key from ent)")
def _(t):
    return handed_over(t, "stands_for")


@query(
    "k03_arithmetic",
    f"""with {_SELECT} select (select count(*) from k) as rows_considered, (select count(*) from x) as distinct_tasks, (select count(*) from x where gone) as excluded, (select count(*) from x where not gone) as available,
  cast(null as bigint) as requested, cast(0 as bigint) as short_by, {_counts("ent")}""",
)
def _(t):
    return handed_over(t, "arithmetic")


_ORDER = "case when batch like 'Batch%' then 0 else 1 end, cast(split_part(batch, ' ', 2) as double), batch, pos"


@query(
    "k04_delivery_manifest",
    f"""select row_number() over (order by {_ORDER}) as position, coalesce(package_name, task) as task_id, batch, list_last(string_split(package_path, '/')) as original_filename, lower(difficulty) as difficulty, type = 'Connector' as connector,
  case when bench = 'company' then 'Company Bench' else 'Computer Bench' end as bench, size_bytes, cast(glm as int) as successes from r3_deliveries""",
)
def _(t):
    path = output_path(t.spark, "delivery-manifest")
    entries = E.delivery_entries(t.r3_deliveries)
    E.write_json(entries, path)
    back = t.spark.read.schema(entries.schema).json(path)
    return back.select("position", "task_id", "batch", "original_filename", "difficulty", "connector", "bench", "size_bytes", c("trial_evidence.successes").alias("successes"))


@query(
    "k04_manifest_summary",
    """select 'by_batch' as measure, batch as value, count(*) as n from r3_deliveries group by 2 union all select 'by_bench', case when bench = 'company' then 'Company Bench' else 'Computer Bench' end, count(*) from r3_deliveries group by 2
union all select 'by_successes', coalesce(cast(glm as string), '(not recorded)'), count(*) from r3_deliveries group by 2 union all select 'tasks', '', count(*) from r3_deliveries union all select 'batches', '', count(distinct batch) from r3_deliveries
union all select 'connector', '', count(*) from r3_deliveries where type = 'Connector' union all select 'total_bytes', '', cast(sum(size_bytes) as bigint) from r3_deliveries union all select 'without_checksum', '', count(*) from r3_deliveries where sha256 is null""",
)
def _(t):
    return E.entry_summary(E.delivery_entries(t.r3_deliveries))


@query("k05_publish_if_reconciled", "select state, count(*) as n from r10_truth group by 1")
def _(t):
    root = output_path(t.spark, "published")
    rows = t.r10_truth.groupBy("state").agg(F.count("*").alias("n"))
    P.publish_if_reconciled(rows, Q.check_partition(t.r10_truth), root)
    # A later build that breaks an invariant must leave the first one in place.
    P.publish_if_reconciled(rows.where("n < 0"), Q.check_partition(t.r10_truth, declared=("accepted",)), root)
    return P.read_published(t.spark, root)


@query(
    "k06_folder_index",
    """with p as (select name, size_bytes, string_split(name, '/') as s from r2_objects), e as (select array_to_string(s[1:i], '/') as folder, s[i + 1] as name, i = len(s) - 1 as is_file, size_bytes from (select *, unnest(range(0, len(s))) as i from p)),
g as (select folder, name, is_file, sum(size_bytes) filter (where is_file) as bytes from e group by 1, 2, 3)
select cast(('0x' || substr(sha1(folder), 1, 8)) as bigint) % 16 as shard, folder, case when is_file then 'file' else 'dir' end as kind, name, cast(bytes as bigint) as bytes from g""",
)
def _(t):
    root = output_path(t.spark, "folder-index")
    # A first listing lacks the largest objects; the second writes the shards that they change.
    E.sync_shards(E.folder_index(t.r2_objects.where("size_bytes < 49000"), 16), root)
    E.sync_shards(E.folder_index(t.r2_objects, 16), root)
    return E.read_shards(t.spark, root)


@query(
    "k06_folder_sizes",
    """with p as (select name, size_bytes, string_split(name, '/') as s from r2_objects), e as (select array_to_string(s[1:i], '/') as folder, s[i + 1] as name, i = len(s) - 1 as is_file, size_bytes from (select *, unnest(range(0, len(s))) as i from p)),
g as (select folder, name, is_file, sum(size_bytes) filter (where is_file) as bytes from e group by 1, 2, 3)
select cast(('0x' || substr(sha1(folder), 1, 8)) as bigint) % 16 as shard, folder, count(*) filter (where not is_file) as dirs, count(*) filter (where is_file) as files, cast(coalesce(sum(bytes), 0) as bigint) as bytes from g group by 1, 2""",
)
def _(t):
    return E.folder_sizes(E.folder_index(t.r2_objects, 16))


# ----------------------------------------------------------------------- streams
def events_stream(t):
    return J.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def _runs_stream(t):
    """The runs view over a stream of the events file."""
    from taskweave.plans.views import VIEWS

    events_stream(t).createOrReplaceTempView("events_stream")
    return t.spark.sql(VIEWS["r1_runs"].replace("from events)", "from events_stream)"))


@query("t01_stream_canonical", f"with {X.IDS}, {X.RANKED} select identity, source, state, depth, outcome from ranked where rn = 1")
def _(t):
    out = output_path(t.spark, "canonical-stream")
    J.write_updates(J.stream_canonical(_runs_stream(t)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return J.latest_updates(t.spark, f"{out}/rows")


@query(
    "t02_stream_daily_delta",
    """select cast(ts as date) as day, event_type as state, count(*) as n from events where cast(ts as date) + interval 1 day <= (select max(ts) - interval 6 hours from events) group by 1, 2""",
)
def _(t):
    out = output_path(t.spark, "daily-stream")
    rows = events_stream(t).select(c("ts").cast("timestamp").alias("at"), c("event_type").alias("state"))
    J.write_appends(J.stream_daily_delta(rows, "6 hours"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema("day date, state string, n bigint").parquet(f"{out}/rows")


@query(
    "t03_stream_grace",
    """with a as (select event_id as run, user_id, ts from events where event_type = 'purchase'), p as (select event_id as package, user_id, ts from events where event_type = 'view'), j as (select run, package, a.ts from a left join p on p.user_id = a.user_id and p.ts between a.ts and a.ts + interval 30 minutes)
select run, package from j where package is not null or ts < (select least((select max(ts) from a), (select max(ts) from p)) - interval 40 minutes)""",
)
def _(t):
    out = output_path(t.spark, "grace-stream")
    rows = events_stream(t).withColumn("at", c("ts").cast("timestamp"))
    accepts = rows.where("event_type = 'purchase'").select(c("event_id").alias("run"), c("user_id").alias("key"), c("at").alias("accepted_at"))
    packages = rows.where("event_type = 'view'").select(c("event_id").alias("package"), c("user_id").alias("key"), c("at").alias("written_at"))
    J.write_appends(J.stream_grace(accepts, packages, "10 minutes"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema("run bigint, package bigint").parquet(f"{out}/rows")


# ------------------------------------------------------------------- SQL functions
@query(
    "v01_register_rules",
    f"""select package_id, {X.key("'harbor/' || name")} as key, {X.norm("name || '-v2-final'")} as stem, {BENCH} as bench, case when package_id % 3 = 0 then 'multi' when package_id % 3 = 1 then 'single' end as kind from (select package_id, kind as name, lower(image) as i from r7_package_text)""",
)
def _(t):
    register_rules(t.spark)
    t.r7_package_text.createOrReplaceTempView("package_text")
    return t.spark.sql(
        """select package_id, name_key('harbor/' || kind) as key, norm_name(kind || '-v2-final') as stem, bench_of_image(image) as bench,
        connector_count_kind(case package_id % 3 when 0 then array('slack', 'slack-gym', 'jira-gym') when 1 then array('Notion') else array('x') end) as kind from package_text"""
    )
