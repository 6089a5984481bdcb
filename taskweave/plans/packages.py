"""Package rules: names, images, benches, families, classes, connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import packages as K
from taskweave.plans import fragments as X
from taskweave.plans.registry import query
from taskweave.sources import package_text as T

c = F.col

BENCH = """case when i like '%aster%' or i like '%f976065bf0ef919c5e259651c266967f98c8302629d3fbdc41ba2d69f8c73ebb%' or i like '%real-data-v4%' then 'company bench aster'
  when i like '%dcf57c1b3362bb5ebb2ea59819c0892dc74699a3fa12a340677a317c37f4ddea%' then 'computer bench synth' when i like '%zeta%' then 'company bench zeta'
  when i like '%real-data%' then 'computer bench real' when i like '%connectors-rl-gym%' then 'computer bench synth'
  when i like '%company-bench-private%' or i like '%benchmark-base%' or i like '%data-obi-rl-gym%' then 'company bench zeta' when i like '%connectors-harness%' then 'computer bench synth' end"""
FAMILY = "case bench when 'company bench aster' then 'real-aster' when 'company bench zeta' then 'real-zeta' when 'computer bench synth' then 'synthetic' when 'computer bench real' then 'real' end"
COUNTS = """case len(list_distinct(list_transform(list_filter(connectors, lambda g: regexp_matches(lower(g), '-gym$|^(slack|linear|github|notion)$')), lambda g: regexp_replace(lower(g), '-gym$', ''))))
  when 0 then null when 1 then 'single' else case when connectors is not null then 'multi' end end"""
SERVICE_COUNTS = COUNTS.replace("connectors", "services")
CTYPE = """coalesce(connector, delivered_type, case when bench like '%non-connector%' then false when bench like '%company bench%' or bench like '%computer bench synth%' or bench like '%computer bench real%' then true end)"""
SEGMENT = """case when side = 'company' then 'company' || coalesce('-' || harness, '') when conn then 'computer-connector' when not conn then 'computer-non-connector'
  when side = 'computer' then 'computer' else 'unknown' end"""


@query(
    "p05_name_variants",
    """with b as (select pos, regexp_replace(regexp_replace(lower(trim(sheet_name)), '^(harbor|obi)/', ''), '\\.zip$', '') as v from r14_sheet),
x as (select pos, v from b union all select pos, replace(v, '_', '-') from b), y as (select pos, v, regexp_replace(v, '^task-', '') as y from x),
z as (select pos, v, y, regexp_replace(y, '-[0-9a-f]{6}-v\\d+$', '') as z from y),
w as (select pos, v as s from z union select pos, y from z union select pos, z from z union select pos, regexp_replace(z, '(-v\\d+|-fixed|-final)+$', '') from z union select pos, regexp_extract(z, '^\\d{6}-(.+)$', 1) from z)
select pos, s as variant from w where length(s) > 6""",
)
def _(t):
    return t.r14_sheet.select("pos", F.explode(N.name_variants(c("sheet_name"))).alias("variant"))


@query(
    "p06_package_key",
    """select pos, regexp_replace(regexp_replace(lower(list_last(string_split(package_path, '/'))), '\\.zip$', ''), '(-v\\d+)+$', '') as package_key from r3_deliveries""",
)
def _(t):
    return t.r3_deliveries.select("pos", N.package_key(c("package_path")).alias("package_key"))


@query(
    "p07_legacy_task_key",
    """select pos, regexp_replace(regexp_replace(regexp_replace(lower(task), '-(?:v|version)[0-9][a-z0-9.-]*$', ''), '-(?:final|modified|reviewed(?:-[0-9]+)?|hardened|candidate|clean|submit)$', ''),
  '-[0-9]{8}t[0-9]{6}z(?:-[0-9]+-?[0-9]*)?$', '') as task_key from r3_deliveries""",
)
def _(t):
    return t.r3_deliveries.select("pos", N.legacy_task_key(c("task")).alias("task_key"))


@query(
    "p17_no_domain_on_connector",
    f"""select pos, case when {CTYPE} and domain <> 'Not recorded' then 'Not recorded' else domain end as domain, case when {CTYPE} and domain <> 'Not recorded' then domain end as domain_from_name from r10_truth""",
)
def _(t):
    d = K.domain_without_connector(c("domain"), K.connector_type(c("connector"), c("delivered_type"), c("bench")))
    return t.r10_truth.select("pos", d["domain"].alias("domain"), d["domainFromName"].alias("domain_from_name"))


@query("p21_bench_of_image", f"select package_id, {BENCH} as bench from (select package_id, lower(image) as i from r7_package_text)")
def _(t):
    return t.r7_package_text.select("package_id", K.bench_of_image(c("image")).alias("bench"))


@query("p22_connector_type", f"select pos, {CTYPE} as is_connector from r10_truth")
def _(t):
    return t.r10_truth.select("pos", K.connector_type(c("connector"), c("delivered_type"), c("bench")).alias("is_connector"))


@query(
    "p23_bench_for_non_connector",
    """with x as (select pos, bench, (connector is false) or (bench is null and pos % 2 = 0) as moved from r10_truth)
select pos, case when moved then 'computer bench non-connector' else bench end as bench, case when moved and bench <> 'computer bench non-connector' then bench end as bench_from_image from x""",
)
def _(t):
    b = K.bench_for_non_connector(c("connector"), c("bench"), F.expr("pos % 2 = 0"))
    return t.r10_truth.select("pos", b["bench"].alias("bench"), b["benchFromImage"].alias("bench_from_image"))


@query(
    "p24_package_family",
    f"""with i as (select package_id, size, kind, case when size % 4 = 0 then lower(image) end as i, lower(image) as own from r7_package_text),
b as (select *, {BENCH} as bench from i), f as (select package_id, size, kind, {FAMILY} as recorded, own from b),
o as (select package_id, size, kind, recorded, {BENCH} as bench from (select *, own as i from f)), r as (select *, {FAMILY} as own from o),
d as (select *, case size % 5 when 1 then 'zeta set' when 2 then 'synth' when 3 then 'real' else '' end as declared, case when size % 3 = 0 then false end as connector,
  case when kind = 'PROMO' then 'Non-Connector' else 'Connector' end as klass, case when size % 2 = 0 then 'github-gym' else 'jira-gym' end as gym from r)
select package_id, case when recorded <> 'real' then recorded when connector is false or klass = 'Non-Connector' then 'non-connector' when declared = 'zeta set' then 'real-zeta'
  when declared = 'synth' then 'synthetic' when own in ('real-aster', 'real-zeta') then own when own = 'synthetic' and recorded is null and declared <> 'real' then 'synthetic' when own = 'synthetic' then 'real'
  when (recorded is not null or declared = 'real') and gym = 'github-gym' then 'real-aster' when recorded is not null or declared = 'real' then 'real' when own is null then 'non-connector' end as family,
 case when recorded <> 'real' then 'the image the manifest records' when connector is false or klass = 'Non-Connector' or declared in ('zeta set', 'synth') then 'the manifest'
  when own in ('real-aster', 'real-zeta') then 'the image in the package' when own = 'synthetic' and recorded is null and declared <> 'real' then 'the image in the package'
  when own = 'synthetic' then 'the manifest says real, the image in the package is synthetic'
  when (recorded is not null or declared = 'real') and gym = 'github-gym' then 'the connectors the manifest lists' when recorded is not null then 'the image the manifest records' when declared = 'real' then 'the manifest'
  when own is null then 'the image in the package (no connector harness)' end as family_from from d""",
)
def _(t):
    rows = K.with_package_family(
        t.r7_package_text,
        [F.when(F.expr("size % 4 = 0"), c("image"))],
        F.when(F.expr("size % 3 = 0"), F.lit(False)),
        F.when(c("kind") == "PROMO", F.lit("Non-Connector")).otherwise(F.lit("Connector")),
        F.expr("case size % 5 when 1 then 'zeta set' when 2 then 'synth' when 3 then 'real' else '' end"),
        c("image"),
        F.lit(K.FROM_NAME),
        F.when(F.expr("size % 2 = 0"), F.array(F.lit("github-gym"))).otherwise(F.array(F.lit("jira-gym"))),
    )
    return rows.select("package_id", "family", "family_from")


@query(
    "p25_package_class",
    """with p as (select pos, connectors, 'pkg_' || cast(pos as string) || '.zip' as leaf from r3_deliveries)
select pos, case pos % 5 when 0 then 'Connector/Harder/' when 1 then 'Non-Connector/Easier/Legal/' when 2 then 'non-connector/harder/Engineering/' when 3 then 'Synthetic/Easier/' else 'Aster 180/' end || leaf as parts,
  case pos % 5 when 0 then 'Connector' when 1 then 'Non-Connector' when 2 then 'Non-Connector' when 3 then 'Synthetic' else 'Aster' end as class from p""",
)
def _(t):
    parts = K.package_parts(c("package_path"))
    return t.r3_deliveries.select("pos", parts.alias("p")).select(
        "pos", F.array_join("p", "/").alias("parts"), K.package_class(F.get("p", F.lit(0)), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("class")
    )


@query(
    "p26_batch_label",
    """with n as (select o_orderkey as id, case o_orderkey % 6 when 0 then '09-25-Batch' || cast(o_custkey % 12 as string) || '.1' when 1 then '09-27 Batch' || cast(o_custkey % 5 as string) || ' CompanyBench 267'
  when 2 then '[Deprecated] Batch ' || cast(o_custkey as string) when 3 then 'Meta - 0919' when 4 then '08-07-delivery' else '09-24 Knowledge-Work (207)' end as name, o_custkey as n from orders)
select id, case id % 6 when 0 then 'Batch ' || cast(n % 12 as string) || '.1' when 1 then 'CompanyBench ' || cast(n % 5 as string) end as label,
  case id % 6 when 2 then 'name marks it as deprecated, not a delivered batch' when 3 then 'name marks it as meta, not a delivered batch' when 4 then 'name does not say which batch it is'
    when 5 then 'name marks it as knowledgework, not a delivered batch' end as reason from n""",
)
def _(t):
    name = F.expr(
        """case o_orderkey % 6 when 0 then '09-25-Batch' || cast(o_custkey % 12 as string) || '.1' when 1 then '09-27 Batch' || cast(o_custkey % 5 as string) || ' CompanyBench 267'
        when 2 then '[Deprecated] Batch ' || cast(o_custkey as string) when 3 then 'Meta - 0919' when 4 then '08-07-delivery' else '09-24 Knowledge-Work (207)' end"""
    )
    return t.orders.select(c("o_orderkey").alias("id"), K.batch_label(name).alias("b")).select("id", "b.*")


@query(
    "p27_source_ref",
    """select pos, case when source_object is not null then source_object end as object, case when source_uri like 'gs://bucket/%' then split_part(source_uri, '/', 5) end as prefix,
  case when source_uri like 'gs://bucket/%' then split_part(source_uri, '/', 6) end as folder, case when source_uri like 'gs://bucket/%' then 'pipeline' when source_uri is not null then 'elsewhere' end as kind from r3_deliveries""",
)
def _(t):
    return t.r3_deliveries.select("pos", K.source_ref(c("source_uri"), F.lit(None).cast("string"), F.lit(None).cast("string"), "bucket").alias("s")).select("pos", "s.*")


@query(
    "p28_connector_names",
    """select package_id, case size % 4 when 0 then 'slack-gym,jira-gym' when 1 then 'github-gym' when 2 then 'a-gym,b-gym,c' else null end as names from r7_package_text""",
)
def _(t):
    raw = F.expr(
        """case size % 4 when 0 then '["slack-gym", "jira-gym"]' when 1 then '[{"name": "github-gym", "image": "x"}]' when 2 then ' a-gym | b-gym, ;c' end"""
    )
    return t.r7_package_text.select("package_id", F.nullif(F.array_join(K.connector_names(raw), ","), F.lit("")).alias("names"))


@query("p29_connector_count_kind", f"select pos, {COUNTS} as kind from r3_deliveries")
def _(t):
    return t.r3_deliveries.select("pos", K.connector_count_kind(c("connectors")).alias("kind"))


@query(
    "p30_harness_of",
    f"""select package_id, coalesce(case when bench like 'company bench %' then split_part(bench, ' ', 3) end, case size % 4 when 0 then 'zeta' end) as harness
from (select *, {BENCH} as bench from (select *, lower(image) as i from r7_package_text))""",
)
def _(t):
    gyms = F.when(F.expr("size % 4 = 0"), F.array(F.lit("zeta3-sql-gym"), F.lit("slack")))
    return t.r7_package_text.select("package_id", K.harness_of([c("image")], gyms).alias("harness"))


@query(
    "p31_task_segment",
    f"select pos, {SEGMENT} as segment from (select pos, bench_side as side, connector as conn, case pos % 3 when 0 then 'zeta' when 1 then 'aster' end as harness from r10_truth)",
)
def _(t):
    harness = F.expr("case pos % 3 when 0 then 'zeta' when 1 then 'aster' end")
    return t.r10_truth.select("pos", K.task_segment(c("bench_side"), c("connector"), harness).alias("segment"))


@query(
    "p32_domain_kind",
    f"""with x as (select pos, bench_side as side, connector as conn, domain, bench, case pos % 3 when 0 then 'zeta' when 1 then 'aster' end as harness, {SERVICE_COUNTS} as n from r10_truth),
s as (select *, {SEGMENT} as segment from x)
select pos, case when segment like 'company%' then coalesce(upper(substr(harness, 1, 1)) || substr(harness, 2), 'Company Bench') || ' · ' || case n when 'single' then 'Single connector' when 'multi' then 'Multi-connector' else 'connectors not read' end
  when segment = 'computer-connector' then case when pos % 5 = 0 then 'Real Aster' when bench = 'computer bench synth' then 'Synthetic' when bench = 'computer bench real' then 'Real · Aster or Zeta not recorded' else 'Connector' end
  else domain end as kind from s""",
)
def _(t):
    harness = F.expr("case pos % 3 when 0 then 'zeta' when 1 then 'aster' end")
    segment = K.task_segment(c("bench_side"), c("connector"), harness)
    kind = K.domain_kind(
        segment, c("domain"), harness, K.connector_count_kind(c("services")), F.when(F.expr("pos % 5 = 0"), F.lit("Real Aster")), c("bench")
    )
    return t.r10_truth.select("pos", kind.alias("kind"))


@query(
    "p33_category_and_score",
    """select pos, case category when 'Code' then 'Engineering' when 'Law' then 'Legal' when 'Non-Connector · Legal' then 'Legal' else category end as category,
  coalesce(bucket, cast(glm as string) || '/4', '(not recorded)') as score from r3_deliveries""",
)
def _(t):
    return t.r3_deliveries.select("pos", K.merged_category(c("category")).alias("category"), K.score_bucket(c("bucket"), c("glm")).alias("score"))


@query(
    "p34_row_flags",
    """select pos, concat_ws('|', case when owner_contested then 'owner still contested' end, case when ambiguous then 'contested owner' end, case when unverified then 'unverified' end,
  case when version_dependent then 'version dependent' end) as flags from r3_deliveries""",
)
def _(t):
    flags = K.row_flags(*map(c, ("owner_contested", "ambiguous", "unverified", "version_dependent")))
    return t.r3_deliveries.select("pos", F.array_join(flags, "|").alias("flags"))


@query(
    "p35_task_key",
    f"""select pos, coalesce('folder:' || cohort_folder, 'audit:' || delivered_task, 'name:' || {X.stem("lower(name)")}) as truth_key,
  coalesce('task:' || {X.stem("package_task")}, 'folder:' || cohort_folder, {X.stem("lower(name)")}) as manifest_key from r10_truth""",
)
def _(t):
    return t.r10_truth.select(
        "pos",
        N.truth_task_key(c("cohort_folder"), c("delivered_task"), c("name")).alias("truth_key"),
        N.manifest_task_key(c("package_task"), c("cohort_folder"), c("name")).alias("manifest_key"),
    )


@query(
    "p36_batch_order",
    """select batch, cast(case when batch like 'Batch%' then 0 else 1 end as int) as series, cast(split_part(batch, ' ', 2) as double) as number, count(*) as packages from r3_deliveries group by 1, 2, 3""",
)
def _(t):
    series, number, _text = N.batch_order(c("batch"))
    return t.r3_deliveries.groupBy("batch").agg(F.count("*").alias("packages")).select("batch", series.alias("series"), number.alias("number"), "packages")


@query(
    "s13_package_facts",
    """with x as (select *, list_sort(list_distinct(case when toml like '%[[environment.mcp_servers]]%' then regexp_extract_all(toml, 'name = "([a-z]+-gym)"', 1) when toml like '%mcp_servers = ["%' then regexp_extract_all(toml, '"([a-z]+-gym)"', 1) else [] end)) as s from r7_package_text)
select package_id, case when len(s) > 0 then true when toml like '%mcp_servers = []%' or toml not like '%mcp_servers%' then false end as connector, array_to_string(s, ',') as services,
  case when toml like '%[[environment.mcp_servers]]%' then 'a [[mcp_servers]] table with entries' when len(s) > 0 then 'a non-empty mcp_servers list' when toml like '%mcp_servers = []%' then 'mcp_servers declared and empty'
    when toml like '%mcp_servers%' then 'mcp_servers present but not readable' else 'task.toml declares no mcp_servers at all' end as basis,
  regexp_extract(toml, '\\[task\\]\\nname = "([^"]+)"', 1) as task_name, image from x""",
)
def _(t):
    facts = T.package_facts(t.r7_package_text.select("package_id", "toml", "dockerfile"), "package_id")
    return facts.withColumn("services", F.array_join("services", ","))
