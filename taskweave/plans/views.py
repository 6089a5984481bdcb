"""SQL views that give the driver tables the shapes the operators read.

One text serves Spark and the oracle, so a query and its oracle share the
input. Every view reads its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from taskweave.session import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose views spell out names, which costs more than reading them.
SPELLED = ("customer", "part", "orders", "events")


def _prefix(n: str) -> str:
    return f"case ({n}) % 5 when 0 then 'code' when 1 then 'fin' when 2 then 'law' when 3 then 'gen' else 'x' end"


def _name(n: str, m: str) -> str:
    """A task name from two integers, e.g. ``fin-review-31-7-audit``."""
    return f"{_prefix(n)} || '-review-' || cast(({n}) % 100 as string) || '-' || cast(({m}) % 20 as string) || '-audit'"


_EVENTS = "(select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events) e"
_COHORT = (
    "case p_partkey % 4 when 0 then 'iteration_2' when 1 then 'iteration_1' "
    "when 2 then 'qc_accepted' else 'gate_only' end"
)

VIEWS: dict[str, str] = {
    # One row per submission x task.
    "r1_runs": f"""
select event_id as pos, '_v/' || lpad(cast(event_id as string), 10, '0') || '.json' as source,
  case when event_id % 10 < 7 then 'fam-' || cast(user_id as string) || '-' || cast(k % 10 as string) end as family_id,
  case when event_id % 10 in (7, 8) then 't-' || cast(event_id % 500 as string) end as task_id,
  case when event_id % 17 = 0 then 'harbor/' else '' end || {_prefix("k")} || '-task-' || cast(k as string)
    || case when event_id % 11 = 0 then '-v2' when event_id % 13 = 0 then '-final' else '' end as task_name,
  case when event_id % 23 > 0 then 'u' || cast(user_id as string) || '@x.com' end as owner,
  case event_type when 'purchase' then 'accepted' when 'view' then 'rejected' when 'signup' then 'running'
    when 'click' then 'queued' else 'error' end as state,
  case event_type when 'purchase' then 'accepted' when 'view' then case when event_id % 3 = 0 then '' else 'rejected' end
    else '' end as decision,
  case event_id % 4 when 0 then 'gate' when 1 then 'e2b' when 2 then 'package' else 'intake' end as stage,
  case when event_id % 5 = 0 then null else ts end as decided_at, ts as updated_at,
  split(case k % 4 when 0 then 'HARBOR-CHECK-' || cast(k % 7 as string) || ',GATE-ORACLE-REJECTED'
    when 1 then 'l1.realism_leakage:' || substr(md5(cast(event_id as string)), 1, 16)
    when 2 then 'HARBOR-CHECK-12' end, ',') as finding_codes
from {_EVENTS}""",
    # A listing: one row per stored object.
    "r2_objects": f"""
select 'tasks/' || {_COHORT} || '/' || case when p_size = 50 then '_NOTE-' || cast(p_partkey as string) || '.md' else
  {_prefix("p_partkey")} || '-task-' || cast(p_partkey % 100 as string) || '/'
  || case when p_size % 9 = 0 then 'review_handoff/' else '' end
  || md5(cast(p_partkey as string)) || case when p_size % 10 = 3 then '.txt' else '.zip' end end as name,
  cast(p_size as bigint) * 1000 as size_bytes, date '2024-01-01' + cast(p_size as int) as updated
from part""",
    # One row per delivered package.
    "r3_deliveries": f"""
select o_orderkey as pos, 'B-' || cast(o_orderkey as string) as id,
  {_name("o_orderkey", "o_custkey")} || case when o_orderkey % 13 = 0 then '-v2' when o_orderkey % 17 = 0 then '-final' when o_orderkey % 11 = 0 then '-q' else '' end as task,
  case when o_orderkey % 4 = 0 then null else 'pkg-' || cast(o_orderkey as string) end as package_name,
  case when o_custkey % 9 = 0 then 'CompanyBench ' else 'Batch ' end || cast(year(o_orderdate) - 1990 as string) || '.1' as batch,
  case o_orderstatus when 'F' then 'Accepted' when 'P' then 'Rejected' else 'Pending' end as acceptance,
  o_orderpriority as priority,
  case o_custkey % 5 when 0 then 'Code' when 1 then 'Law' when 2 then 'Non-Connector · Legal' when 3 then null else 'Synthetic' end as category,
  case when o_custkey % 2 = 0 then 'Connector' else 'Non-connector' end as type,
  case o_orderkey % 3 when 0 then 'Harder' when 1 then 'Easier' end as difficulty,
  case when o_orderkey % 6 = 5 then null else cast(o_orderkey % 6 as int) end as glm,
  case when o_orderkey % 12 = 5 then '2/4' end as bucket,
  case when o_custkey % 7 = 0 then 'Unattributed' else 'c' || cast(o_custkey as string) || '@x.com' end as trainer,
  case when o_custkey % 11 = 0 then 'Contested' else 'Workbook' end as source,
  case when o_orderkey % 3 = 0 then md5(cast(o_orderkey % 1000 as string)) || md5(cast(o_orderkey % 1000 + 1 as string)) end as source_object,
  case when o_orderkey % 3 = 0 then 'gs://bucket/tasks/' || case when o_orderkey % 2 = 0 then 'iteration_2' else 'iteration_1' end
    || '/' || {_name("o_orderkey", "o_custkey + 1")} || '/' || md5(cast(o_orderkey % 1000 as string)) || md5(cast(o_orderkey % 1000 + 1 as string)) || '.zip'
    when o_orderkey % 3 = 1 then 's3://other/' || cast(o_orderkey as string) end as source_uri,
  case o_orderkey % 5 when 0 then 'Connector/Harder/' when 1 then 'wrapper/Non-Connector/Easier/legal/' when 2 then 'zipped/harder/non-connector/engineering/'
    when 3 then 'Computer Bench (NC 39 RC 0 S 99)/Synthetic 99/Easier/' else 'Aster 180/' end || 'pkg_' || cast(o_orderkey as string) || '.zip' as package_path,
  md5(cast(o_orderkey as string)) || md5(cast(o_custkey as string)) as sha256,
  cast(o_orderkey % 900 + 1 as bigint) * 10000 as size_bytes,
  split(case o_custkey % 6 when 0 then 'slack-gym,slack' when 1 then 'github-gym,notion' when 2 then 'zeta3-sql-gym' when 3 then 'harbor' when 4 then 'linear' end, ',') as connectors,
  case when o_custkey % 9 = 0 then 'company' else 'computer' end as bench,
  case o_orderkey % 7 when 0 then 'real-aster' when 1 then 'real-zeta' when 2 then 'synthetic' when 3 then 'non-connector' when 4 then 'real' when 5 then 'synthetic' end as family,
  o_orderkey % 19 = 0 as ambiguous, o_orderkey % 23 = 0 as unverified, o_orderkey % 29 = 0 as version_dependent,
  o_orderkey % 31 = 0 as owner_contested, cast(o_orderdate as date) as delivered_on
from orders""",
    # One row per ledger line.
    "r4_ledger": f"""
select o_orderkey as src_row, {_name("o_orderkey", "o_custkey")} as task, 'c' || cast(o_custkey as string) || '@x.com' as email,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 2 = 0 then 'Connector' else 'Non-connector' end as type,
  o_orderstatus <> 'P' as valid,
  case when o_orderkey % 5 = 0 then 'cj-' || cast(o_custkey as string) end as cj,
  case o_custkey % 4 when 0 then 'company' when 3 then 'unassigned' else 'computer' end as bench
from orders""",
    # Payment requests, one per person and month.
    "r5_requests": """
select 'c' || cast(o_custkey as string) || case when o_custkey % 10 = 0 then '2@x.com' else '@x.com' end as email,
  case when o_custkey % 3 < 2 then 'cj-' || cast(o_custkey as string) end as cj,
  cast(date_trunc('month', o_orderdate) as date) as requested_on,
  count(*) as paid_tasks, count(*) * 300 as paid_amount
from orders where o_orderstatus = 'F' group by 1, 2, 3""",
    # What each person has been paid.
    "r5_paid": """
select 'c' || cast(o_custkey as string) || '@x.com' as email,
  cast(sum(case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then 1 when o_orderstatus = 'O' and o_custkey % 4 = 1 then 2 else 0 end) as bigint) as paid_tasks,
  cast(sum(case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then 1 when o_orderstatus = 'O' and o_custkey % 4 = 1 then 2 else 0 end) as bigint) * 300 as paid_amount
from orders group by o_custkey""",
    # People.
    "r6_roster": """
select 'c' || cast(c_custkey as string) || '@x.com' as email, c_name as name,
  case c_mktsegment when 'BUILDING' then 'Company' when 'MACHINERY' then 'Computer A' when 'HOUSEHOLD' then 'Computer B' else c_mktsegment end as team,
  case when c_acctbal > 2000 then 'Active' else 'Inactive' end as status, 'manager ' || cast(c_nationkey as string) as manager,
  'cj-' || cast(c_custkey as string) as cj
from customer""",
    # Config text and Dockerfile of each package.
    "r7_package_text": """
select p_partkey as package_id,
  '[meta]' || chr(10) || 'name = "other"' || chr(10) || '[task]' || chr(10) || 'name = "harbor/' || p_name || ' ' || cast(p_partkey % 50 as string) || '"' || chr(10) ||
  case p_size % 6 when 0 then 'mcp_servers = []' || chr(10) when 1 then '[[environment.mcp_servers]]' || chr(10) || 'name = "slack-gym"' || chr(10) || '[[environment.mcp_servers]]' || chr(10) || 'name = "jira-gym"' || chr(10)
    when 2 then 'mcp_servers = ["github-gym", "notion-gym"]' || chr(10) when 3 then '# mcp_servers to come' || chr(10) else '' end as toml,
  case when p_size % 2 = 0 then '﻿' else '' end || '# base' || chr(10) || 'FROM --platform=linux/amd64 ' ||
  case p_size % 7 when 0 then 'reg/aster:1' when 1 then 'reg/benchmark-base:2' when 2 then 'reg/connectors-rl-gym/x:3' when 3 then 'reg/real-data:1'
    when 4 then 'reg/real-data-v4' when 5 then 'reg/company-bench-private@sha256:dcf57c1b3362bb5ebb2ea59819c0892dc74699a3fa12a340677a317c37f4ddea' else 'python:3.12' end
    || chr(10) || 'RUN true' as dockerfile,
  case p_size % 7 when 0 then 'reg/aster:1' when 1 then 'reg/benchmark-base:2' when 2 then 'reg/connectors-rl-gym/x:3' when 3 then 'reg/real-data:1'
    when 4 then 'reg/real-data-v4' when 5 then 'reg/company-bench-private@sha256:dcf57c1b3362bb5ebb2ea59819c0892dc74699a3fa12a340677a317c37f4ddea' else 'python:3.12' end as image,
  p_type as kind, p_size as size
from part""",
    # Trials: reward NULL where it was not read.
    "r8_trials": """
select l_partkey as task, l_orderkey as run, l_linenumber as trial,
  case when l_returnflag = 'A' then 1.0e0 when l_returnflag = 'N' then 0.0e0 end as reward,
  l_linestatus = 'F' as complete, cast(l_quantity as int) % 5 as passes
from lineitem""",
    # Plan and actual per bench and day.
    "r9_plan": """
select cast(o_orderdate as date) as day, case when o_custkey % 2 = 0 then 'Company Bench' else 'Computer Bench' end as bench,
  count(*) as plan, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as actual
from orders group by 1, 2""",
    # Published task rows.
    "r10_truth": f"""
select event_id as pos, 'family:' || {_name("k", "user_id")} || case when event_id % 9 = 0 then '-q-' else '-' end || substr(md5(cast(event_id as string)), 1, 8) as id,
  case when event_id % 9 = 0 then 'harbor-single-task-' || cast(event_id % 700 as string)
    when event_id % 21 = 0 then 'Task2' else {_name("k", "user_id")} || case when event_id % 6 = 1 then '-v' || cast(event_id % 3 + 2 as string) else '' end end as name,
  case event_id % 8 when 0 then 'accepted' when 1 then 'legacy accepted' when 2 then 'rejected' when 3 then 'running' when 4 then 'queued'
    when 5 then 'error' when 6 then 'accepted' else 'no QC decision' end as state,
  case event_id % 8 when 0 then 'at the bar' when 1 then 'retired bar' when 2 then 'failed review' else 'undecided' end as why,
  case when event_id % 13 > 0 then 'u' || cast(user_id as string) || '@x.com' end as owner,
  case when event_id % 37 > 0 then cast(ts as date) end as decided, event_id % 5 = 0 as decided_inferred,
  cast(k % 9 + 1 as int) as runs, event_id % 7 = 0 as carried_over, event_id % 3 < 2 as at_current_bar, event_id % 10 = 1 as gate_only,
  case k % 4 when 0 then 'Opus gate' when 1 then 'GLM-5.2 gate only' when 2 then 'KESTREL on' else 'KESTREL full' end as gate_era,
  case k % 5 when 0 then 'Engineering' when 1 then 'Finance' when 2 then 'Legal' when 3 then 'Other' else 'Not recorded' end as domain,
  case event_id % 3 when 0 then true when 1 then false end as connector,
  case event_id % 11 when 0 then true when 1 then false end as delivered_type,
  case k % 6 when 0 then 'company bench zeta' when 1 then 'company bench aster' when 2 then 'computer bench synth' when 3 then 'computer bench real'
    when 4 then 'computer bench non-connector' end as bench,
  case when k % 6 in (0, 1) then 'company' when k % 6 in (2, 3, 4) then 'computer' end as bench_side,
  case when event_id % 4 = 0 then 'low' else 'high' end as confidence, event_id % 4 = 0 as unmerged,
  event_id % 15 = 0 as possible_duplicate, case when event_id % 30 = 0 then 'likely' when event_id % 15 = 0 then 'possible' else '' end as duplicate_tier,
  event_id % 12 = 0 as delivered, case when event_id % 24 = 0 then {_name("k", "user_id + 1")} end as delivered_task,
  event_id % 33 = 0 as maybe_delivered,
  case when event_id % 3 = 0 then cast(event_id % 5 as int) end as glm_passes, case when event_id % 3 = 0 then 4 end as glm_trials,
  event_id % 16 = 6 as glm53_failed,
  split(case k % 3 when 0 then 'HARBOR-CHECK,GATE-ORACLE-REJECTED' when 1 then 'l1.realism_leakage' end, ',') as findings,
  split(case event_id % 5 when 0 then 'iteration_2' when 1 then 'iteration_1,qc_accepted' end, ',') as cohorts,
  split(case event_id % 4 when 0 then 'slack-gym,jira-gym' when 1 then 'zeta3-sql-gym' when 2 then 'github-gym' end, ',') as services,
  case when event_id % 14 = 0 then {_name("k", "user_id + 2")} end as package_task,
  case when event_id % 20 = 0 then {_name("k", "user_id")} || '-v9' end as cohort_folder,
  'latest of its runs' as canonical_reason, '_v/' || lpad(cast(event_id as string), 10, '0') || '.json' as source
from {_EVENTS}""",
    # Scanned folders: one row per accepted folder.
    "r11_folders": f"""
select p_partkey as pos, {_name("p_partkey", "cast(floor(p_partkey / 100) as bigint)")} || case when p_size % 5 = 0 then '-v' || cast(p_partkey as string) when p_partkey % 40 = 7 then '-copy' else '' end as folder,
  case when p_size % 4 > 0 then {_name("p_partkey", "cast(floor(p_partkey / 150) as bigint)")} end as declared_short,
  'harbor/' || {_name("p_partkey", "cast(floor(p_partkey / 100) as bigint) + 1")} as declared_name,
  {_COHORT} as cohort, case p_partkey % 4 when 0 then 'Iteration 2' when 1 then 'Iteration 1' when 2 then 'QC accepted' else 'Gate only' end as cohort_label,
  case p_partkey % 4 when 3 then 'rejected' else 'accepted' end as outcome,
  case p_size % 3 when 0 then true when 1 then false end as is_connector,
  split(case p_size % 3 when 0 then 'slack-gym,jira-gym' end, ',') as connector_services,
  case p_partkey % 5 when 0 then 'code' when 1 then 'finance' when 2 then 'law' end as domain,
  md5(cast(p_partkey % 1000 as string)) || md5(cast(p_partkey % 1000 + 1 as string)) as sha256,
  date '2024-01-01' + cast(p_size as int) as updated, cast(p_size % 4 + 1 as bigint) as archives,
  case when p_size % 6 > 0 then 'c' || cast(p_partkey % 200 as string) || case when p_size % 12 = 5 then '@bots.gserviceaccount.com' else '@x.com' end end as owner,
  p_size % 11 = 0 as owner_contested,
  case when p_partkey % 3 > 0 then {_name("p_partkey", "cast(floor(p_partkey / 200) as bigint)")} end as package_task
from part""",
    # Evaluation cycles.
    "r12_cycles": f"""
select 'run-' || cast(o_orderkey as string) as id, 'o' || cast(o_custkey as string) as owner_key,
  case when o_orderkey % 3 > 0 then 'fam-' || cast(o_orderkey % 4 as string) end as family_id, 't-' || cast(o_orderkey % 6 as string) as task_id,
  {_name("o_orderkey", "o_custkey")} as task, 'c' || cast(o_custkey as string) || '@x.com' as trainer,
  case o_orderkey % 4 when 0 then 'accepted' when 1 then 'Rejected' else '' end as submission_status,
  case o_orderkey % 7 when 0 then 'rejected' when 1 then 'accepted' end as decision,
  case o_orderkey % 8 when 0 then 'waiting_for_trainer_edit' when 1 then 'infrastructure_error' when 2 then 'done' when 3 then 'running'
    when 4 then 'on_hold_now' when 5 then '' else 'queued' end as raw_status,
  cast(o_orderkey % 3 as bigint) as sequence, cast(o_orderkey % 5 as bigint) as attempt, cast(o_orderdate as date) as submitted_on,
  case when o_orderkey % 5 = 0 then 'Connector' end as task_type
from orders""",
    # Console submissions.
    "r13_console": f"""
select event_id as pos, case when event_id % 19 = 0 then 'obi/' else '' end || {_name("k", "user_id")} as name,
  case event_type when 'purchase' then 'accepted' when 'view' then 'rejected' when 'signup' then 'running' when 'click' then 'legacy_accepted' else 'error' end as state,
  case when event_id % 41 > 0 then ts end as submitted_at,
  case when event_id % 17 = 0 then 'dev@localhost' when event_id % 29 = 0 then '' else 'c' || cast((user_id + case when event_id % 97 = 0 then 1 else 0 end) % 400 as string) || '@x.com' end as trainer,
  case event_id % 6 when 0 then 'gate' when 1 then 'package' end as failed_stage,
  case event_id % 3 when 0 then 'Connector' when 1 then 'Non-connector' end as task_type,
  cast(event_id % 4 as bigint) as accepted_folders,
  'fam-' || cast(user_id as string) || '-' || cast(k % 10 as string) as family_id,
  't-' || cast(event_id % 3000 as string) as task_id, 'r-' || cast(event_id % 2500 as string) as run_id
from {_EVENTS}""",
    # Trainer credit sheet.
    "r14_sheet": f"""
select p_partkey as pos, 'task_' || replace({_name("p_partkey", "cast(floor(p_partkey / 100) as bigint)")}, '-', '_') || case when p_size % 3 = 0 then '-fixed' else '' end as sheet_name,
  case when p_size % 7 > 0 then 's' || cast(p_partkey % 30 as string) || '@x.com' end as trainer
from part""",
    # Hand reviews, one per batch and task.
    "r15_reviews": f"""
select 'Batch ' || cast(c_custkey % 9 + 2 as string) || '.1' as batch, {_name("c_nationkey * 3 + c_custkey", "c_custkey")} as task,
  min(case when c_nationkey % 4 > 0 then 'c' || cast(c_custkey as string) || '@x.com' end) as trainer, 'in-house' as trainer_type, 'high' as confidence
from customer group by 1, 2""",
    # Delivery manifests, one row per package.
    "r16_manifest": f"""
select o_orderkey as pos, {_name("o_orderkey", "cast(floor(o_orderkey / 100) as bigint)")} || case when o_orderkey % 50 = 3 then '-v7' else '' end as name,
  case when o_orderkey % 6 = 0 then 'harbor-single-task-' || cast(o_orderkey % 700 as string) end as task_id,
  'Batch ' || cast(o_custkey % 9 + 2 as string) || '.1' as batch, md5(cast(o_orderkey as string)) || md5('x') as sha256,
  case when o_orderkey % 4 = 0 then md5(cast(o_orderkey % 1000 as string)) || md5(cast(o_orderkey % 1000 + 1 as string)) when o_orderkey % 4 = 1 then md5(cast(o_orderkey as string)) || md5('y') end as object_hash,
  cast(null as string) as source_version, case when o_orderkey % 5 = 1 then md5(cast(o_orderkey % 1500 as string)) || md5(cast(o_orderkey % 1500 + 1 as string)) || '.zip' end as original_filename,
  'b-' || case when o_orderkey % 7 = 2 then substr(md5(cast(o_orderkey % 1000 as string)), 1, 12) else 'x' end as batch_id,
  case o_orderkey % 4 when 0 then 'iteration_2' when 1 then 'iteration_1' when 2 then 'qc_accepted' else 'gate_only' end as prefix,
  {_name("o_orderkey", "cast(floor(o_orderkey / 100) as bigint)")} as folder,
  'gs://bucket/tasks/' || case o_orderkey % 4 when 0 then 'iteration_2' when 1 then 'iteration_1' when 2 then 'qc_accepted' else 'gate_only' end || '/'
  || {_name("o_orderkey", "cast(floor(o_orderkey / 100) as bigint)")} || '/' || md5(cast(o_orderkey % 1000 as string)) || md5(cast(o_orderkey % 1000 + 1 as string)) || '.zip' as source_uri,
  case o_custkey % 3 when 0 then true when 1 then false end as connector
from orders""",
    # Scan rows, several per folder, one folder with many.
    "r18_scans": f"""
select p_partkey as pos, case when p_partkey % 13 = 0 then 'gen-review-8-8-audit' else {_name("cast(floor(p_partkey / 3) as bigint)", "cast(floor(p_partkey / 300) as bigint)")} end as folder,
  case when p_size % 4 > 0 then {_name("p_partkey", "cast(floor(p_partkey / 150) as bigint)")} || case when p_size % 5 = 0 then '-v3' else '' end end as declared_short,
  case when p_size % 9 > 0 then 'harbor/' || {_name("p_partkey", "cast(floor(p_partkey / 100) as bigint) + 1")} end as declared_name,
  case p_size % 3 when 0 then true when 1 then false end as is_connector,
  split(case p_size % 3 when 0 then 'slack-gym,jira-gym' end, ',') as connector_services
from part""",
    # A live listing of the accepted folders.
    "r17_listing": f"""
select 'gs://bucket/tasks/' || {_COHORT} || '/' || {_name("p_partkey", "cast(floor(p_partkey / 100) as bigint)")} || case when p_size % 5 = 0 then '-v' || cast(p_partkey as string) else '' end
  || '/' || case when p_size % 4 = 0 then 'review_handoff/' else '' end || md5(cast(p_partkey % 1000 as string)) || md5(cast(p_partkey % 1000 + 1 as string)) || '.zip' as name
from part""",
}

# The accepted folders, scanned or only listed, with the package that was opened.
VIEWS["r19_accepted"] = f"""
select folder, min(pos) as package_id from (select folder, pos from ({VIEWS["r18_scans"]}) s union all select folder, pos from ({VIEWS["r11_folders"]}) l where cohort = 'iteration_2') f group by folder"""


def depends_on(text: str) -> list[str]:
    """Names of the views a SQL text needs, in definition order, nested ones first."""
    used = {name for name in VIEWS if re.search(rf"\b{name}\b", text)}
    return [name for name in VIEWS if name in used]


def inline(text: str) -> str:
    """The SQL text with its views as common table expressions."""
    names = depends_on(text)
    if not names:
        return text
    body = text.strip()
    ctes = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in names)
    recursive = "recursive " if body[:14].lower() == "with recursive" else ""
    if body[:5].lower() == "with ":
        rest = body[14:] if recursive else body[5:]
        return f"with {recursive}{ctes}, {rest.strip()}"
    return f"with {ctes} {body}"


class Tables:
    """Driver tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in SPELLED else table
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", text):
                getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(text)
