"""Operators on small fixtures: brute force, order independence, skew, sinks."""

import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from taskweave.operators import audits as A
from taskweave.operators import canonical as C
from taskweave.operators import delivered as D
from taskweave.operators import figures as G
from taskweave.operators import filters as S
from taskweave.operators import lookups as J
from taskweave.operators import ordering as O
from taskweave.operators import postings
from taskweave.operators import quality as Q
from taskweave.plans.views import Tables
from taskweave.session import numbered, output_path
from taskweave.sinks import exports as E
from taskweave.sinks import publish as P
from taskweave.sources import refresh

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def spelled_whole(hay, name):
    """Every occurrence, tested at both ends."""
    at = hay.find(name)
    while at >= 0:
        end = at + len(name)
        if (at == 0 or not hay[at - 1].isalnum()) and (end == len(hay) or not hay[end].isalnum()):
            return True
        at = hay.find(name, at + 1)
    return False


def test_embedded_names_equal_a_scan(spark):
    rng = random.Random(3)
    words = ["code", "c24", "cloud", "tag", "audit", "x", "realdocoutput", "7"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(["-", "_", "/", "--", ""]) for _ in range(n))
    hays = [(i, "family:" + make(rng.randint(3, 9))) for i in range(120)]
    names = sorted({make(rng.randint(2, 5)) for _ in range(150)} | {"code-c24-cloud-tag-audit"})
    hays += [(800, "first line\n/code-c24-cloud-tag-audit\nlast"), (801, "x/" * 20_000 + "code-c24-cloud-tag-audit"), (900, "family:code-c24-cloud-tag-audit-2026"), (901, "precode-c24-cloud-tag-audit"), (902, "family:code-c24-cloud-tag-auditor")]
    expected = sorted((i, n) for i, h in hays for n in names if len(n) > 14 and spelled_whole(h, n))
    got = D.embedded_in(
        spark.createDataFrame(hays, "id int, hay string"), "id", F.col("hay"), spark.createDataFrame([(n,) for n in names], "value string")
    )
    assert rows(got) == sorted(expected, key=str)
    assert {(i, "code-c24-cloud-tag-audit") for i in (800, 801, 900)} <= set(expected) and not any(i in (901, 902) for i, _n in expected)


def test_embedded_names_stay_with_their_text(spark):
    """A start in one text says nothing about another of the same id."""
    hays = spark.createDataFrame([(1, "x/code-c24-cloud-tag-auditor"), (1, "abcode-c24-cloud-tag-audit"), (2, "x/code-c24-cloud-tag-audit"), (2, None)], "id int, hay string")
    names = spark.createDataFrame([("code-c24-cloud-tag-audit",), ("short",), (None,)], "value string")
    assert rows(D.embedded_in(hays, "id", F.col("hay"), names)) == [(2, "code-c24-cloud-tag-audit")]
    assert rows(D.embedded_in(hays, "id", F.col("hay"), names.where("false"))) == []


def test_starts_of_identifiers_are_not_shuffled(spark):
    t = Tables(spark, SMALL)
    audits = t.r3_deliveries.select("pos", "task")
    names = D.audit_keys(audits, t.r10_truth).where(F.col("kind") == D.BY_ID)
    plan = D.embedded_in(t.r10_truth, "id", F.col("id"), names)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(opening" not in plan and "hashpartitioning(id" in plan


def walk_the_audit(audits, reach):
    """Audited tasks in order: the first to reach a row claims it."""
    owner, method, matched = {}, {}, set()
    for pos in audits:
        hits = reach[pos]
        if any(r not in owner for r in hits):
            matched.add(pos)
            for r, how in hits.items():
                method[r] = how
                owner.setdefault(r, pos)
    return owner, method, matched


def test_delivered_join_equals_walking_the_audit(spark):
    rng = random.Random(11)
    names = [f"task-number-{i}-of-the-ledger" for i in range(12)]
    truth = []
    for i in range(60):
        n = rng.choice(names)
        shown = rng.choice([n, n, n + "-v2", f"harbor-single-task-{i}"])
        truth.append((f"family:{rng.choice([n, n + '-extra'])}-{i:06x}", shown, f"v/{i}.json"))
    audit = [(p, rng.choice(names) + rng.choice(["", "", "-final", "-extra"])) for p in range(40)]

    stem = lambda s: __import__("re").sub(r"(-(final|v\d+|\d{4,}|copy|new|fixed|updated))+$", "", s)
    by_stem = {}
    for _id, n, _s in truth:
        by_stem.setdefault(stem(n), set()).add(n)
    named = {n for _i, n, _s in truth} | {stem(n) for _i, n, _s in truth}
    reach = {}
    for pos, task in audit:
        clear = len(by_stem.get(stem(task), ())) < 2
        hits = {}
        for i, n, s in truth:
            if n == task:
                hits[i] = D.BY_NAME
            elif clear and stem(n) == stem(task):
                hits[i] = D.BY_STEM
            elif clear and len(task) > 14 and task not in named and spelled_whole(f"{i}/{s}", task):
                hits[i] = D.BY_ID
        reach[pos] = hits
    owner, method, matched = walk_the_audit([p for p, _t in audit], reach)
    task_of = dict(audit)

    delivered, audited = D.join_delivered(
        spark.createDataFrame(audit, "pos int, task string"), spark.createDataFrame(truth, "id string, name string, source string")
    )
    assert rows(delivered.select("id", "method", "delivered_task")) == sorted(((i, method[i], task_of[owner[i]]) for i in owner), key=str)
    assert {r["pos"] for r in audited.where("matched").collect()} == matched


def test_winner_does_not_depend_on_input_order(spark):
    runs = Tables(spark, SMALL).r1_runs
    once = C.canonical_run(C.with_identity(runs)).select("identity", "source")
    again = C.canonical_run(C.with_identity(runs.orderBy(F.xxhash64("pos")).repartition(7))).select("identity", "source")
    assert rows(once) == rows(again)


def test_top_two_agree_with_the_winner(spark):
    ident = C.with_identity(Tables(spark, SMALL).r1_runs)
    ranked = C.rank_runs(ident).select("identity", F.col("winner").alias("pos"))
    assert rows(ranked) == rows(C.canonical_run(ident).select("identity", "pos"))


def test_ranking_limits_each_group_before_the_shuffle(spark):
    plan = C.rank_runs(C.with_identity(Tables(spark, SMALL).r1_runs))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_count_reached_counts_each_row_once(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "z")], "id int, key string")
    right = spark.createDataFrame([(10, 0, "a"), (10, 1, "b"), (11, 0, "b"), (11, 1, "c"), (12, 0, "a")], "rid int, at int, key string")
    got = J.count_reached(left, "id", right, "rid")
    assert rows(got) == [(1, 3), (2, 1)]


def test_count_reached_of_many_spellings(spark):
    """Left ones of up to sixty spellings against brute force; a spelling that a third of the right rows have."""
    r = random.Random(4)
    name = lambda: "hot" if r.random() < 0.3 else f"n{r.randrange(120)}"
    left = {i: {name() for _ in range(r.choice((1, 3, 60)))} for i in range(40)}
    right = {i: list(dict.fromkeys(name() for _ in range(r.randint(0, 4)))) for i in range(600)}
    keys = spark.createDataFrame([(i, k) for i, own in left.items() for k in own], "id int, key string")
    spelled = spark.createDataFrame([(i, at, k) for i, own in right.items() for at, k in enumerate(own)], "rid int, at int, key string")
    got = J.count_reached(keys, "id", spelled.join(keys.select("key").distinct(), "key", "left_semi"), "rid")
    want = {i: sum(not own.isdisjoint(k) for k in right.values()) for i, own in left.items()}
    assert dict(map(tuple, got.collect())) == {i: n for i, n in want.items() if n}


def test_cohort_fold_counts_verdicts_that_share_an_id(spark):
    """Rows of one id are a verdict each where state, day, owner or runs differ, and one where all are equal."""
    folders = spark.createDataFrame([("gen-a",), ("gen-b",)], "folder string")
    scan = spark.createDataFrame([], "pos long, folder string, declared_short string, declared_name string, is_connector boolean, connector_services array<string>")
    same = ("family:x-0a1b2c3d", "gen-a", "accepted", "2024-01-03", "u1", 2)
    truth = spark.createDataFrame(
        [same, same, ("family:x-0a1b2c3d", "gen-a", "queued", "2024-01-02", "u1", 2), ("family:x-0a1b2c3d", "gen-a", "queued", "2024-01-02", None, 2), (same[0], "gen-b", *same[2:]), ("family:y", "gen-b-v2", "error", None, None, 1)],
        "id string, name string, state string, decided string, owner string, runs int",
    ).withColumn("decided", F.col("decided").cast("date"))
    manifest = spark.createDataFrame([], "pos long, folder string, batch string, connector boolean")
    reads = spark.createDataFrame([], "folder string, connector boolean, basis string")
    got = D.cohort_fold(folders, scan, truth, manifest, reads).select("folder", "verdicts", "state", F.array_join("states", ",").alias("states"))
    assert rows(got) == [("gen-a", 3, "accepted", "accepted,queued"), ("gen-b", 2, "accepted", "accepted,error")]


def test_contested_families_copy_no_rows(spark):
    """Against brute force, with rows without family, submitter or day; rows of a task are not multiplied."""
    r = random.Random(5)
    day = lambda: r.choice([None, "2024-01-01", "2024-01-20", "2024-01-30"])
    sent = [(i, r.choice([None, "", "f1", "f2", "f3"]), r.choice(["n1", "n2", None]), r.choice([None, "", "bot", "a@x.com", "b@x.com"]), r.choice("su"), day()) for i in range(60)]
    df = spark.createDataFrame(sent, "pos int, family_id string, name string, trainer string, state string, submitted_at string")
    got = A.contested_families(df, F.col("trainer").endswith("@x.com"), "2024-01-25")
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    groups = {}
    for row in sent:
        groups.setdefault(row[1] or (f"name:{row[2]}" if row[2] else None), []).append(row)
    for family, own in groups.items():
        own.sort(key=lambda x: (x[5] or "0001-01-01", x[0]))
        people = [x for x in own if (x[3] or "").endswith("@x.com")]
        if len({x[3] for x in people}) < 2:
            continue
        machines = {x[3] for x in own if x[3] and not x[3].endswith("@x.com")}
        scope = "live" if (own[-1][5] or "0001") >= "2024-01-25" else "legacy"
        want.append((family, len(own), len({x[2] for x in own} - {None}), 2, len(machines), scope, people[0][3], people[-1][3], people[0][4], people[-1][4], own[-1][4], people[0][3] != people[-1][3]))
    assert len(want) >= 3
    shown = got.select("family", "submissions", "distinct_names", "trainer_count", "machine_submitters", "scope", "first_trainer", "last_trainer", "first_state", "last_state", "final_state", "handover")
    assert rows(shown) == sorted(want, key=str)


def test_rows_that_name_no_package_do_not_meet(spark):
    truth = spark.range(4000).select(
        F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("gen-"), "id").alias("name"), F.when(F.col("id") < 2, F.lit("gen-pack")).alias("package_task"),
        (F.col("id") == 1).alias("delivered"), F.lit(None).cast("string").alias("delivered_task"), F.lit(None).cast("boolean").alias("maybe_delivered"),
    )
    sent = spark.createDataFrame(
        [(2, "gen-pack", "B2"), (1, "Gen-Pack", "B1"), (3, "gen-7", "B3")], "pos long, task string, batch string"
    ).selectExpr("*", "cast(null as string) as package_name", "cast(null as string) as source_prefix", "cast(null as string) as source_folder", "false as audited")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = D.mark_rows_delivered(truth, sent, "iteration_2").withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    marked = {r["id"]: tuple(r)[1:4] for r in got if r["delivered"]}
    assert len(got) == 4000 and marked == {"t0": (True, "Gen-Pack", "B1: the task name it carries"), "t1": (True, None, None), "t7": (True, "gen-7", "B3: the task name it carries")}
    sizes = [sum(r["part"] == p for r in got) for p in {r["part"] for r in got}]
    assert max(sizes) < 2000


def test_numbered_is_a_dense_total_order(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 3).repartition(13)
    got = numbered(df, [F.col("k"), F.col("id")]).orderBy("position").select("k", "id", "position").collect()
    assert [r["position"] for r in got] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_rank_within_a_group_holding_most_rows(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold"))
    got = J.ranked_within(df, "g", "id", "rank")
    for g, n in (("hot", 2100), ("cold", 900)):
        assert [r["rank"] for r in got.where(F.col("g") == g).orderBy("id").collect()] == list(range(1, n + 1))


def test_agreed_refuses_two_values(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("", "z"), ("c", None)], "key string, value string")
    assert rows(J.agreed(pairs)) == [("a", "x"), ("b", None)]


def test_chain_in_one_pass_equals_filters(spark):
    t = Tables(spark, SMALL).r10_truth
    from taskweave.operators.provenance import provenance_chain

    steps = [("a", F.col("at_current_bar"), ""), ("b", F.col("state") == "accepted", ""), ("c", F.col("connector"), "")]
    got = [r["count"] for r in provenance_chain(t, {"x": steps}).orderBy("pos").collect()]
    kept, expected = t, []
    for _label, predicate, _source in steps:
        kept = kept.where(predicate)
        expected.append(kept.count())
    assert got == expected


def test_facet_counts_equal_one_filter_per_value(spark):
    """Each count is that of filtering by the value instead of the facet's own filter, also for lists and derived facets."""
    t = Tables(spark, SMALL).r10_truth.cache()
    f = {"domain": "Legal", "finding": "HARBOR-CHECK", "delivered": "no"}
    facets = ["finding", "cohort", "delivered", "delivery", "gate_era", "connector", "glm"]
    got = S.facet_counts(t, f, facets).collect()
    for r in got:
        if r["value"] != S.NO_VALUE:
            asked = {k: v for k, v in f.items() if k != r["facet"]} | {r["facet"]: r["value"]}
            assert S.filter_truth(t, asked).count() == r["n"], (r["facet"], r["value"])
    assert {"ready", "yes", "no"} <= {r["value"] for r in got if r["facet"] == "delivered"}
    assert S.facet_counts(t, {"domain": "no such"}, ["state"]).agg(F.sum("n"), F.count("*")).first() == (0, 5)


def test_inverted_range_is_empty(spark):
    t = Tables(spark, SMALL).r10_truth
    assert S.inverted("2024-02-01", "2024-01-01")
    assert t.where(S.date_range(F.col("decided"), "2024-02-01", "2024-01-01")).isEmpty()


def test_sample_is_repeatable(spark):
    t = Tables(spark, SMALL).r13_console
    first = rows(O.sample_groups(t, F.col("name"), 7, 5))
    assert first == rows(O.sample_groups(t.repartition(5), F.col("name"), 7, 5))
    assert len(first) == 5 and all(n > 1 for _k, n in first)


def test_failed_check_keeps_the_previous_version(spark):
    root = output_path(spark, "published-test")
    good = spark.createDataFrame([("accepted",)], "state string")
    assert P.publish_if_reconciled(good, Q.check_partition(good), root)
    bad = spark.createDataFrame([("nonsense",)], "state string")
    assert not P.publish_if_reconciled(bad, Q.check_partition(bad), root)
    assert rows(P.read_published(spark, root)) == [("accepted",)]


def test_versions_are_numbered(spark):
    root = output_path(spark, "numbered-versions")
    for state in ("accepted", "rejected", "running"):
        one = spark.createDataFrame([(state,)], "state string")
        assert P.publish_if_reconciled({"rows": one, "more": one}, Q.check_partition(one), root)
        assert rows(P.read_published(spark, root, "more")) == [(state,)]
    assert P.latest(spark, root)[0] == 3


def test_work_folder_is_dropped(spark):
    from taskweave.session import stored, work_folder

    with work_folder(spark) as path:
        assert stored(spark.range(5)).count() == 5
        assert spark.read.parquet(f"{path}/*").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/*")


def test_documents_one_per_file(spark):
    """The reader of one document per file gives the rows of the one-per-line export."""
    from taskweave.plans.files import verdict_files
    from taskweave.sources import records as R

    lines = R.read_envelopes(spark, verdict_files(Tables(spark, SMALL))).limit(30).cache()
    folder = output_path(spark, "one-per-file")
    lines.select("body").coalesce(1).write.option("maxRecordsPerFile", 1).text(folder)
    docs = R.read_documents(spark, folder)
    assert docs.count() == 30 == docs.select("name").distinct().count()
    # The submission is read from the file name, which differs.
    kept = ["task_pos", "state", "owner", "task_name", "decision"]
    assert rows(R.verdict_rows(docs).select(*kept)) == rows(R.verdict_rows(lines).select(*kept))


def test_adaptive_execution_splits_a_hot_name(spark):
    """With thresholds at this size, the executed plan splits the hot key's partition."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key")
        keyed = spark.range(200_000, numPartitions=8).select("id", key)
        people = spark.range(3000).select(key, F.lit("only").alias("person"))
        got = J.one_person(keyed, "id", people)
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_missing_family_is_an_error(spark):
    from taskweave.operators.owners import latest_per_family

    cycles = Tables(spark, SMALL).r12_cycles.withColumn("family_id", F.lit("")).withColumn("task_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="stable task identity"):
        latest_per_family(cycles).collect()


def test_collapse_keeps_every_row(spark):
    t = Tables(spark, SMALL).r10_truth
    shown = G.collapse_by_task(t)
    assert shown.agg(F.sum("versions")).first()[0] == t.count()
    assert G.other_versions(t, shown).count() + shown.count() == t.count()


def test_filters_reach_the_scan(spark):
    t = Tables(spark, SMALL).events.where(S.date_range(F.to_date("ts"), "2024-01-03", "2024-01-09")).select("event_id")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_publishers_never_share_a_number(spark, monkeypatch):
    """Two that read the same latest number, and eight at once."""
    one = spark.createDataFrame([("accepted",)], "state string")
    root = output_path(spark, "race")
    with monkeypatch.context() as stale:
        stale.setattr(P, "highest_claim", lambda spark, root: 0)
        for _ in range(2):
            assert P.publish_if_reconciled(one, Q.check_partition(one), root)
    assert P.latest(spark, root)[0] == 2
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: P.claim(spark, root), range(24)))
    assert sorted(numbers) == list(range(3, 27))
    assert rows(P.read_published(spark, root)) == [("accepted",)]


def test_refresh_publishes_the_derived_rows(spark):
    from taskweave.plans import fragments as X
    from taskweave.plans.core import CURRENT, GATE_ONLY, tasks_of
    from taskweave.plans.truth import publish, refresh_truth

    t = Tables(spark, SMALL)
    root = output_path(spark, "truth-test")
    assert refresh_truth(t.r1_runs, t.r2_objects, root, X.NOW, X.CUT, CURRENT, GATE_ONLY, X.ERAS)
    assert rows(P.read_published(spark, root).select("id", "state")) == rows(publish(tasks_of(t)).select("id", "state"))


def test_counts_observed_on_the_write_stop_a_broken_build(spark, monkeypatch):
    """The checks come from the write of the tasks: a state that no rule declares is refused."""
    from taskweave.operators import provenance as V
    from taskweave.plans import fragments as X
    from taskweave.plans import truth
    from taskweave.plans.core import CURRENT, GATE_ONLY

    t = Tables(spark, SMALL)
    root = output_path(spark, "truth-broken")
    whole = truth.derive_tasks
    broken = lambda *args: whole(*args).withColumn("finalState", F.when(F.col("inScope"), F.lit("odd")).otherwise(F.col("finalState")))
    monkeypatch.setattr(truth, "derive_tasks", broken)
    assert not truth.refresh_truth(t.r1_runs, t.r2_objects, root, X.NOW, X.CUT, CURRENT, GATE_ONLY, X.ERAS)
    assert P.latest(spark, root) is None
    assert V.partition_failures({"headline": 1, "undecided": 1, "in_scope": 3, "undeclared_state": 0, "no_state": 1}) == {"partition": 1, "undeclared_state": 0, "no_state": 1}


def test_without_a_listing_earlier_answers_stand(spark):
    manifest = spark.createDataFrame([("a", "u", "f", "h"), ("b", "u", "f", "h")], "name string, source_uri string, folder string, object_hash string")
    previous = spark.createDataFrame([("a", "moved", "2026-09-01")], "name string, state string, checked_on string")
    got = D.live_check(manifest, None, previous, F.current_date()).select("name", "live_state", "live_checked_on")
    assert rows(got) == [("a", "moved", "2026-09-01"), ("b", None, None)]


def test_work_left_is_all_that_is_open(spark):
    wanted = spark.range(10).select(F.col("id").alias("key"))
    known = spark.createDataFrame([(1,), (2,)], "key long")
    misses = spark.createDataFrame([(3, "2026-09-01"), (4, "2026-09-30")], "key long, checked_on string").withColumn("checked_on", F.to_date("checked_on"))
    todo = J.work_left(wanted, known, misses, F.lit("2026-10-01").cast("date"), 7)
    assert rows(todo) == [(0,), (3,), (5,), (6,), (7,), (8,), (9,)]


def test_a_hot_name_on_both_sides_stays_linear(spark):
    """A name that holds most rows and most audited tasks: no pairs, all rows kept."""
    n = 20000
    hot = F.when(F.col("id") % 3 > 0, F.lit("one-name-for-most-of-the-work"))
    truth = spark.range(n).select(
        F.concat(F.lit("family:"), F.col("id").cast("string")).alias("id"), F.coalesce(hot, F.concat(F.lit("task-"), F.col("id").cast("string"))).alias("name"), F.lit("v").alias("source")
    )
    audit = spark.range(n).select(F.col("id").alias("pos"), F.coalesce(hot, F.concat(F.lit("other-"), F.col("id").cast("string"))).alias("task"))
    delivered, audited = D.join_delivered(audit, truth)
    assert rows(delivered.groupBy("method", "delivered_task").agg(F.count("*"))) == [(D.BY_NAME, "one-name-for-most-of-the-work", n - len(range(0, n, 3)))]
    assert [r["pos"] for r in audited.where("matched").collect()] == [1]


def test_one_person_with_a_hot_key(spark):
    keyed = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("key"))
    people = spark.range(30000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("key"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 2)).otherwise("only").alias("person"))
    got = J.one_person(keyed, "id", people).groupBy("named", "person").agg(F.count("*"))
    assert rows(got) == [("one", "only", 10000), ("several", None, 20000)]


def rows_read(df):
    """Rows that the scans of a query gave."""
    df.collect()

    def scans(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(plan.plan())
        if kind == "FileSourceScanExec":
            return plan.metrics().get("numOutputRows").get().value()
        return sum(scans(plan.children().apply(i)) for i in range(plan.children().size()))

    return scans(df._jdf.queryExecution().executedPlan())


def test_pages_far_in_read_one_part_or_two(spark):
    rows_in = spark.range(40_000).select(F.xxhash64("id").alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = O.StoredOrder(rows_in.repartition(8), ["key", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [tuple(r) for r in rows_in.orderBy("key", "id").collect()]
    for number in (0, 1, 77, 1999, 2000):
        assert [tuple(r) for r in order.page(number, 20).collect()] == want[20 * number : 20 * number + 20]
    parts = [n for _, n in order.sizes]
    assert len(parts) > 1
    cut = parts[0] // 20
    assert rows_read(order.page(cut, 20).select("id")) <= 2 * max(parts)
    assert O.page(rows_in, ["key", "id"], 3, 7).count() == 7


def test_a_listing_runs_its_joins_once(spark):
    """Sorting what is not found does not make it a second time for the sampled bounds."""
    times = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: times.add(1) or x, "long")
    traced = spark.range(500).select(seen("id").alias("pos"), F.lit(False).alias("found"), F.lit("gone").alias("reason"), F.lit("Batch 2.1").alias("batch"), F.lit("t").alias("task"))
    assert len(O.not_found_listing(traced).collect()) == 500
    assert times.value == 500


def test_trigram_search_equals_contains(spark, monkeypatch):
    """Terms in the middle, at the ends of texts and pages, of other case; and none at all."""
    monkeypatch.setattr(postings, "PAGE", 256)
    rows_in = spark.range(30_000).select("id", F.concat(F.lit("Folder/"), F.hex(F.xxhash64("id")), F.when(F.col("id") % 256 == 255, "/Last-ÉÉ").otherwise("/x")).alias("path")).coalesce(2)
    found = postings.Postings(rows_in, F.col("path"))
    for term in ("LAST-é", "folder/00", "abcd", "/x", "x", "no such", "0f3/x", "folder"):
        needle = term.lower()
        want = rows_in.where(F.lower("path").contains(needle)) if len(needle) >= 3 else rows_in.limit(0)
        assert rows(found.search(term)) == rows(want), term
    one = rows_in.where("id = 12345").first()["path"].split("/")[1].lower()
    assert 256 <= rows_read(found.candidates(one)) < 3000
    monkeypatch.setattr(postings, "NAMED", 3)
    assert rows(found.search("abc")) == rows(rows_in.where(F.lower("path").contains("abc")))


def test_only_changed_shards_are_written(spark):
    objects = spark.range(3000).select(F.concat(F.lit("a/"), F.col("id") % 40, F.lit("/"), F.col("id") % 7, F.lit("/f"), "id").alias("name"), (F.col("id") * 10).alias("size_bytes"))
    root = output_path(spark, "shards")
    assert E.sync_shards(E.folder_index(objects, 64), root) == sorted(r["shard"] for r in E.folder_index(objects, 64).select("shard").distinct().collect())
    assert E.sync_shards(E.folder_index(objects, 64), root) == []
    moved = objects.withColumn("size_bytes", F.when(F.col("name") == "a/3/6/f1203", 1).otherwise(F.col("size_bytes")))
    assert moved.exceptAll(objects).count() == 1
    changed = E.sync_shards(E.folder_index(moved, 64), root)
    # Bytes are those of files, so the file's own folder changes and no other.
    assert len(changed) == 1
    want = E.folder_index(moved, 64)
    got = E.read_shards(spark, root)
    assert rows(got.select(*want.columns)) == rows(want)
    assert rows(E.read_shards(spark, root, changed[0]).select(*want.columns)) == rows(want.where(F.col("shard") == changed[0]))
    gone = objects.where("name not like 'a/9/%'")
    E.sync_shards(E.folder_index(gone, 64), root)
    assert rows(E.read_shards(spark, root).select(*want.columns)) == rows(E.folder_index(gone, 64))


def test_unchanged_documents_are_not_opened(spark, tmp_path):
    """A second run opens none, a third the changed and new ones; gone ones go, broken ones wait for a change."""
    folder, root = tmp_path / "docs", output_path(spark, "verdicts-refreshed")
    folder.mkdir()
    body = lambda state: json.dumps({"schema": "verdict/v2", "state": state, "tasks": [{"task": "t"}]})
    for i in range(30):
        (folder / f"{i}.json").write_text("{broken" if i == 7 else body("accepted"))
    run = lambda: refresh.refresh_verdicts(refresh.list_documents(spark, str(folder)), refresh.open_files(spark, str(folder)), root)
    states = lambda: dict(map(tuple, P.read_published(spark, root).select("submission", "state").collect()))
    assert run() == 30 and states() == {str(i): "accepted" for i in range(30) if i != 7}
    version = P.latest(spark, root)
    # Other text under the same time would show if it were opened.
    stamp = os.stat(folder / "3.json")
    (folder / "3.json").write_text(body("rejected"))
    os.utime(folder / "3.json", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert run() == 0 and P.latest(spark, root) == version
    for name, text in (("7", body("queued")), ("30", body("error"))):
        (folder / f"{name}.json").write_text(text)
    os.utime(folder / "7.json", (2e9, 2e9))
    (folder / "5.json").unlink()
    assert run() == 2
    assert states() == {str(i): "accepted" for i in range(30) if i != 5} | {"7": "queued", "30": "error"}
    (folder / "6.json").unlink()
    assert run() == 0 and "6" not in states()
