"""Rule tables: input to label."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taskweave.functions import names as N
from taskweave.functions import packages as K
from taskweave.functions import runs as R


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} {t}" for k, (t, _v) in inputs.items()) or "x int"
    row = tuple(v for _t, v in inputs.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def text(spark, rule, raw):
    return value(spark, rule(F.col("c")), c=("string", raw))


@pytest.mark.parametrize(
    "raw, expected",
    [("  Harbor/Obi/Task-A ", "task-a"), ("obi/x", "x"), ("Mixed-Case", "mixed-case"), (None, None)],
)
def test_name_key(spark, raw, expected):
    assert text(spark, N.name_key, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("code-c24-unicode-bug-fixed-v5", "code-c24-unicode-bug"), ("gen-g980-as-built-audit-final", "gen-g980-as-built-audit"),
        ("law-l35-flow-down-clause", "law-l35-flow-down-clause"), ("a-20260918-copy-new-updated", "a"),
    ],
)
def test_norm_name(spark, raw, expected):
    assert text(spark, N.norm_name, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("harbor/task_verify_vip_account_8241_interest_fixed.zip", "verify-vip-account-8241-interest"),
        ("100601-august-2024-interest-calculation-payout-r-4457f3-v9", "august-2024-interest-calculation-payout-r"),
        ("audit-missing-due-dates-on-linked-bill-counterpa-8b8b51-v1", "audit-missing-due-dates-on-linked-bill-counterpa"),
    ],
)
def test_name_variants(spark, raw, expected):
    from taskweave.operators.owners import variant_rows

    assert expected in text(spark, N.name_variants, raw)
    rows = variant_rows(spark.createDataFrame([("r", raw)], "id string, n string")).collect()
    assert {r["key"] for r in rows} == set(text(spark, N.name_variants, raw))


def test_short_fragments_are_no_names(spark):
    assert text(spark, N.name_variants, "abc") == []


@pytest.mark.parametrize(
    "raw, expected",
    [("100601-august-2024-interest", "tt:100601"), ("ASTR_101554", "tt:astr_101554"), ("cb1_22-x", "tt:cb1_22"), ("plain", None)],
)
def test_tracker_key(spark, raw, expected):
    assert text(spark, N.tracker_key, raw) == expected


@pytest.mark.parametrize(
    "name, label",
    [
        ("09-25-Batch5.1", "Batch 5.1"), ("09-29 Batch 9.1", "Batch 9.1"), ("10-02 Batch 12.1", "Batch 12.1"), ("09-27 Batch1 CompanyBench 267", "CompanyBench 1"),
        ("[Deprecated] 09-25 Batch5.1 - Partial v1", None), ("08-14-Shipment-V2", None), ("Meta - 0919", None), ("08-28", None), ("EKWBench-0908-Batch1-223", None),
    ],
)
def test_batch_label(spark, name, label):
    assert value(spark, K.batch_label(F.col("c"))["label"], c=("string", name)) == label


@pytest.mark.parametrize(
    "path, expected",
    [
        ("Non-Connector/Harder/Legal/x.zip", ["Non-Connector", "Harder", "Legal", "x.zip"]),
        ("harder/non-connector/engineering/x.zip", ["non-connector", "engineering", "x.zip"]),
        ("wrap/harder/non-connector/engineering/x.zip", ["non-connector", "harder", "Engineering", "x.zip"]),
        ("Computer Bench (NC 39 RC 0 S 99)/Synthetic 99/Easier 34/x.zip", ["Synthetic", "Easier 34", "x.zip"]),
        ("Company Bench Zeta/z.zip", ["Company Bench Zeta", "z.zip"]),
    ],
)
def test_package_parts(spark, path, expected):
    assert text(spark, K.package_parts, path) == expected


@pytest.mark.parametrize(
    "image, bench",
    [
        ("reg/ASTER:1", "company bench aster"), ("real-data-v4", "company bench aster"), ("x/real-data:2", "computer bench real"), ("connectors-rl-gym/base-image", "computer bench synth"),
        ("connectors-rl-gym/base-image@sha256:" + K.ZETA_DIGESTS[0], "company bench zeta"), ("company-bench-private@" + K.SYNTHETIC_DIGESTS[0], "computer bench synth"),
        ("company-bench-private:1", "company bench zeta"), ("connectors-harness", "computer bench synth"), ("python:3", None), ("", None), (None, None),
    ],
)
def test_bench_of_image(spark, image, bench):
    assert text(spark, K.bench_of_image, image) == bench


@pytest.mark.parametrize(
    "toml, connector, services",
    [
        ("mcp_servers = []", False, []), ('[[environment.mcp_servers]]\nname = "b-gym"\n[[mcp_servers]]\nname = "a-gym"\n[x]\nname = "no"', True, ["a-gym", "b-gym"]),
        ('mcp_servers = ["x-gym"]', True, ["x-gym"]), ("[task]", False, []), ("# mcp_servers later", None, []),
    ],
)
def test_connector_facts(spark, toml, connector, services):
    fact = value(spark, K.connector_facts(F.col("c")), c=("string", toml))
    assert (fact["connector"], fact["services"]) == (connector, services)


def test_from_image_skips_flags_and_byte_order_mark(spark):
    assert text(spark, K.from_image, "﻿FROM --platform=linux/amd64 reg/x:1\nRUN y") == "reg/x:1"


def test_declared_name_is_the_task_tables_own(spark):
    assert text(spark, K.declared_task_name, '[meta]\nname = "a"\n[task]\nversion = 1\nname = "b"\n[c]\nname = "d"') == "b"
    assert text(spark, K.declared_task_name, '[task]\nversion = 1\n[c]\nname = "d"') is None


@pytest.mark.parametrize(
    "code, family, tag",
    [
        ("HARBOR-CHECK-12", "HARBOR-CHECK", "HARBOR-CHECK-12"), ("GATE-ORACLE-REJECTED", "GATE-ORACLE-REJECTED", "GATE-ORACLE-REJECTED"),
        ("l1.realism_leakage:8653e0930c22420b", "l1.realism_leakage", "l1.realism_leakage"),
    ],
)
def test_normalise_finding(spark, code, family, tag):
    assert tuple(value(spark, R.normalise_finding(F.col("c")), c=("string", code))) == (family, tag)


@pytest.mark.parametrize(
    "decision, state, hours_ago, at_bar, gate_only, anywhere, final",
    [
        ("accepted", "", 9, True, False, True, "accepted"), ("accepted", "", 0.2, False, False, False, "accepted"), ("", "accepted", 9, False, True, True, "legacy accepted"),
        ("accepted", "", None, False, False, False, "legacy accepted"), ("rejected", "error", 9, True, False, True, "rejected"), ("", "queued", 9, False, False, False, "queued"),
        (None, None, 9, False, False, False, "no QC decision"),
    ],
)
def test_derive_state(spark, decision, state, hours_ago, at_bar, gate_only, anywhere, final):
    now = dt.datetime(2026, 10, 1, 12)
    at = None if hours_ago is None else now - dt.timedelta(hours=hours_ago)
    rule = R.derive_state(F.col("d"), F.col("s"), F.col("a"), F.lit(at_bar), F.lit(gate_only), F.lit(anywhere), F.lit(now))
    assert value(spark, rule["finalState"], d=("string", decision), s=("string", state), a=("timestamp", at)) == final


@pytest.mark.parametrize(
    "email, person", [("a@x.com", True), ("bot@p.iam.gserviceaccount.com", False), ("dev@localhost", False), ("companybench@x.com", False), ("nobody", False), (None, False)]
)
def test_is_person(spark, email, person):
    assert text(spark, N.is_person, email) is person


def test_gate_eras_are_as_of(spark):
    from taskweave.operators.state import gate_era

    for when, label in [("2026-09-01 00:00:00", "Opus gate"), ("2026-09-15 03:40:49", "KESTREL on"), ("2026-09-16 05:06:53", "KESTREL on"), ("2026-10-01 00:00:00", "KESTREL full")]:
        assert value(spark, gate_era(F.lit(when).cast("timestamp"), R.GATE_ERAS)) == label


def test_texts_beyond_former_bounds(spark):
    """No text or list is cut at a length."""
    from taskweave.functions.packages import connector_facts, package_parts
    from taskweave.operators.owners import console_status

    long = "x" * 1500
    rows = spark.createDataFrame([(long, f"{next(iter(K.CLASSES))}/easier/" + "y" * 1_100_000 + "/a.zip")], "state string, path string")
    got = rows.select(F.length(console_status(F.col("state"))).alias("n"), F.length(package_parts(F.col("path"))[2]).alias("m")).first()
    assert (got["n"], got["m"]) == (1500, 1_100_000)
    assert connector_facts(F.lit("")) is not None
