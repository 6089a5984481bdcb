"""Runs and a listing to published tasks: the whole derivation as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from taskweave.functions import runs as R
from taskweave.operators import canonical as C
from taskweave.operators import provenance as P
from taskweave.operators import quality as Q
from taskweave.operators import state as S
from taskweave.session import stored
from taskweave.sinks.publish import publish_if_reconciled
from taskweave.sources.listings import read_object_listing


def derive_tasks(runs: DataFrame, member: DataFrame, now: str, cut: str, current: str, gate_only: str, eras=R.GATE_ERAS) -> DataFrame:
    """One row per identity: canonical run, roll-up, membership, state, scope.

    The winner and the roll-up come from a single aggregate over the runs, so
    the runs are shuffled once, after a partial aggregate.
    """
    ident = C.with_identity(runs)
    kept = [c for c in ident.columns if c != "identity"]
    says_accepted = F.coalesce(F.nullif(F.lower("decision"), F.lit("")), F.lower("state")) == "accepted"
    tasks = (
        ident.groupBy("identity")
        .agg(
            F.max_by(F.struct(*kept), C.best_first(C.RANK, "pos")).alias("w"),
            F.count("*").alias("runs"),
            F.bool_or((F.lower("state") == "accepted") | (F.lower("decision") == "accepted")).alias("ever_accepted"),
            F.min("decided_day").alias("first_decided_day"),
            F.max(F.when(says_accepted, F.col("decided_at_or_updated"))).alias("accepted_at"),
        )
        .select("identity", "w.*", "runs", "ever_accepted", "first_decided_day", "accepted_at")
    )
    return S.derive_states(S.join_membership(tasks, member, current, gate_only), now, cut, eras)


def publish(tasks: DataFrame) -> DataFrame:
    """In-scope tasks with their duplicate flags, in the published columns."""
    flagged = P.flag_duplicates(tasks).where("inScope")
    return flagged.select(
        F.col("identity").alias("id"),
        F.col("task_name").alias("name"),
        F.col("finalState").alias("state"),
        F.col("statePredicate").alias("why"),
        "owner",
        F.col("decided_day").alias("decided"),
        "decided_inferred",
        "runs",
        F.col("carriedOver").alias("carried_over"),
        F.col("at_bar").alias("at_current_bar"),
        "gate_only",
        "gate_era",
        R.domain_of(F.col("task_name")).alias("domain"),
        R.finding_families(F.col("finding_codes")).alias("findings"),
        "confidence",
        (F.col("method") != "family_id").alias("unmerged"),
        "possible_duplicate",
        "duplicate_siblings",
        "duplicate_tier",
        "source",
    )


def refresh_truth(runs: DataFrame, objects: DataFrame, root: str, now: str, cut: str, current: str, gate_only: str, eras=R.GATE_ERAS) -> bool:
    """Derive, check and publish; the previous version stays when a check fails.

    The derived tasks are stored once, and what the checks count is observed while they are
    written; the duplicate flags and the published rows read them.
    """
    member = S.membership(read_object_listing(objects))
    seen = Observation("tasks")
    derived = derive_tasks(runs, member, now, cut, current, gate_only, eras)
    tasks = stored(derived.observe(seen, *P.partition_counts()), "tasks")
    rows = publish(tasks)
    repeated = Q.check_unique(rows, ["id"]).agg(F.lit("one row per identity").alias("check"), F.count("*").alias("failures"))
    failures = runs.sparkSession.createDataFrame(list(P.partition_failures(seen.get).items()), "check string, failures bigint")
    return publish_if_reconciled(rows, failures.unionByName(repeated), root)
