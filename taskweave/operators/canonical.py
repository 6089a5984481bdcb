"""Identity, canonical run and what is known of each identity's runs.

Winners come from aggregates (``max_by`` over a rank struct) or from a window
that keeps two rows per group, which Spark limits before the shuffle. A group
that holds a third of all rows therefore never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taskweave.functions import runs as R
from taskweave.functions.names import name_key

RANK = ["depth", "outcome", "decided_at_or_updated"]

# Why a run won.
ONLY_RUN = "only run"
BY_DEPTH = "further through the plan"
BY_OUTCOME = "better outcome at the same depth"
BY_INSTANT = "later decision, tied on progress and outcome"
BY_ORDER = "tied on every axis; first by sort order"


def with_identity(runs: DataFrame) -> DataFrame:
    """Runs with identity, method, confidence, decided day and rank columns."""
    ident = R.assign_identity(F.col("family_id"), F.col("task_id"), F.col("task_name"), F.col("owner"))
    depth = R.wave_depth(F.col("decision"), F.col("stage"), F.col("state"))
    return (
        runs.withColumn("_i", ident)
        .withColumn("_d", depth)
        .select(
            *runs.columns,
            "_i.*",
            "_d.*",
            R.outcome_rank(F.col("state")).alias("outcome"),
            F.col("decided_at").isNull().alias("decided_inferred"),
            R.decided_at(F.col("decided_at"), F.col("updated_at")).alias("decided_at_or_updated"),
            R.decided_day(F.col("decided_at"), F.col("updated_at")).alias("decided_day"),
        )
    )


def best_first(order: list[str], tie: str) -> Column:
    """A struct whose maximum is the best row; the smallest ``tie`` breaks ties."""
    return F.struct(*[F.col(c) for c in order], (-F.col(tie)).alias("_tie"))


def canonical_run(runs: DataFrame) -> DataFrame:
    """One run per identity: furthest, best outcome, latest; listing order on ties."""
    kept = [c for c in runs.columns if c != "identity"]
    return (
        runs.groupBy("identity")
        .agg(F.max_by(F.struct(*kept), best_first(RANK, "pos")).alias("w"))
        .select("identity", "w.*")
    )


def rank_runs(runs: DataFrame) -> DataFrame:
    """Winner, runner-up and the axis that decided, per identity."""
    order = [F.col(c).desc() for c in RANK] + [F.col("pos")]
    top_two = (
        runs.select("identity", "pos", *RANK)
        .withColumn("place", F.row_number().over(W.partitionBy("identity").orderBy(*order)))
        .where("place <= 2")
    )
    first, second = [
        F.max(F.when(F.col("place") == p, F.struct("pos", *RANK))).alias(n) for p, n in ((1, "w"), (2, "r"))
    ]
    reason = (
        F.when(F.col("r").isNull(), F.lit(ONLY_RUN))
        .when(F.col("w.depth") > F.col("r.depth"), F.lit(BY_DEPTH))
        .when(F.col("w.outcome") > F.col("r.outcome"), F.lit(BY_OUTCOME))
        .when(F.col("w.decided_at_or_updated") > F.col("r.decided_at_or_updated"), F.lit(BY_INSTANT))
        .otherwise(F.lit(BY_ORDER))
    )
    return (
        top_two.groupBy("identity")
        .agg(first, second)
        .select(
            "identity",
            F.col("w.pos").alias("winner"),
            F.col("r.pos").alias("runner_up"),
            reason.alias("canonical_reason"),
        )
    )


def identity_rollup(runs: DataFrame) -> DataFrame:
    """Counts and dates over every run of an identity."""
    says_accepted = F.coalesce(F.nullif(F.lower("decision"), F.lit("")), F.lower("state")) == "accepted"
    return runs.groupBy("identity").agg(
        F.count("*").alias("runs"),
        F.bool_or((F.lower("state") == "accepted") | (F.lower("decision") == "accepted")).alias("ever_accepted"),
        F.count_distinct("owner").alias("owners"),
        F.min("decided_day").alias("first_decided_day"),
        F.max("decided_day").alias("last_decided_day"),
        F.max(F.when(says_accepted, F.col("decided_at_or_updated"))).alias("accepted_at"),
    )


def identity_owners(runs: DataFrame) -> DataFrame:
    """Every owner of an identity, one row each."""
    return runs.where("owner is not null").select("identity", "owner").distinct()


def other_runs(runs: DataFrame, canonical: DataFrame) -> DataFrame:
    """The runs that did not win, one row each, none dropped."""
    winners = canonical.select("identity", F.col("pos").alias("winner"))
    return (
        runs.join(winners, "identity")
        .where("pos <> winner")
        .select("identity", "source", "state", "decision", "decided_day", "owner")
    )


def identity_findings(runs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Finding families per identity: on the canonical run, and on earlier ones only."""
    seen = runs.select("identity", "pos", F.explode("finding_codes").alias("raw")).select(
        "identity", "pos", R.normalise_finding(F.col("raw"))["family"].alias("family")
    )
    winners = canonical.select("identity", F.col("pos").alias("winner"))
    return (
        seen.join(winners, "identity")
        .groupBy("identity", "family")
        .agg(F.bool_or(F.col("pos") == F.col("winner")).alias("on_canonical"), F.bool_or(F.col("pos") != F.col("winner")).alias("on_other"))
    )


def identity_coverage(runs: DataFrame, packaged_names: DataFrame, cut: str) -> DataFrame:
    """What the identity ladder rests on, as (measure, value) rows.

    ``packaged_names`` has one ``key`` per task that has a package.
    """
    keyed = runs.withColumn("key", F.nullif(name_key(F.col("task_name")), F.lit("")))
    weak = F.col("method") != "family_id"
    by_method = keyed.groupBy("method").agg(
        F.count("*").alias("rows"), F.count_distinct("identity").alias("identities")
    )
    per_identity = keyed.groupBy("identity").agg(
        F.first("method").alias("method"),
        F.count_distinct("owner").alias("owners"),
        F.max("decided_day").alias("last_day"),
    )
    spread = per_identity.agg(
        F.count_if((F.col("method") == "family_id") & (F.col("owners") > 1)).alias("families_spanning_owners"),
        F.count_if(F.col("last_day") >= F.lit(cut).cast("date")).alias("in_scope_identities"),
        F.count_if(~F.coalesce(F.col("last_day") >= F.lit(cut).cast("date"), F.lit(False))).alias("legacy_identities"),
    )
    fused = (
        keyed.where("key is not null").groupBy("key").agg(F.count_distinct("identity").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("names_fusing_identities"))
    )
    packaged = packaged_names.select("key").distinct().withColumn("has_package", F.lit(True))
    rest = keyed.join(packaged, "key", "left").agg(
        F.count_if(weak).alias("weak_rows"),
        F.count_if(weak & F.col("has_package")).alias("weak_rows_with_package"),
        F.count_if("decided_inferred").alias("inferred_rows"),
    )

    def as_rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "measure", "value")

    methods = by_method.select("method", F.col("rows").alias("rows_by"), F.col("identities").alias("identities_by")).unpivot(
        ["method"], ["rows_by", "identities_by"], "measure", "value"
    )
    return (
        methods.select(F.concat_ws(":", "measure", "method").alias("measure"), "value")
        .unionByName(as_rows(spread))
        .unionByName(as_rows(fused))
        .unionByName(as_rows(rest))
    )


def scope_split(runs: DataFrame, cut: str) -> DataFrame:
    """Identities in scope and legacy, by their latest decision day."""
    latest = runs.groupBy("identity").agg(F.max("decided_day").alias("d"))
    in_scope = F.coalesce(F.col("d") >= F.lit(cut).cast("date"), F.lit(False))
    return latest.agg(F.count_if(in_scope).alias("in_scope"), F.count_if(~in_scope).alias("legacy"))
