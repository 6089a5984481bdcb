"""Rules over one review run: identity, progress, outcome, state, findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskweave.functions.names import blank_to_null, name_key

# How far each reported stage is through the plan.
STAGE_DEPTH = {
    "intake": 0, "oracle": 1, "presolve": 2, "gate": 3, "pre-qc": 4,
    "agent+e2b+modal": 5, "agent": 5, "e2b+modal": 5, "e2b": 5, "modal": 5,
    "escalate": 6, "post-gate": 7, "harbor-check": 8, "package": 9,
}
LAST_DEPTH = 9

# First review boundary, states and the wording of each rule.
SCOPE_CUT = "2026-09-05"
GRACE = "INTERVAL 30 MINUTES"
HEADLINE_STATES = ("accepted", "legacy accepted", "rejected", "running")
UNDECIDED_STATES = ("error", "no QC decision", "queued", "not started")
WHY_AT_BAR = "accepted and its package is in the current bar"
WHY_GRACE = "accepted within the grace window; package not written yet"
WHY_GATE_ONLY = "acceptance withdrawn: GLM-5.2 gate only, awaiting KESTREL re-gate"
WHY_RETIRED = "delivered only to a retired bar"
WHY_NO_PACKAGE = "accepted but no package delivered anywhere"
WHY_REJECTED = "reached a QC decision and failed it"
WHY_RUNNING = "in a stage, no decision yet"
WHY_QUEUED = "admitted, waiting on a slot"
WHY_ERROR = "parked or crashed before a decision"
WHY_UNDECIDED = "verdict reports a submission state only"

# Gate boundaries (label in force from that instant on).
GATE_ERAS = (
    ("", "Opus gate"),
    ("2026-09-13T20:05:59Z", "GLM-5.2 gate only"),
    ("2026-09-15T03:40:49Z", "KESTREL on"),
    ("2026-09-16T05:06:54Z", "KESTREL full"),
)

# Domains by name prefix.
DOMAINS = {
    "code": "Engineering", "fin": "Finance", "health": "Health",
    "law": "Legal", "gen": "Other", "bus": "Other",
}
PACKAGE_DOMAINS = {
    "code": "Engineering", "tech": "Engineering", "fin": "Finance",
    "health": "Health", "law": "Legal",
}
CATEGORIES = {
    "code": "Code", "fin": "Finance", "health": "Health",
    "law": "Law", "gen": "General", "bus": "Business",
}
CYCLE_STATUS = {
    "waiting_for_trainer_edit": "Rejected", "infrastructure_error": "Failed", "done": "Submitted",
    "running": "Running", "queued": "Queued", "cancelled": "Cancelled",
}
# Fixed value: words that name a banking connector.
CONNECTOR_WORDS = (
    r"(^|[-_])(ach|plaid|card|wire|check|debit|credit|bank|account|transfer|payment|bill|savings|ofac|kyc"
    r"|merchant|transaction)([-_]|$)"
)


def lookup(key: Column, table: dict) -> Column:
    """The value of ``key`` in a literal table, NULL when absent."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def decided_at(decided: Column, updated: Column) -> Column:
    return F.coalesce(decided, updated)


def decided_day(decided: Column, updated: Column) -> Column:
    """Calendar day of the decision; the update stands in when it is missing."""
    return F.to_date(decided_at(decided, updated))


def assign_identity(family: Column, task: Column, name: Column, owner: Column) -> Column:
    """(identity, method, confidence): the first rung that has a key."""
    fam, tsk = blank_to_null(family), blank_to_null(task)
    who = F.coalesce(blank_to_null(owner), F.lit("unowned"))

    def rung(key: Column, method: str, confidence: str) -> Column:
        return F.struct(
            key.alias("identity"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")
        )

    return (
        F.when(fam.isNotNull(), rung(F.concat(F.lit("family:"), fam), "family_id", "high"))
        .when(tsk.isNotNull(), rung(F.concat(F.lit("task:"), tsk), "task_id", "low"))
        .otherwise(
            rung(
                F.concat(F.lit("declared:"), F.coalesce(name_key(name), F.lit("")), F.lit("|"), who),
                "name+owner",
                "lowest",
            )
        )
    )


def wave_depth(decision: Column, stage: Column, state: Column) -> Column:
    """(depth, evidence): how far a run got and how that is known."""
    decided = F.lower(F.coalesce(decision, F.lit(""))).isin("accepted", "rejected")
    settled = F.lower(F.coalesce(state, F.lit(""))).isin("accepted", "rejected")
    reported = lookup(F.lower(F.trim(F.coalesce(stage, F.lit("")))), STAGE_DEPTH)

    def at(depth: Column, evidence: Column) -> Column:
        return F.struct(depth.cast("int").alias("depth"), evidence.alias("evidence"))

    return (
        F.when(decided, at(F.lit(LAST_DEPTH), F.lit("decided, so the plan completed")))
        .when(reported.isNotNull(), at(reported, F.concat(F.lit("reported stage '"), stage, F.lit("'"))))
        .when(settled, at(F.lit(LAST_DEPTH), F.lit("submission-level decision, no stage reported")))
        .otherwise(at(F.lit(0), F.lit("no stage reported")))
    )


def outcome_rank(state: Column) -> Column:
    s = F.lower(state)
    return (
        F.when(s == "accepted", 3).when(s == "rejected", 2).when(s.isin("running", "queued"), 1).otherwise(0)
    )


def derive_state(
    decision: Column,
    state: Column,
    accepted_at: Column,
    at_bar: Column,
    gate_only: Column,
    anywhere: Column,
    now: Column,
) -> Column:
    """(finalState, statePredicate): the first rule that holds names the state."""
    d, s = F.lower(decision), F.lower(state)
    says = lambda word: F.coalesce(d == word, F.lit(False)) | F.coalesce(s == word, F.lit(False))
    fresh = F.coalesce(accepted_at > now - F.expr(GRACE), F.lit(False))
    accepted = says("accepted")

    def is_(final: str, why: str) -> Column:
        return F.struct(F.lit(final).alias("finalState"), F.lit(why).alias("statePredicate"))

    return (
        F.when(accepted & at_bar, is_("accepted", WHY_AT_BAR))
        .when(accepted & fresh, is_("accepted", WHY_GRACE))
        .when(accepted & gate_only, is_("legacy accepted", WHY_GATE_ONLY))
        .when(accepted & anywhere, is_("legacy accepted", WHY_RETIRED))
        .when(accepted, is_("legacy accepted", WHY_NO_PACKAGE))
        .when(says("rejected"), is_("rejected", WHY_REJECTED))
        .when(s == "running", is_("running", WHY_RUNNING))
        .when(s == "queued", is_("queued", WHY_QUEUED))
        .when(s == "error", is_("error", WHY_ERROR))
        .otherwise(is_("no QC decision", WHY_UNDECIDED))
    )


def scope_flags(day: Column, first_day: Column, cut: Column) -> Column:
    """(inScope, carriedOver) against the cut day."""
    in_scope = F.coalesce(day >= cut, F.lit(False))
    return F.struct(
        in_scope.alias("inScope"),
        (F.coalesce(first_day < cut, F.lit(False)) & in_scope).alias("carriedOver"),
    )


def normalise_finding(code: Column) -> Column:
    """(family, code): drop an instance hash, group the numbered checks."""
    stripped = F.regexp_replace(code, r":[0-9a-f]{8,}$", "")
    numbered = F.upper(code).startswith("HARBOR-CHECK") & code.rlike(r"-\d+$")
    family = F.when(stripped != code, stripped).when(numbered, F.lit("HARBOR-CHECK")).otherwise(code)
    return F.struct(family.alias("family"), stripped.alias("code"))


def finding_families(codes: Column) -> Column:
    """Distinct finding families of one run's codes, sorted."""
    return F.array_sort(F.array_distinct(F.transform(codes, lambda c: normalise_finding(c)["family"])))


def domain_of(name: Column) -> Column:
    prefix = F.lower(F.substring_index(name, "-", 1))
    return F.coalesce(lookup(prefix, DOMAINS), F.lit("Not recorded"))


def one_domain(domain: Column) -> Column:
    """General and Business are folded into Other."""
    return F.when(domain.isin("General", "Business"), F.lit("Other")).otherwise(domain)


def domain_of_package(name: Column) -> Column:
    prefix = F.regexp_extract(F.lower(name), r"^([a-z]+)-", 1)
    return F.coalesce(lookup(prefix, PACKAGE_DOMAINS), F.lit("Other"))


def gate_hints(body: Column) -> Column:
    """Which gates the text of a verdict mentions."""
    text = F.lower(body)
    return F.struct(
        text.contains("glm-5.2").alias("glm52"),
        text.contains("kestrel").alias("kestrel"),
        text.contains("calibration").alias("calibration"),
        text.contains("oracle").alias("oracle"),
    )


def cycle_status(submission_status: Column, decision: Column, raw: Column) -> Column:
    """An explicit verdict beats the raw status; two that differ conflict."""
    explicit = F.array(
        F.lower(F.coalesce(submission_status, F.lit(""))), F.lower(F.coalesce(decision, F.lit("")))
    )
    yes, no = F.array_contains(explicit, "accepted"), F.array_contains(explicit, "rejected")
    r = F.lower(F.coalesce(raw, F.lit("")))
    spelled = F.initcap(F.replace(r, F.lit("_"), F.lit(" ")))
    return (
        F.when(yes & no, F.lit("Conflicting verdict"))
        .when(yes, F.lit("Accepted"))
        .when(no, F.lit("Rejected"))
        .otherwise(F.coalesce(lookup(r, CYCLE_STATUS), F.nullif(spelled, F.lit("")), F.lit("Unknown")))
    )


def task_type_of(recorded_type: Column, own_type: Column, name: Column) -> Column:
    """Connector or not: the recorded type, the row's own, then name rules."""
    lowered = F.lower(name)
    kinds = ("Connector", "Non-connector")
    return F.coalesce(
        recorded_type,
        F.when(own_type.isin(*kinds), own_type),
        F.when(lowered.rlike(CONNECTOR_WORDS), F.lit("Connector")),
        F.when(lowered.rlike(r"^(code|fin|health|law|gen|bus)-"), F.lit("Non-connector")),
        F.lit("Not recorded"),
    )


def category_of(name: Column, recorded_type: Column | None = None) -> Column:
    """The recorded category, else the one the name's prefix says."""
    lowered = F.lower(name)
    by_name = F.when(lowered.contains("-"), lookup(F.substring_index(lowered, "-", 1), CATEGORIES))
    given = F.lit(None).cast("string") if recorded_type is None else blank_to_null(recorded_type)
    usable = F.when(~given.isin("Unknown", "Connector", "Non-connector"), given)
    return F.coalesce(usable, by_name, F.lit("General"))
