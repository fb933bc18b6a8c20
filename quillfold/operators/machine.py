"""Workflow states and the guards on moving between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The state vocabulary in workflow order, terminal states, and older spellings.
STATES = (
    "DISCOVERED", "ELIGIBILITY_CHECKED", "ACCOUNT_NEEDED", "AUTHENTICATED", "FORM_MAPPED", "ANSWERS_READY",
    "REVIEW_REQUIRED", "SUBMITTED", "AWAITING_RESULT", "WON", "LOST", "DISQUALIFIED",
)
TERMINAL = ("WON", "LOST", "DISQUALIFIED")
LEGACY = {
    "discovered": "DISCOVERED",
    "verified": "DISCOVERED",
    "eligible": "ELIGIBILITY_CHECKED",
    "prioritized": "ELIGIBILITY_CHECKED",
    "prepared": "FORM_MAPPED",
    "needs-review": "REVIEW_REQUIRED",
    "submitted": "SUBMITTED",
    "confirmed": "AWAITING_RESULT",
    "won/rejected": "AWAITING_RESULT",
}
STATUS_TO_LEGACY = {
    "research": "discovered",
    "future": "discovered",
    "apply": "discovered",
    "applied": "submitted",
    "pending": "confirmed",
    "won": "won/rejected",
    "rejected": "won/rejected",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.coalesce(key, F.lit("")))


def canonical_state(state: Column) -> Column:
    """A known state as is, an older spelling translated, anything else DISCOVERED."""
    return F.when(state.isin(*STATES), state).otherwise(F.coalesce(_lookup(LEGACY, state), F.lit("DISCOVERED")))


def canonical_state_of(canonical: Column, workflow: Column, status: Column) -> Column:
    """Best available state of a listing: canonical, else workflow, else its display status."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    return canonical_state(F.coalesce(filled(canonical), filled(workflow), _lookup(STATUS_TO_LEGACY, status), F.lit("discovered")))


def can_advance(state: Column, target: Column, evidence: Column, artifacts: Column) -> tuple[Column, Column]:
    """(ok, reason) of a proposed transition; ``artifacts`` is an array of (kind, verified)."""
    current = F.when(state.isin(*STATES), state).otherwise("DISCOVERED")
    proven = F.exists(
        F.coalesce(artifacts, F.array().cast("array<struct<kind:string,verified:boolean>>")),
        lambda a: (a["kind"] == "award-notice") & F.coalesce(a["verified"], F.lit(False)),
    )
    label = F.concat(F.substring(current, 1, 1), F.lower(F.replace(F.substring(current, 2, 40), F.lit("_"), F.lit(" "))))
    reason = (
        F.when(~F.coalesce(target.isin(*STATES), F.lit(False)), "Unknown workflow state.")
        .when(current.isin(*TERMINAL), F.concat(label, F.lit(" is terminal.")))
        .when((target == "ELIGIBILITY_CHECKED") & ~evidence.eqNullSafe(F.lit("verified")), "Verify eligibility from the official rules first.")
        .when((target == "SUBMITTED") & (current != "REVIEW_REQUIRED"), "Every application must reach review before submission.")
        .when((target == "SUBMITTED") & evidence.eqNullSafe(F.lit("disqualified")), "Disqualified opportunities cannot be submitted.")
        .when((target == "WON") & ~proven, "WON requires a verified award-notice artifact.")
    )
    return reason.isNull(), reason
