"""Rebuild of all projections from the log, and the adjudication pass over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import eventlog
from ..operators.checkpoints import checkpoint_id
from ..operators.eligibility import Profile, screen_eligibility


class BrokenChain(ValueError):
    """The log does not verify, so nothing may be derived from it."""


def rebuild(log: DataFrame, block: int = eventlog.SEAL_BLOCK) -> dict[str, DataFrame]:
    """Verify the chain, then fold every projection. Raises on the first broken link."""
    verdict = eventlog.verify_chain(log, block).first()
    if not verdict["ok"]:
        raise BrokenChain(f"seq {verdict['broken_at']}: {verdict['reason']}")
    return {
        "applications": eventlog.fold_applications(log),
        "artifacts": eventlog.application_artifacts(log),
        "checkpoints": eventlog.open_checkpoints(log),
        "resolved": eventlog.resolved_checkpoints(log),
        "operations": eventlog.operation_states(log),
    }


def adjudicate(applications: DataFrame, texts: DataFrame, profile: Profile) -> DataFrame:
    """Screen every application without a decision.

    Adds ``outcome`` (skipped, passed, disqualified, ambiguous), the verdict, the state to move to,
    and for ambiguous ones the id of the checkpoint to raise.
    """
    joined = applications.join(texts, "application_id", "left").withColumnRenamed("decision", "had")
    judged = screen_eligibility(joined, profile, "text")
    settled = F.col("had") != "unscreened"
    outcome = (
        F.when(settled, "skipped")
        .when(F.col("decision") == "pass", "passed")
        .otherwise(F.col("decision"))
    )
    return judged.withColumn("outcome", outcome).select(
        "application_id",
        "outcome",
        F.when(~settled, F.col("rule")).alias("rule"),
        F.when(~settled, F.col("reason")).alias("reason"),
        F.when(F.col("outcome") == "passed", "ELIGIBILITY_CHECKED").when(F.col("outcome") == "disqualified", "DISQUALIFIED").alias("new_state"),
        F.when(F.col("outcome") == "ambiguous", checkpoint_id(F.lit("ELIGIBILITY_AMBIGUOUS"), F.col("application_id"), F.lit(""))).alias("checkpoint_id"),
    )
