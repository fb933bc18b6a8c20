"""Win rates from resolved award notices, and deadlines of open applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machine import TERMINAL

MIN_SAMPLE = 5
AWARD_REVIEW = "AWARD_NOTICE_REVIEW"


def outcome_facts(resolved: DataFrame, applications: DataFrame) -> DataFrame:
    """Award reviews with the source and effort of their application; missing means unknown."""
    facts = applications.select("application_id", "source", "effort")
    return (
        resolved.filter((F.col("checkpoint_type") == AWARD_REVIEW) & F.col("resolution").isin("verified_win", "not_a_win"))
        .join(facts, "application_id", "left")
        .withColumn("source", F.coalesce("source", F.lit("unknown")))
        .withColumn("effort", F.coalesce("effort", F.lit("unknown")))
    )


def outcome_buckets(facts: DataFrame) -> DataFrame:
    wins = F.count_if(F.col("resolution") == "verified_win")
    return facts.groupBy("source", "effort").agg(
        wins.alias("wins"), F.count("*").alias("total"), (wins / F.count("*")).alias("rate")
    )


def realised_rate(listings: DataFrame, buckets: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Add ``realised_rate``: NULL below the sample-size guard."""
    rates = buckets.select("source", "effort", F.when(F.col("total") >= min_sample, F.col("rate")).alias("realised_rate"))
    return listings.withColumn("effort", F.coalesce("effort", F.lit("med"))).join(rates, ["source", "effort"], "left")


def due_bucket(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 7, "this_week").when(days <= 30, "this_month").otherwise("later")


def deadline_digest(applications: DataFrame, today: Column, window_days: int = 30) -> DataFrame:
    """Open applications due within the window, overdue included, soonest first."""
    days = F.datediff("deadline_iso", today)
    open_apps = applications.filter(F.col("deadline_iso").isNotNull() & ~F.col("workflow_state").isin(*TERMINAL))
    return (
        open_apps.withColumn("days_remaining", days)
        .filter(F.col("days_remaining") <= window_days)
        .withColumn("due", due_bucket(F.col("days_remaining")))
        .orderBy("days_remaining", "application_id")
    )
