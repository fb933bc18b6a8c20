"""Funding gaps, credit progress and token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices per million tokens by tier, and the routing rule.
PRICES = {"standard": (1.0, 5.0), "premium": (3.0, 15.0)}
DEFAULT_MODEL = "standard"
PREMIUM_MODEL = "premium"
HIGH_VALUE = 7500
BATCH_TOKENS = 700


def funding_gap(periods: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Cost, funding and gap per school and period, with school and overall totals.

    The multiplier applies to rows marked ``adjusts``. One rollup gives all levels; total rows have
    NULL in the rolled-up column.
    """
    cost = F.round(F.col("cost") * F.when(F.col("adjusts"), F.lit(multiplier)).otherwise(1.0))
    aid = F.col("grant") + F.col("other")
    rows = periods.select(
        "school", "period", cost.alias("cost"), aid.alias("aid"), F.least(cost, aid).alias("funded"), F.greatest(F.lit(0.0), cost - aid).alias("gap")
    )
    return rows.rollup("school", "period").agg(
        F.sum("cost").alias("cost"), F.sum("aid").alias("aid"), F.sum("funded").alias("funded"), F.sum("gap").alias("gap")
    )


def overall_gap(totals: DataFrame, won: float = 0.0) -> DataFrame:
    """The one overall gap: surplus of one period helps another, unlike the sum of gaps."""
    grand = totals.filter("school IS NULL AND period IS NULL")
    return grand.select("cost", (F.col("aid") + won).alias("funded"), F.greatest(F.lit(0.0), F.col("cost") - F.col("aid") - won).alias("gap"))


def credit_progress(periods: DataFrame) -> DataFrame:
    """Completed credits that count and that do not, from nested courses, outside finished periods."""
    courses = periods.filter("status <> 'completed'").select(F.explode("courses").alias("c")).filter("c.status = 'completed'")
    counts = F.coalesce(F.col("c.counts"), F.lit(True))
    return courses.agg(
        F.coalesce(F.sum(F.when(counts, F.col("c.credits"))), F.lit(0)).cast("long").alias("counted"),
        F.coalesce(F.sum(F.when(~counts, F.col("c.credits"))), F.lit(0)).cast("long").alias("optional"),
    )


def pick_model(priority: Column, amount: Column) -> Column:
    rich = F.coalesce(priority == "critical", F.lit(False)) | (F.coalesce(amount, F.lit(0)) >= HIGH_VALUE)
    return F.when(rich, PREMIUM_MODEL).otherwise(DEFAULT_MODEL)


def token_cost(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    """US dollars of one call; an unknown model is charged the default price."""

    def price(i: int) -> Column:
        out = F.lit(PRICES[DEFAULT_MODEL][i])
        for name, prices in PRICES.items():
            out = F.when(model == name, F.lit(prices[i])).otherwise(out)
        return out

    million = F.lit(1e6)
    return F.coalesce(input_tokens, F.lit(0)) / million * price(0) + F.coalesce(output_tokens, F.lit(0)) / million * price(1)


def estimate_batch_cost(listings: DataFrame) -> DataFrame:
    model = pick_model(F.col("priority"), F.col("amount"))
    return listings.agg(F.sum(token_cost(F.lit(BATCH_TOKENS), F.lit(BATCH_TOKENS), model)).alias("usd"), F.count("*").alias("listings"))
