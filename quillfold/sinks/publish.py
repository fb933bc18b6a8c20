"""Sinks: stage tables, guarded replacement, and publish policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import beside

# Fixed values
PARTIAL_BELOW = 0.7
PUBLISH_BELOW = 0.9
PROTECT_ABOVE = 100


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a stage table. Read-modify-write of one path must go through a new folder."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def cache_verdict(interrupted: Column, shortfall: Column, existing: Column, fresh: Column) -> Column:
    """Why a harvest is only partial, or NULL when it may replace the cache."""
    return (
        F.when(interrupted, "interrupted")
        .when(shortfall, "a keyword came back short")
        .when((existing > PROTECT_ABOVE) & (fresh < existing * PARTIAL_BELOW), "far smaller than the cache")
    )


def merge_harvest(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Upsert by key, fresh rows win, rows without a key are dropped."""
    new = fresh.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").dropDuplicates([key])
    old = existing.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_or_replace(
    existing: DataFrame, fresh: DataFrame, key: str, interrupted: bool = False, shortfall: bool = False
) -> DataFrame:
    """Fresh rows alone after a complete pass, otherwise the upsert. The verdict is part of the plan."""
    counts = beside(existing.agg(F.count("*").alias("_existing")), fresh.agg(F.count("*").alias("_fresh")))
    verdict = counts.select(
        cache_verdict(F.lit(interrupted), F.lit(shortfall), F.col("_existing"), F.col("_fresh")).alias("partial_reason")
    )
    new = fresh.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").dropDuplicates([key])
    merged = merge_harvest(existing, fresh, key).join(new.select(key, F.lit(True).alias("_new")), key, "left")
    return (
        beside(merged, verdict)
        .filter(F.col("_new") | F.col("partial_reason").isNotNull())
        .drop("_new")
    )


def publish_verdict(blocked: Column, fresh: Column, existing: Column) -> tuple[Column, Column]:
    """(publish, reason): refuse only when sources are blocked and a real list shrank too far."""
    floor = F.round(existing * PUBLISH_BELOW)
    refuse = (blocked > 0) & (existing > PROTECT_ABOVE) & (fresh < floor)
    reason = (
        F.when(blocked == 0, "every source reported in")
        .when(existing <= PROTECT_ABOVE, "no meaningful previous list to protect")
        .when(refuse, "blocked sources and a much smaller harvest")
        .otherwise("blocked sources but the list survived")
    )
    return ~refuse, reason


def publish_guard(source_status: DataFrame, fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """One row ``blocked, fresh, existing, publish, reason`` for the caller to act on."""
    blocked = source_status.agg(F.count_if(F.col("status").isin("blocked", "error")).alias("blocked"))
    one = beside(beside(blocked, fresh.agg(F.count("*").alias("fresh"))), existing.agg(F.count("*").alias("existing")))
    publish, reason = publish_verdict(F.col("blocked"), F.col("fresh"), F.col("existing"))
    return one.select("*", publish.alias("publish"), reason.alias("reason"))
