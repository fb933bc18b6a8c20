"""Register statistics, contracts, and how texts hold or break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stylometry import scalars

# Fixed values
MIN_DOCS = 5
MIN_WORDS = 3000
TOLERANCE_SD = 2.0
LEAK_SD = 1.5


def register_stats(features: DataFrame, registers: DataFrame) -> DataFrame:
    """``register, feature, n, mean, sd, min, max, documents, words, underpowered`` (all registers appear).

    ``features`` carries ``register`` and ``word_count``; unmeasured values do not count.
    """
    finite = scalars(features, ["register", "_k"] if "_k" in features.columns else ["register"]).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    per_feature = finite.groupBy("register", "feature").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    size = features.groupBy("register").agg(F.count("*").alias("documents"), F.sum("word_count").alias("words"))
    powered = registers.select("register").join(size, "register", "left").select(
        "register",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("words", F.lit(0)).alias("words"),
    )
    powered = powered.withColumn("underpowered", (F.col("documents") < MIN_DOCS) | (F.col("words") < MIN_WORDS))
    return powered.join(per_feature, "register", "left")


def register_contracts(stats: DataFrame, tolerance: float = TOLERANCE_SD) -> DataFrame:
    """``register, feature, mean, sd, low, high`` for registers with enough text."""
    return stats.filter(~F.col("underpowered") & F.col("mean").isNotNull()).select(
        "register",
        "feature",
        "mean",
        "sd",
        (F.col("mean") - tolerance * F.col("sd")).alias("low"),
        (F.col("mean") + tolerance * F.col("sd")).alias("high"),
    )


def z_scores(features: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """``key, against, feature, value, mean, sd, z``: every document against every contract."""
    bands = contracts.filter("sd <> 0").select(F.col("register").alias("against"), "feature", "mean", "sd")
    return (
        scalars(features, [key])
        .filter(F.col("value").isNotNull())
        .join(bands, "feature")
        .withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
    )


def _fits(z: DataFrame, key: str) -> DataFrame:
    return z.groupBy(key, "against").agg(
        F.avg(F.abs("z")).alias("fit"),
        F.count_if(F.abs("z") > TOLERANCE_SD).alias("violations"),
        F.max_by(F.when(F.abs("z") > TOLERANCE_SD, F.col("feature")), F.abs("z")).alias("worst_feature"),
    )


def nearest_register(features: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """``key, nearest``: contract with the smallest mean |z|."""
    fits = _fits(z_scores(features, contracts, key), key)
    return fits.groupBy(key).agg(F.min_by("against", F.struct("fit", "against")).alias("nearest"))


def validate_contract(features: DataFrame, contracts: DataFrame, key: str, requested: str = "requested") -> DataFrame:
    """``key, requested, ok, nearest, fit, violations, worst_feature``.

    ok means no feature beyond tolerance and the requested register is also the nearest. A register
    without a contract passes with a NULL fit.
    """
    fits = _fits(z_scores(features, contracts, key), key)
    nearest = fits.groupBy(key).agg(F.min_by("against", F.struct("fit", "against")).alias("nearest"))
    own = fits.withColumnRenamed("against", requested)
    has = contracts.select(F.col("register").alias(requested), F.lit(True).alias("_has")).distinct()
    joined = (
        features.select(key, requested).join(has, requested, "left").join(own, [key, requested], "left").join(nearest, key, "left")
    )
    return joined.select(
        key,
        requested,
        F.when(F.col("_has"), (F.coalesce("violations", F.lit(0)) == 0) & F.col("nearest").eqNullSafe(F.col(requested)))
        .otherwise(True)
        .alias("ok"),
        F.when(F.col("_has"), F.col("nearest")).alias("nearest"),
        F.round("fit", 3).alias("fit"),
        F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        "worst_feature",
    )


def marker_leaks(features: DataFrame, contracts: DataFrame, key: str, requested: str = "requested", threshold: float = LEAK_SD) -> DataFrame:
    """Features beyond ``threshold`` sd of the requested register's contract."""
    wanted = features.select(key, F.col(requested).alias("against"))
    return (
        z_scores(features, contracts, key)
        .join(wanted, [key, "against"])
        .filter(F.abs("z") > threshold)
        .select(key, F.col("against").alias(requested), "feature", "value", "mean", "sd", F.round("z", 2).alias("z"))
    )


def contract_compliance(validated: DataFrame, arm: str = "arm") -> DataFrame:
    return validated.groupBy(arm).agg(
        F.count_if("ok").alias("passed"),
        F.count("*").alias("total"),
        F.count_if("retried").alias("retried"),
        F.avg("fit").alias("mean_fit"),
    )


def bleed_matrix(outputs: DataFrame) -> DataFrame:
    """Hold and bleed rates per (requested, exemplar) cell of a crossed design."""
    held = F.col("nearest").eqNullSafe(F.col("requested"))
    bled = ~held & F.col("nearest").eqNullSafe(F.col("exemplar"))
    return outputs.groupBy("requested", "exemplar").agg(
        F.count("*").alias("n"),
        (F.count_if(held) / F.count("*")).alias("hold_rate"),
        (F.count_if(bled) / F.count("*")).alias("bleed_rate"),
    )


def worst_leaks(leaks: DataFrame, cells: list[str]) -> DataFrame:
    """Worst instance per cell and feature, by |z|."""
    return leaks.groupBy(*cells, "feature").agg(F.max_by("z", F.struct(F.abs("z"), "z")).alias("worst_z"))


def worst_bleed(matrix: DataFrame) -> DataFrame:
    off = matrix.filter("requested <> exemplar")
    return off.agg(F.max("bleed_rate").alias("worst_bleed"), (F.max("bleed_rate") <= 0.1).alias("passes"))
