"""Containment of strings in strings as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the pieces that meet.
PIECE = 4


def _pieces(text: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def contained(hay: DataFrame, needles: DataFrame, size: int = PIECE) -> DataFrame:
    """``hay, needle``: the pairs of distinct strings in ``hay`` (hay) and ``needles`` (needle) where the one holds the other.

    A needle meets the strings that hold its rarest piece of ``size`` letters (a shorter needle, all of itself), and only
    those are searched. An empty needle is in every string.
    """
    hay, needles = hay.select("hay").distinct(), needles.select("needle").distinct()
    cut = F.least(F.length("needle"), F.lit(size))
    lengths = [r[0] for r in needles.select(cut).distinct().collect()]  # size + 1 values at most
    parts = [F.array(F.lit("")) if n == 0 else F.when(F.length("hay") >= n, _pieces(F.col("hay"), n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    if not parts:
        return hay.join(needles, F.lit(False))
    held = hay.select("hay", F.explode(F.concat(*parts)).alias("piece"))
    common = held.groupBy("piece").agg(F.count("*").alias("df"))
    asked = needles.select("needle", F.explode(F.when(cut == 0, F.array(F.lit(""))).otherwise(_pieces(F.col("needle"), cut))).alias("piece"))
    times = F.coalesce("df", F.lit(0))
    rarest = asked.join(common, "piece", "left").groupBy("needle").agg(F.min(times).alias("least"), F.min_by("piece", times).alias("piece")).filter("least > 0")
    return held.join(rarest.select("needle", "piece"), "piece").filter(F.contains(F.col("hay"), F.col("needle"))).select("hay", "needle")


def beginning_with(texts: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """``texts`` joined to the rows of ``prefixes`` (pattern and more) whose pattern it begins with, in any case: one equi-join
    on the text cut to each length that a pattern has."""
    keyed = prefixes.withColumn("_p", F.lower("pattern"))
    lengths = sorted(r[0] for r in keyed.filter(F.col("_p").isNotNull()).select(F.length("_p")).distinct().collect())
    if not lengths:
        return texts.join(prefixes, F.lit(False))
    low = F.lower(F.col(column))
    cuts = F.filter(F.array(*[F.when(F.length(low) >= n, F.substring(low, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return texts.withColumn("_p", F.explode(cuts)).join(keyed, "_p").drop("_p")
