"""Ranks over very large groups without putting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = 1024


def rank_by_draw(
    df: DataFrame, group: list[str], draw_col: str, key: str, out: str = "rank", buckets: int = BUCKETS
) -> DataFrame:
    """1-based rank of ``draw_col`` (uniform in [0,1)) within ``group``, plus ``group_size``.

    The draw is cut into equal slices: a rank inside the slice plus the number of rows in earlier
    slices. Only the slice counts (at most ``buckets`` rows per group) see a group-wide window.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(draw_col) * buckets).cast("int"))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    up_to = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*group)
    offsets = counts.select(
        *group,
        "_slice",
        (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(draw_col, key))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*group, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_slice", "_local", "_before")
    )


def previous_in_group(
    df: DataFrame, group: str, order: str, payload: Column, out: str = "prev", width: int = 1_000_000
) -> DataFrame:
    """``payload`` of the row before this one in its group, by a numeric ``order``.

    Two levels: a lag inside each ``width``-wide stretch of the order, and for the first row of a
    stretch the last payload of the group's previous non-empty stretch.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_payload", payload)
    last = cut.groupBy(group, "_stretch").agg(F.max_by("_payload", order).alias("_last"))
    carried = last.select(
        group, "_stretch", F.lag("_last").over(W.partitionBy(group).orderBy("_stretch")).alias("_carried")
    )
    inside = W.partitionBy(group, "_stretch").orderBy(order)
    return (
        cut.withColumn("_lag", F.lag("_payload").over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [group, "_stretch"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_stretch", "_payload", "_lag", "_first", "_carried")
    )
