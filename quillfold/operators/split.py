"""Leakage-safe incremental split of documents into train / exemplar / holdout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import draw
from .ranking import rank_by_draw

SEED = 20260910
# Fixed values: (holdout, exemplar) shares per register; the rest is train.
RATIOS = {
    "academic": (0.25, 0.25),
    "persuasive": (0.25, 0.25),
    "narrative": (0.2, 0.25),
    "raw": (0.15, 0.25),
    "directive": (0.15, 0.25),
}
DEFAULT_RATIO = (0.15, 0.25)


def incremental_split(
    keys: DataFrame,
    prior: DataFrame | None = None,
    seed: int = SEED,
    key: str = "doc_key",
    register: str = "register",
    ratios: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``key, split`` for prior and new documents. Earlier assignments never move.

    Per register, new documents are ordered by a keyed draw; the first share is held out, the next
    becomes exemplars. A register with at least four new documents gets one of each.
    """
    ratios = RATIOS if ratios is None else ratios
    fresh = keys.select(key, register).distinct()
    if prior is not None:
        fresh = fresh.join(prior.select(key), key, "left_anti")
    ranked = rank_by_draw(
        fresh.withColumn("_draw", draw(seed, "split", F.col(key))), [register], "_draw", key, out="_rank"
    )

    def share(i: int):
        return reduce(
            lambda rest, item: F.when(F.col(register) == item[0], item[1][i]).otherwise(rest),
            ratios.items(),
            F.lit(DEFAULT_RATIO[i]),
        )

    n = F.col("group_size")
    floor = F.when(n >= 4, 1).otherwise(0)
    held = F.greatest(floor, F.round(n * share(0)).cast("long"))
    shown = F.greatest(floor, F.round(n * share(1)).cast("long"))
    assigned = ranked.select(
        key,
        F.when(F.col("_rank") <= held, "holdout")
        .when(F.col("_rank") <= held + shown, "exemplar")
        .otherwise("train")
        .alias("split"),
    )
    return assigned if prior is None else prior.select(key, "split").unionByName(assigned)


def document_key(source, source_id, record_id):
    return F.when(source == "document", source_id).otherwise(record_id)


def apply_split(records: DataFrame, assignments: DataFrame, key: str = "doc_key") -> DataFrame:
    """Attach the split; unknown documents get NULL."""
    return records.join(assignments.select(key, "split"), key, "left")


def split_counts(records: DataFrame, assignments: DataFrame, key: str = "doc_key", register: str = "register") -> DataFrame:
    counted = records.select(key, register).distinct().join(assignments, key)
    return (
        counted.groupBy(register)
        .pivot("split", ["train", "exemplar", "holdout"])
        .count()
        .na.fill(0, ["train", "exemplar", "holdout"])
    )


def moved_documents(prior: DataFrame, current: DataFrame, key: str = "doc_key") -> DataFrame:
    """Prior assignments whose split changed or vanished. Anything here means: refuse to write."""
    now = current.select(key, F.col("split").alias("now"))
    return prior.select(key, F.col("split").alias("was")).join(now, key, "left").filter(~F.col("was").eqNullSafe(F.col("now")))


def frozen_digest(df: DataFrame, *columns: str, buckets: int = 4096) -> DataFrame:
    """One order-independent sha256 over the table.

    Row digests are hashed per bucket and the sorted bucket digests hashed again, so no task ever
    sees more than one bucket of digests.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    rows = df.select(F.sha2(F.concat_ws("\t", *parts), 256).alias("d")).withColumn(
        "b", F.pmod(F.conv(F.substring("d", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    )
    per_bucket = rows.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    return per_bucket.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"))


def leak_guard(holdout: DataFrame, exemplars: DataFrame, key: str = "doc_key") -> DataFrame:
    """Held-out documents that also serve as exemplars; must be empty."""
    return holdout.join(exemplars.select(key), key, "left_semi")
