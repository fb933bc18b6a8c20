"""Authorship triage of documents, and the edit loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import excerpt
from ..functions.text import words
from ..sources.records import AUTHOR_WROTE_IT, record_id


def triage_pending(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Unverified documents with word count, excerpt and whether their text is on disk."""
    seen = records.select(F.col("source_id").alias("file_id"), "word_count", excerpt(F.col("text")).alias("excerpt"))
    open_docs = manifest.filter(F.col("authorship") == "unverified")
    return open_docs.join(seen, "file_id", "left").select(
        "file_id",
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        F.col("word_count").isNotNull().alias("on_disk"),
    )


def triage_apply(manifest: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest after the latest resolution per document, and the events to append.

    Only unverified documents move, and only an explicit yes promotes.
    """
    latest = resolutions.groupBy("file_id").agg(F.max_by("resolution", "seq").alias("resolution"))
    joined = manifest.join(latest, "file_id", "left")
    moves = (F.col("authorship") == "unverified") & (F.coalesce(F.col("resolution"), F.lit("")) != "")
    updated = joined.withColumn("authorship", F.when(moves, F.col("resolution")).otherwise(F.col("authorship")))
    events = joined.filter(moves).select(
        "file_id",
        F.when(F.col("resolution") == AUTHOR_WROTE_IT, "corpus_doc_verified")
        .otherwise("corpus_doc_rejected")
        .alias("type"),
        "resolution",
    )
    return updated.drop("resolution"), events


def valid_edits(edits: DataFrame) -> DataFrame:
    """Edits that change something and leave some text."""
    return edits.filter(
        (F.length(F.btrim(F.coalesce("after", F.lit("")), F.lit(" \t\r\n"))) > 0) & ~F.col("before").eqNullSafe(F.col("after"))
    )


def route_edits(edits: DataFrame, holdout_ids: DataFrame) -> DataFrame:
    """Valid edits with ``held_out``: edits of held-out sources belong in their own table."""
    held = holdout_ids.select("source_id").distinct().withColumn("_held", F.lit(True))
    return (
        valid_edits(edits)
        .join(held, "source_id", "left")
        .withColumn("held_out", F.coalesce("_held", F.lit(False)))
        .drop("_held")
    )


def ingest_edits(edits: DataFrame, holdout_ids: DataFrame) -> DataFrame:
    """Records from the corrected text only; edits of held-out sources never get in."""
    ok = valid_edits(edits).join(holdout_ids.select("source_id").distinct(), "source_id", "left_anti")
    source_id = F.concat(F.lit("edit:"), F.col("edited_at").cast("string"))
    return ok.select(
        record_id(F.lit("manual"), source_id, F.col("after")).alias("id"),
        F.col("after").alias("text"),
        "register",
        F.lit(1.0).alias("register_confidence"),
        F.lit("manual").alias("source"),
        source_id.alias("source_id"),
        words(F.col("after")).alias("word_count"),
        F.lit("author").alias("verified_by"),
        F.lit("train").alias("split"),
    )
