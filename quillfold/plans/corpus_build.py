"""The corpus flow: clean -> contamination -> register -> near-duplicates -> report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_text
from ..functions.text import words
from ..operators.contamination import contaminations
from ..operators.dedup import near_duplicates
from ..operators.register import tag_register
from ..session import cut_lineage

OUTCOMES = ("kept", "duplicate", "quarantined")


def build(
    records: DataFrame,
    protected: DataFrame,
    key: str = "id",
    order: str | None = None,
    protected_text: str = "text",
    blocked_paths: tuple[str, ...] = (),
) -> DataFrame:
    """Every input row with its ``outcome``: kept, duplicate, quarantined, or the rejection reason.

    Needs ``key, text, is_document, source_id``. Documents arrive clean and skip the paste stripper.
    """
    order = order or key
    pastes = clean_text(records.filter(~F.col("is_document")))
    whole = records.filter("is_document").select(
        "*", F.col("text").alias("clean"), words(F.col("text")).alias("word_count"), F.lit(None).cast("string").alias("rejected")
    )
    cols = [*dict.fromkeys([key, order, "is_document", "source_id"]), "clean", "word_count", "rejected"]
    # read again for tagging, similarity and the final outcome, so it is materialised once
    cleaned = cut_lineage(pastes.select(*cols).unionByName(whole.select(*cols)))
    usable = cleaned.filter(F.col("rejected").isNull())
    found = cut_lineage(
        contaminations(usable, protected, key, text="clean", protected_text=protected_text, source_id="source_id", blocked_paths=blocked_paths)
    )
    tagged = cut_lineage(tag_register(usable.drop("rejected"), F.col("is_document"), "clean"))
    dups = near_duplicates(tagged, key, "clean", order, without=found)
    tagged = tagged.join(found, key, "left").withColumn("contaminated", F.col("contamination_reason").isNotNull())
    outcome = (
        F.when(F.col("contaminated"), "quarantined").when(F.col("is_duplicate"), "duplicate").otherwise("kept")
    )
    judged = tagged.join(dups, key, "left").withColumn("outcome", outcome)
    rejected = cleaned.filter(F.col("rejected").isNotNull()).withColumnRenamed("rejected", "outcome")
    return judged.unionByName(rejected, allowMissingColumns=True)


def build_report(built: DataFrame) -> DataFrame:
    """Rows and words per outcome and, for kept rows, per register."""
    kept_register = F.when(F.col("outcome") == "kept", F.col("register"))
    return built.groupBy("outcome", kept_register.alias("register")).agg(
        F.count("*").alias("records"), F.sum(F.col("word_count").cast("long")).alias("words")
    )
