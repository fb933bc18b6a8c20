"""Quarantine text that shares a run of words with a protected collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runs import shingle_hashes
from ..functions.text import tok_alnum, windows
from ..session import cut_lineage

NGRAM = 8


class ContaminatedRecords(ValueError):
    """Raised by the strict form when any record would be quarantined."""


def protected_ngrams(protected: DataFrame, text: str = "text", n: int = NGRAM) -> DataFrame:
    """``h, ngram``: every run of ``n`` tokens of the protected texts, once, with its 64-bit hash."""
    texts = protected.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    hashed = shingle_hashes(texts, F.col("_text"), n, distinct=False)
    pairs = hashed.select(F.explode(F.arrays_zip("h", windows(tok_alnum(F.col("_text")), n).alias("ngram"))).alias("x"))
    return pairs.groupBy(F.col("x.h").alias("h")).agg(F.min("x.ngram").alias("ngram"))


def contaminations(
    records: DataFrame,
    protected: DataFrame,
    key: str,
    text: str = "text",
    protected_text: str = "text",
    source_id: str | None = None,
    blocked_paths: tuple[str, ...] = (),
    n: int = NGRAM,
) -> DataFrame:
    """``key, contamination_reason, shared_ngram`` (first by position) of the records that are contaminated, one row each.

    Records meet the protected runs by 64-bit hashes; strings come from the protected side, and no record's text is in a
    join. The protected runs are a table, so adaptive execution sends them to the records if they are few and splits a run
    that very many records hold if they are not.
    """
    by_path = F.lit(None).cast("string")
    if source_id:
        for path in reversed(blocked_paths):
            by_path = F.when(F.col(source_id).contains(path), F.lit(f"source under {path}")).otherwise(by_path)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = shingle_hashes(records.filter(by_path.isNull()).select(F.col(key).alias("_key"), body.alias("_text")), F.col("_text"), n, distinct=False)
    grams = hashed.select("_key", F.posexplode("h").alias("_pos", "h"))
    hits = grams.join(cut_lineage(protected_ngrams(protected, protected_text, n)), "h").groupBy("_key").agg(F.min_by("ngram", "_pos").alias("shared_ngram"))
    found = hits.select(F.col("_key").alias(key), F.lit(f"shares an {n}-gram with a protected text").alias("contamination_reason"), "shared_ngram")
    if not (source_id and blocked_paths):
        return found
    paths = records.filter(by_path.isNotNull()).select(key, by_path.alias("contamination_reason"), F.lit(None).cast("string").alias("shared_ngram"))
    return found.unionByName(paths)


def flag_contaminated(records: DataFrame, protected: DataFrame, key: str, **rules) -> DataFrame:
    """``records`` with ``contaminated``, ``contamination_reason`` and ``shared_ngram``; rules as for :func:`contaminations`."""
    found = contaminations(records, protected, key, **rules)
    return records.join(found, key, "left").withColumn("contaminated", F.col("contamination_reason").isNotNull())


def assert_not_contaminated(flagged: DataFrame) -> DataFrame:
    """Strict boundary check: refuse the whole table if one record is contaminated."""
    bad = flagged.filter("contaminated").select("contamination_reason", "shared_ngram").limit(1).collect()
    if bad:
        raise ContaminatedRecords(f"refused: {bad[0]['contamination_reason']} ({bad[0]['shared_ngram']})")
    return flagged
