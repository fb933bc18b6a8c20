"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, documents that
hold benchmark items go, secrets are blotted out, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import decontaminate, neardup, packing, secrets, toxicity
from quillfold.llm.queries import table, vocabulary
from quillfold.llm.store import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among `docs`; rejects what scores as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays."""
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, verbatim or re-parameterised."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; reported spans are replaced, and n_chars, where there is such a column, follows the text where it
    held its length."""
    if "n_chars" not in docs.columns:
        return secrets.redact(docs)
    held, length = "__held", F.length("text").cast("long")
    while held in docs.columns:
        held += "_"
    told = secrets.redact(docs.withColumn(held, F.col("n_chars").eqNullSafe(length)))
    return told.withColumn("n_chars", F.when(F.col(held), length).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blot_secrets),
    ("packing", pack),
]

#: None: SQL can't express training, signatures or tokenisation; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
