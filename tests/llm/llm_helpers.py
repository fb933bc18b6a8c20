"""Small tables that every operator must bear: nulls, empty and long texts, repeats, extra columns, no rows."""

from __future__ import annotations

import random

LONG = "Lorem ipsum dolor sit amet, consectetur. " * 3000

ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, LONG, "en", "s", len(LONG)),
    (5, "same text here for two rows", "de", None, 27), (5, "same text here for two rows", "de", None, 27),
    (6, "same text here for two rows", "de", "t", 27), (None, "an id that is null", "en", "s", 18), (7, "!!! ... ###", None, "s", -1),
    (8, "x\0y <|endoftext|> 𝔘 é", "fr", "s", 20), (9, "z" * 5000, "en", "s", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Extra columns have names that the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.select("*", *[F.lit(c).alias(c) for c in ("text_key", "label", "node", "kind", "size", "score", "y", "weight", "terms", "rep", "key", "id", "at", "first")])


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
