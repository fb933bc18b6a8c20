"""Checks that a short brief does not give away the wording of the piece it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, ngram_set, tok_alnum

# Fixed values
LEAK_NGRAM = 4
MAX_SEED_WORDS = 80
MAX_SEED_FRACTION = 0.2
MAX_SENTENCE_OVERLAP = 0.4
MIN_SENTENCE_TOKENS = 4
RARE_BELOW = 3
RARE_MIN_LENGTH = 3


def word_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    return corpus.select(F.explode(tok_alnum(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rare_words(corpus: DataFrame, text: str = "text", below: int = RARE_BELOW) -> DataFrame:
    """Words longer than three letters seen fewer than ``below`` times in the whole corpus."""
    return word_counts(corpus, text).filter((F.col("n") < below) & (F.length("word") > RARE_MIN_LENGTH))


def assert_no_leak(pairs: DataFrame, rare: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """``key, ok, violation`` for rows of (key, piece, assignment_prompt, thesis_abstract, moves, anchor_label).

    Checks run in a fixed order and the first violation is reported: length, shared 4-gram, rare
    word in the anchor label, sentence overlap.
    """
    seed = F.concat_ws(
        " ", "assignment_prompt", "thesis_abstract", F.array_join("moves", " "), "anchor_label"
    )
    n_seed, n_piece = F.size(tok_alnum(seed)), F.size(tok_alnum(F.col("piece")))
    cap = F.least(F.lit(MAX_SEED_WORDS), F.round(n_piece * MAX_SEED_FRACTION).cast("int"))
    shared = let(
        ngram_set(F.col("piece"), LEAK_NGRAM),
        lambda p: F.get(F.filter(ngram_set(seed, LEAK_NGRAM), lambda g: F.array_contains(p, g)), F.lit(0)),
    )
    statements = F.concat(F.array("assignment_prompt", "thesis_abstract"), F.col("moves"))

    def distinct_tokens(x):
        return F.array_distinct(tok_alnum(x))

    sentences = F.transform(F.split(F.col("piece"), r"(?<=[.!?])\s+"), distinct_tokens)
    close = let(
        sentences,
        lambda piece: F.get(
            F.filter(
                statements,
                lambda s: let(
                    distinct_tokens(s),
                    lambda a: (F.size(a) >= MIN_SENTENCE_TOKENS)
                    & F.exists(
                        piece,
                        lambda b: (F.size(b) >= MIN_SENTENCE_TOKENS)
                        & (F.size(F.array_intersect(a, b)) / F.size(a) > MAX_SENTENCE_OVERLAP),
                    ),
                ),
            ),
            F.lit(0),
        ),
    )
    checked = pairs.select(
        key,
        n_seed.alias("seed_words"),
        n_piece.alias("piece_words"),
        cap.alias("cap"),
        shared.alias("_shared"),
        close.alias("_close"),
    )
    if rare is not None:
        label = pairs.select(key, F.posexplode(tok_alnum(F.col("anchor_label"))).alias("_pos", "word"))
        named = label.join(rare.select("word"), "word").groupBy(key).agg(F.min_by("word", "_pos").alias("_rare"))
        checked = checked.join(named, key, "left")
    else:
        checked = checked.withColumn("_rare", F.lit(None).cast("string"))
    violation = (
        F.when(F.col("seed_words") > F.col("cap"), "too-long")
        .when(F.col("_shared").isNotNull(), F.concat(F.lit("shared-phrase: "), F.col("_shared")))
        .when(F.col("_rare").isNotNull(), F.concat(F.lit("names-anchor: "), F.col("_rare")))
        .when(F.col("_close").isNotNull(), F.concat(F.lit("close-sentence: "), F.col("_close")))
    )
    return checked.select(key, "seed_words", "cap", violation.isNull().alias("ok"), violation.alias("violation"))
