"""Blind-panel evaluation: pairs, votes, accuracy and its cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import normalize_passage
from ..functions.text import draw, words
from .ranking import rank_by_draw

# Fixed values
MIN_PASSAGE_WORDS = 120
TARGET_PASSAGE_WORDS = 400
BOOTSTRAP_ITERATIONS = 2000


def build_pairs(author: DataFrame, model: DataFrame, seed: int = 11, target: int = TARGET_PASSAGE_WORDS) -> DataFrame:
    """Each model passage (``doc_id, register, text``) meets one random author passage of its register.

    Author passages are numbered per register and looked up by a drawn number: an equi-join on
    (register, number), never a cross product.
    """
    pool = rank_by_draw(
        author.withColumn("_d", draw(seed, "pool", F.col("doc_id"))), ["register"], "_d", "doc_id", out="number"
    )
    pool = pool.select(
        "register", "number", "group_size", F.col("doc_id").alias("author_doc"), normalize_passage(F.col("text"), target).alias("author_text")
    )
    sizes = pool.select("register", "group_size").distinct()
    picked = (
        model.join(sizes, "register")
        .withColumn("number", (F.floor(draw(seed, "pick", F.col("doc_id")) * F.col("group_size")) + 1).cast("long"))
        .select(
            "register", "number", F.col("doc_id").alias("model_doc"), normalize_passage(F.col("text"), target).alias("model_text")
        )
    )
    joined = picked.join(pool.drop("group_size"), ["register", "number"]).filter(
        (words(F.col("author_text")) >= MIN_PASSAGE_WORDS) & (words(F.col("model_text")) >= MIN_PASSAGE_WORDS)
    )
    side = F.when(draw(seed, "side", F.col("model_doc")) < 0.5, "A").otherwise("B")
    mine = F.col("author_side") == "A"
    return joined.withColumn("author_side", side).select(
        F.concat(F.lit("pair_"), F.col("model_doc").cast("string")).alias("pair_id"),
        "register",
        "author_side",
        F.when(mine, F.col("author_text")).otherwise(F.col("model_text")).alias("a"),
        F.when(mine, F.col("model_text")).otherwise(F.col("author_text")).alias("b"),
        "author_doc",
        "model_doc",
    )


def passages_by_source(generations: DataFrame, seeds: DataFrame, key: str = "source_id") -> DataFrame:
    """Generations with their seed pair; unmatched ones are dropped."""
    return generations.join(seeds, key)


def majority_vote(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One judgement per pair from its votes (``pair_id, ord, vote, confidence, tell``).

    A tie goes to A. A pair without valid votes gets NULL, since a missing vote is not a wrong one.
    """
    valid = votes.filter(F.col("vote").isin("A", "B"))
    said = F.when(F.length("tell") > 0, F.col("ord"))
    tally = valid.groupBy("pair_id").agg(
        F.count_if(F.col("vote") == "A").alias("a"),
        F.count("*").alias("votes"),
        F.avg(F.coalesce("confidence", F.lit(3.0))).alias("confidence"),
        F.min_by("tell", said).alias("tell"),
    )
    guess = F.when(F.col("votes").isNull(), None).when(F.col("a") >= F.col("votes") - F.col("a"), "A").otherwise("B")
    return pairs.join(tally, "pair_id", "left").withColumn("guess", guess).withColumn("correct", F.col("guess") == F.col("author_side"))


def panel_accuracy(judgements: DataFrame, *by: str, cluster: str = "author_doc") -> DataFrame:
    return judgements.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.countDistinct(cluster).alias("clusters"),
    )


def cluster_bootstrap(
    judgements: DataFrame, by: str, cluster: str = "author_doc", iterations: int = BOOTSTRAP_ITERATIONS, seed: int = 3
) -> DataFrame:
    """Accuracy with a percentile interval from resampling whole clusters with replacement.

    Judgements shrink to one (correct, total) row per cluster first. Each iteration draws as many
    clusters as there are, by number, and the draws meet the clusters in an equi-join.
    """
    per_cluster = judgements.groupBy(by, cluster).agg(
        F.sum(F.col("correct").cast("int")).alias("correct"), F.count("*").alias("total")
    )
    numbered = rank_by_draw(
        per_cluster.withColumn("_d", draw(seed, "cluster", F.col(cluster))), [by], "_d", cluster, out="number"
    )
    rolls = numbered.select(
        by, "group_size", F.col("number").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("it")
    ).withColumn("number", (F.floor(draw(seed, F.col("it"), F.col("slot")) * F.col("group_size")) + 1).cast("long"))
    shares = (
        rolls.select(by, "it", "number")
        .groupBy(by, "it", "number")
        .agg(F.count("*").alias("times"))
        .join(numbered.select(by, "number", "correct", "total"), [by, "number"])
        .groupBy(by, "it")
        .agg((F.sum(F.col("correct") * F.col("times")) / F.sum(F.col("total") * F.col("times"))).alias("p"))
    )
    interval = shares.groupBy(by).agg(
        F.expr("percentile(p, 0.025)").alias("ci_low"), F.expr("percentile(p, 0.975)").alias("ci_high")
    )
    inside = (F.col("ci_low") <= 0.5) & (F.col("ci_high") >= 0.5)
    return panel_accuracy(judgements, by, cluster=cluster).join(interval, by).withColumn("indistinguishable", inside)


def orthography_share(with_noise, without_noise):
    """How much of the movement in discrimination rate the spelling layer explains."""
    total = F.abs(with_noise - 0.5) + F.abs(without_noise - 0.5)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(without_noise - with_noise) / total)
