"""Exact near-duplicate removal by Jaccard similarity of shingle sets, keeping the first row.

A row is a duplicate only of an earlier *kept* row. The sequential rule is reproduced in parallel:

1. Texts are read once: the sorted shingle hashes of each row are written as a table, and no text is shuffled after that.
   Rows with the same set collapse to their first row. Later copies share its fate, so a mass of identical copies costs
   one map-side aggregate and never forms pairs.
2. Prefix filter: with shingles in any global order, two sets with J >= t must share a shingle among their first
   n - ceil(t*n) + 1. The order is by the rows that hold a shingle of the same slot (of a fixed number of slots), so common
   boilerplate sorts last, out of the prefix, and only prefixes are shuffled, not every shingle. The index is keyed by (shingle, size band): similar
   sets differ in size by 1/t at most, so rows of quite another size never meet. The positional filter drops a meeting
   whose places in the two prefixes leave too few shingles for the overlap that t asks for.
3. Rounds. In each bucket only the few earliest undecided rows act as pivots, and every undecided row is compared with
   those pivots only. So a bucket of m rows makes at most k*m candidates, never m*m. A row whose earlier bucket mates are
   all pivots, and which matches none of them, is kept; rows matching a kept pivot are dropped. The first undecided row is
   always decided, and k grows per round, so the loop ends with the sequential answer. Verdicts on pairs are a table: a
   pair is verified once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.runs import shingle_hashes
from ..session import HOT_ROWS, cut_lineage, salted_join

SHINGLE = 5
THRESHOLD = (9, 10)
PIVOTS = 4
GROWTH = 4
# Slots that shingles are counted in (a power of two): 8 MB in every task. They only set the order of shingles.
SLOTS = 1 << 20
# Sets that go to a Python worker at a time.
SET_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shingle_sets(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``_key, _ord, h, n``: sorted distinct 64-bit shingle hashes; rows without shingles are left out."""
    hashed = shingle_hashes(texts, F.col("_text"), n).drop("_text")
    return hashed.withColumn("n", F.size("h")).filter("n > 0")


def representatives(signed: DataFrame) -> DataFrame:
    """``_key, rep``: the first row with the same shingle set, for every row."""
    first = signed.groupBy("sig").agg(F.min(F.struct("_ord", "_key")).alias("m"))
    return salted_join(signed, first, "sig", F.col("_key")).select("_key", F.col("m._key").alias("rep"))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often each of the ``SLOTS`` slots is hit by a shingle of ``sets``. Tasks count first, so the table and what is
    shuffled for it do not grow with the rows."""
    hits = sets.select(F.explode("h").alias("tok")).groupBy(F.pmod("tok", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("c"))
    found, counts = hits.toPandas(), np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return counts


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``_key, _ord, n, alone, toks``: the prefix of each row in the order of slot counts, without the first ``alone`` shingles,
    whose slots nothing else hits; rows with no more than those are left out."""
    counts = slot_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            values, edge = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            rare = counts[_slot(values)]
            alone, toks = np.zeros(batch.num_rows, np.int32), []
            for i in range(batch.num_rows):
                h, c = values[edge[i] : edge[i + 1]], rare[edge[i] : edge[i + 1]]
                order = np.lexsort((h, c))[: len(h) - (num * len(h) + den - 1) // den + 1]
                alone[i] = np.count_nonzero(c == 1)
                toks.append(h[order[alone[i] :]])
            some = np.array([len(t) > 0 for t in toks], bool)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in toks if len(t)], dtype=np.int64)])
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *toks])))
            few = batch.select(["_key", "_ord", "n"]).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array(alone[some]), kept], ["_key", "_ord", "n", "alone", "toks"])

    types = dict(sets.dtypes)
    rows = sets.select("_key", "_ord", "n", "h").mapInArrow(run, f"_key {types['_key']}, _ord {types['_ord']}, n int, alone int, toks array<long>")
    spark = sets.sparkSession
    before = spark.conf.get(_BATCH_ROWS, None)
    spark.conf.set(_BATCH_ROWS, str(SET_ROWS))
    try:
        return cut_lineage(rows)
    finally:
        spark.conf.set(_BATCH_ROWS, before) if before else spark.conf.unset(_BATCH_ROWS)


def prefix_index(sets: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """One row per (representative, prefix shingle that is in some other representative's prefix too, size band): ``rep, _ord, n,
    pos`` (place of the shingle in the row's order), ``tok, df, band``. ``copies`` (``_key``) are no representatives."""
    taken = prefixes(sets, num, den).join(copies, "_key", "left_anti")
    placed = taken.select(F.col("_key").alias("rep"), "_ord", "n", "alone", F.posexplode("toks").alias("at", "tok"))
    df = placed.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    rows = placed.join(df, "tok").select("rep", "_ord", "n", (F.col("alone") + F.col("at")).alias("pos"), "tok", "df")
    # sets whose sizes differ by 1/t at most lie in the same or in neighbouring bands, so each row stands in two; the margin
    # keeps rounding of the logarithm from parting a pair
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) + 1e-9)) if num < den else F.col("n").cast("long")
    bands = F.array(band, band + 1) if num < den else F.array(band)
    return rows.withColumn("band", F.explode(bands))


def _candidates(index: DataFrame, pivots: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """(pivot, later row) pairs from shared buckets that size and places do not rule out; hot buckets are salted."""
    salts = F.ceil(F.col("df") / F.lit(hot_rows)).cast("int")
    left = index.select(
        "tok", "band", "rep", "_ord", "n", "pos", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("_salt")
    )
    right = pivots.select(
        "tok",
        "band",
        F.col("rep").alias("pivot"),
        F.col("_ord").alias("p_ord"),
        F.col("n").alias("p_n"),
        F.col("pos").alias("p_pos"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"),
    )
    close = (F.col("n") * den >= F.col("p_n") * num) & (F.col("p_n") * den >= F.col("n") * num)
    # at the first common shingle of a pair, what is left of the shorter rest bounds the overlap
    most = F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos"))
    enough = most * (num + den) >= (F.col("n") + F.col("p_n")) * num
    earlier = F.struct("p_ord", "pivot") < F.struct("_ord", "rep")
    return left.join(right, ["tok", "band", "_salt"]).filter(close & enough & earlier).select("pivot", "p_ord", "rep").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """The pairs with ``similar``: whether the exact similarity reaches the threshold. Hot pivots are split. Sets that are in no
    pair go no further than one semi-join."""
    wanted = cut_lineage(pairs.select(F.explode(F.array("rep", "pivot")).alias("_key")).distinct())
    sets = cut_lineage(sets.select("_key", "h").join(wanted, "_key", "left_semi"))
    a = sets.select(F.col("_key").alias("rep"), F.col("h").alias("h_r"))
    b = sets.select(F.col("_key").alias("pivot"), F.col("h").alias("h_p"))
    with_pivot = salted_join(pairs, b, "pivot", F.col("rep"), hot_rows)
    inter = F.size(F.array_intersect("h_r", "h_p"))
    union = F.size("h_r") + F.size("h_p") - inter
    return with_pivot.join(a, "rep").select("pivot", "p_ord", "rep", (inter * den >= union * num).alias("similar"))


def near_duplicates(
    df: DataFrame,
    key: str,
    text: str,
    order: str,
    threshold: tuple[int, int] = THRESHOLD,
    n: int = SHINGLE,
    with_match: bool = False,
    pivots: int = PIVOTS,
    hot_rows: int = HOT_ROWS,
    without: DataFrame | None = None,
) -> DataFrame:
    """``key, is_duplicate`` (and ``duplicate_of``: a kept row that it matches, the first by ``order`` of those it met when it
    was dropped) for every row. Rows whose key is in ``without`` are no duplicates and make none; they are left out once
    the texts are hashed, so that no text is in that join."""
    num, den = threshold
    texts = df.select(F.col(key).alias("_key"), F.col(order).alias("_ord"), F.col(text).cast("string").alias("_text"))
    hashed = shingle_sets(texts, n)
    if without is not None:
        hashed = hashed.join(without.select(F.col(key).alias("_key")), "_key", "left_anti")
    sets = cut_lineage(
        hashed.withColumn("sig", F.struct("n", F.xxhash64("h").alias("a"), F.xxhash64(F.lit(7), "h").alias("b")))
    )
    member_of = cut_lineage(representatives(sets.select("_key", "_ord", "sig")))
    copies = member_of.filter("rep <> _key").select("_key")
    index = cut_lineage(prefix_index(sets, copies, num, den))

    undecided, known, dropped = index, None, None
    k = pivots
    while not undecided.isEmpty():
        by_order = W.partitionBy("tok", "band").orderBy("_ord", "rep")
        # rank <= k keeps a per-task top k before the shuffle, so hot buckets stay small
        lead = cut_lineage(undecided.withColumn("_rk", F.row_number().over(by_order)).filter(F.col("_rk") <= k))
        met = _candidates(undecided, lead, num, den, hot_rows)
        if known is not None:
            met = met.join(known.select("pivot", "rep"), ["pivot", "rep"], "left_anti")
        told = cut_lineage(_verified(cut_lineage(met), sets, num, den, hot_rows))
        known = told if known is None else known.unionByName(told)
        horizon = lead.filter(F.col("_rk") == k).select("tok", "band", F.struct("_ord", "rep").alias("last"))
        # a row behind the last pivot of one of its buckets has mates there that it has not met
        behind = F.coalesce(F.struct("_ord", "rep") > F.col("last"), F.lit(False))
        rows = undecided.join(horizon, ["tok", "band"], "left").groupBy("rep").agg(F.max(behind).alias("unclear"))
        similar = known.filter("similar")
        if dropped is not None:  # of earlier rounds only pairs of undecided rows matter
            left = undecided.select("rep").distinct()
            similar = similar.join(left, "rep", "left_semi").join(left.withColumnRenamed("rep", "pivot"), "pivot", "left_semi")
        kept = rows.filter("NOT unclear").select("rep").join(similar.select("rep"), "rep", "left_anti")
        lost = (
            similar.join(kept.withColumnRenamed("rep", "pivot"), "pivot")
            .groupBy("rep")
            .agg(F.min_by("pivot", F.struct("p_ord", "pivot")).alias("match"))
        )
        done = cut_lineage(kept.withColumn("match", F.lit(None).cast(lost.schema["match"].dataType)).unionByName(lost))
        dropped = done if dropped is None else dropped.unionByName(done)
        undecided = cut_lineage(undecided.join(done.select("rep"), "rep", "left_anti"))
        k *= GROWTH

    fate = member_of.join(dropped, "rep", "left") if dropped is not None else member_of.withColumn("match", F.lit(None))
    copies = fate.select(
        F.col("_key").alias(key),
        F.coalesce("match", F.when(F.col("rep") != F.col("_key"), F.col("rep"))).alias("duplicate_of"),
    ).filter(F.col("duplicate_of").isNotNull())
    out = df.select(key).join(copies, key, "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    return out if with_match else out.drop("duplicate_of")


def dedupe_near(df: DataFrame, key: str, text: str, order: str, **opts) -> DataFrame:
    flags = near_duplicates(df, key, text, order, **opts)
    return df.join(flags.filter("is_duplicate").select(key), key, "left_anti")
