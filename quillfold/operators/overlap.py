"""Top-k items per query by weighted token overlap, from an inverted index with score bounds.

score = boost x (sum of the weights of shared tokens) / root, where root is the square root of the number of the item's
tokens. A query reads the postings of its rarest tokens first, as many as its budget allows. An item without any of those
shares at most the rest of the query's weight R, so it scores at most ``R / (least root)`` and, since it needs a token for
each weight, ``sqrt(R x largest weight left)``. A query whose k-th score lies above that is done; the others go on with a
larger budget. So a token that every item holds is read only where it can matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage

#: Postings that a query reads at first, and by how much more in each further round.
BUDGET, MORE = 1 << 16, 16
#: Weights are summed as integers of this unit, so that a sum does not depend on its order.
UNIT = 1e9


def top_overlap(
    queries: DataFrame, items: DataFrame, k: int, weight: Callable[[Column], Column] = lambda df: F.lit(1.0), budget: int = BUDGET
) -> DataFrame:
    """``query_id, item, score, rank`` of the ``k`` best items with a shared token, ties to the smaller item.

    ``queries``: query_id, grp, tokens (distinct longs); ``items``: item, grp, tokens (distinct longs), root, boost; only
    items of the query's group count. ``weight`` makes a token's weight, above 0, of its number of items in the group.
    Pass tables: both are read several times.
    """
    asked = queries.select("query_id", "grp", F.explode("tokens").alias("tok"))
    hits = items.select("grp", "item", F.explode("tokens").alias("tok")).join(asked.select("grp", "tok").distinct(), ["grp", "tok"], "left_semi")
    hits = cut_lineage(hits)
    df = hits.groupBy("grp", "tok").agg(F.count("*").alias("df"))
    weighed = df.withColumn("w", F.round(weight(F.col("df")) * UNIT).cast("long"))
    walk = W.partitionBy("query_id").orderBy("df", "tok")
    sofar = walk.rowsBetween(W.unboundedPreceding, 0)
    wanted = cut_lineage(
        asked.join(weighed, ["grp", "tok"])
        .withColumn("read", F.sum("df").over(sofar))
        .withColumn("place", F.row_number().over(walk))
    )
    meta = items.select("grp", "item", "root", "boost")
    limits = items.groupBy("grp").agg(F.min("root").alias("least_root"), F.max("boost").alias("most_boost"))
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "item")
    done: DataFrame | None = None
    while True:
        now = wanted.withColumn("now", (F.col("read") <= budget) | (F.col("place") == 1))
        rest = now.groupBy("query_id", "grp").agg(
            F.coalesce(F.sum(F.when(~F.col("now"), F.col("w"))), F.lit(0)).alias("rest"),
            F.coalesce(F.max(F.when(~F.col("now"), F.col("w"))), F.lit(0)).alias("largest"),
        )
        found = now.filter("now").join(hits, ["grp", "tok"]).groupBy("query_id", "grp", "item").agg(F.sum("w").alias("part"))
        scored = cut_lineage(
            found.join(meta, ["grp", "item"]).join(rest, ["query_id", "grp"]).select(
                "query_id", "grp", "item", "part", "rest", "root", "boost", (F.col("part") / UNIT / F.col("root") * F.col("boost")).alias("score")
            )
        )
        whole = wanted.agg(F.max("read")).first()[0]
        if whole is None or whole <= budget:  # every token has been read: the scores are exact
            top = scored.select("query_id", "item", "score").withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
            return top if done is None else done.unionByName(top)
        # the k-th sure score cuts off what cannot reach it even with all of the rest
        kth = scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        most = (F.col("part") + F.col("rest")) / UNIT / F.col("root") * F.col("boost")
        open_ = scored.join(kth, "query_id", "left").filter(F.col("least").isNull() | (most >= F.col("least")))
        left = now.filter("NOT now").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "w"))).alias("left"))
        sets = items.select("grp", "item", "tokens")
        exact = open_.join(left, "query_id", "left").join(sets, ["grp", "item"])
        added = F.aggregate(F.transform("tokens", lambda t: F.coalesce(F.element_at("left", t), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        total = F.col("part") + F.coalesce(added, F.lit(0))
        exact = exact.select("query_id", "grp", "item", "rest", (total / UNIT / F.col("root") * F.col("boost")).alias("score"))
        top = cut_lineage(exact.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k))
        unseen = F.col("most_boost") * F.least(F.col("rest") / UNIT / F.col("least_root"), F.sqrt(F.col("rest") / UNIT * F.col("largest") / UNIT))
        last = top.filter(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
        bounds = rest.join(limits, "grp").join(last, "query_id", "left").withColumn("unseen", unseen * (1 + 1e-9))
        settled = cut_lineage(bounds.filter((F.col("rest") == 0) | (F.col("last") > F.col("unseen"))).select("query_id"))
        part = top.join(settled, "query_id", "left_semi").select("query_id", "item", "score", "rank")
        done = part if done is None else done.unionByName(part)
        wanted = cut_lineage(wanted.join(settled, "query_id", "left_anti"))
        budget *= MORE
