"""Example selection with diversity, and fact retrieval with inverse document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.text import tok_alnum, tok_retrieval, window_hashes
from ..session import cut_lineage
from .overlap import BUDGET, top_overlap

# Fixed values
MMR_THRESHOLD = 0.3
MAX_EXEMPLARS = 3
MAX_EXEMPLAR_WORDS = 900
MAX_FACTS = 4
USAGE_DECAY = 0.7
SHORTLIST = 32
SYNONYMS = {
    "leadership": ("lead", "leader", "president", "captain", "organize", "initiative"),
    "service": ("volunteer", "community", "give", "help", "serve", "outreach"),
    "need": ("financial", "hardship", "afford", "cost", "tuition", "pell", "income"),
    "research": ("stem", "science", "lab", "study", "investigate", "data"),
    "perseverance": ("persist", "overcome", "challenge", "obstacle", "adversity", "resilience"),
    "entrepreneur": ("founder", "startup", "business", "venture", "built", "company"),
    "medicine": ("health", "medical", "clinical", "patient", "cancer", "oncology", "doctor"),
}


def _token_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(tok_retrieval(text), lambda w: F.xxhash64(w)))


def _root(tokens: Column) -> Column:
    return F.sqrt(F.greatest(F.size(tokens), F.lit(1)).cast("double"))


def _ranking(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` best items of each query with their rank: by score, then by item; items that share no token come last."""
    top = cut_lineage(top_overlap(queries, items, k))
    short = queries.select("query_id", "grp").join(top.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left")
    short = short.withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < k)
    # of twice as many first items of a group, fewer than k have a score
    heads = items.select("grp", "item").withColumn("_place", F.row_number().over(W.partitionBy("grp").orderBy("item"))).filter(F.col("_place") <= 2 * k)
    rest = short.join(heads.drop("_place"), "grp").join(top.select("query_id", "item"), ["query_id", "item"], "left_anti")
    rest = rest.withColumn("rank", F.col("have") + F.row_number().over(W.partitionBy("query_id").orderBy("item"))).filter(F.col("rank") <= k)
    return top.unionByName(rest.select("query_id", "item", F.lit(0.0).alias("score"), "rank"))


def exemplars_mmr(
    queries: DataFrame,
    pool: DataFrame,
    n: int = MAX_EXEMPLARS,
    max_words: int = MAX_EXEMPLAR_WORDS,
    threshold: float = MMR_THRESHOLD,
    shortlist: int = SHORTLIST,
    budget: int = BUDGET,
) -> DataFrame:
    """Greedy pick of up to ``n`` pool texts per query: best score first, within a word budget after the first pick, and
    none too similar to an earlier pick. ``queries`` (query_id, register, seed), ``pool`` (doc_id, register, word_count,
    text), both with unique ids.

    The ranking comes from an inverted index per register (:func:`overlap.top_overlap`). Each query walks down its first
    ``shortlist`` rows; those that run out of rows before they have ``n`` picks walk a longer list. A walk reads its rows
    one after another and holds its picks only.
    """
    items = cut_lineage(
        pool.select(F.col("doc_id").alias("item"), F.col("register").alias("grp"), "word_count", _token_hashes(F.col("text")).alias("tokens"))
        .withColumn("root", _root(F.col("tokens")))
        .withColumn("boost", F.lit(1.0))
    )
    todo = cut_lineage(queries.select("query_id", F.col("register").alias("grp"), _token_hashes(F.col("seed")).alias("tokens")))
    kinds = {c: pool.schema[c].dataType.simpleString() for c in ("doc_id", "register", "word_count")}
    schema = f"query_id {todo.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", score double, pick int"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, seen, words, picked, out = None, 0, 0, [], []

        def end() -> None:
            if seen == k and len(picked) < n:  # there may be more rows
                out.append({"query_id": query, "pick": 0})

        for batch in batches:
            for row in batch.to_pylist():
                if row["query_id"] != query:
                    end()
                    query, seen, words, picked = row["query_id"], 0, 0, []
                seen += 1
                if len(picked) >= n or picked and words + row["word_count"] > max_words:
                    continue
                mine = set(row["s"])
                if any(mine and p and len(mine & p) / len(mine | p) > threshold for p in picked):
                    continue
                picked.append(mine)
                words += row["word_count"]
                out.append({c: row[c] for c in ("query_id", "doc_id", "register", "word_count", "score")} | {"pick": len(picked)})
            yield pa.RecordBatch.from_pylist(out, told)
            out.clear()
        end()
        yield pa.RecordBatch.from_pylist(out, told)

    told = to_arrow_schema(StructType.fromDDL(schema))
    found, k = None, shortlist
    while True:
        ranked = _ranking(todo, items, k)
        texts = pool.select(F.col("doc_id"), "register", "word_count", F.array_distinct(window_hashes(tok_alnum(F.col("text")), 5)).alias("s"))
        rows = ranked.withColumnRenamed("item", "doc_id").join(texts, "doc_id").repartition("query_id").sortWithinPartitions("query_id", "rank")
        walked = cut_lineage(rows.mapInArrow(walk, schema))
        stuck = walked.filter("pick = 0").select("query_id")
        picks = walked.join(stuck, "query_id", "left_anti")
        found = picks if found is None else found.unionByName(picks)
        if stuck.isEmpty():
            return found.withColumn("score", F.round("score", 4))
        todo = cut_lineage(todo.join(stuck, "query_id", "left_semi"))
        k *= 8


def idf(tokens: DataFrame, n: Column | int, key: str = "fact_id", token: str = "token") -> DataFrame:
    """``token, df, weight`` with weight ln((N + 1) / (df + 0.5))."""
    df = tokens.select(key, token).distinct().groupBy(token).agg(F.count("*").alias("df"))
    return df.withColumn("weight", F.log((F.lit(n) + 1) / (F.col("df") + 0.5)))


def expand_query(tokens: Column) -> Column:
    """The tokens plus every synonym group any of them belongs to."""
    groups = [F.array(*[F.lit(w) for w in (k, *v)]) for k, v in SYNONYMS.items()]
    grown = tokens
    for g in groups:
        grown = F.concat(grown, F.when(F.arrays_overlap(tokens, g), g).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(grown)


def angle_usage(events: DataFrame, data: str = "data") -> DataFrame:
    """Times each angle appears in event payloads, under either spelling of the key."""
    angle = F.coalesce(F.get_json_object(data, "$.angle_used"), F.get_json_object(data, "$.angleUsed"))
    return events.select(angle.alias("angle")).filter(F.length("angle") > 0).groupBy("angle").agg(F.count("*").alias("uses"))


def retrieve_facts(
    queries: DataFrame, facts: DataFrame, usage: DataFrame | None = None, n: int = MAX_FACTS, decay: float = USAGE_DECAY, budget: int = BUDGET
) -> DataFrame:
    """Top ``n`` facts per query, topped up from spine facts when too few score.

    ``facts``: fact_id, text, angle, spine. Score: summed IDF of shared tokens over the root of the
    fact's token count, damped by how often its angle was used. Tokens that most facts hold weigh next to nothing and are
    only counted for facts found through rarer ones (:func:`overlap.top_overlap`).
    """
    meta = facts.select("fact_id", "angle", _token_hashes(F.col("text")).alias("tokens"))
    if usage is not None:
        meta = meta.join(usage.select("angle", "uses"), "angle", "left")
    else:
        meta = meta.withColumn("uses", F.lit(0))
    damp = F.when(F.col("angle").isNotNull(), F.pow(F.lit(decay), F.coalesce("uses", F.lit(0)))).otherwise(1.0)
    items = cut_lineage(meta.select(F.col("fact_id").alias("item"), F.lit(0).alias("grp"), "tokens", _root(F.col("tokens")).alias("root"), damp.alias("boost")))
    grown = F.transform(expand_query(F.array_distinct(tok_retrieval(F.col("prompt")))), lambda w: F.xxhash64(w))
    asked = cut_lineage(queries.select("query_id", F.lit(0).alias("grp"), grown.alias("tokens")))
    total = items.count()
    top = top_overlap(asked, items, n, lambda df: F.log((F.lit(total) + 1) / (df + 0.5)), budget)
    scored = cut_lineage(top.select("query_id", F.col("item").alias("fact_id"), "score").filter("score > 0"))
    # n spine facts are enough to top up any query
    spine = facts.filter("spine").orderBy("fact_id").limit(n).select("fact_id", F.lit(1).alias("_one"))
    fill = queries.select("query_id", F.lit(1).alias("_one")).join(F.broadcast(spine), "_one").drop("_one")
    fill = fill.join(scored.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").withColumn("score", F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    ranked = scored.unionByName(fill).withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n)
    return ranked.select("query_id", "fact_id", F.round("score", 4).alias("score"), "pick")
