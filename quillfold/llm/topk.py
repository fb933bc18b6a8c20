"""Exact search for the largest inner products, with vectors in buckets by length.

Vectors are ordered by length and cut into buckets. The bucket of the longest ones is searched first and gives every
query a lower bound of its k-th best product. That bound, divided by the query's length and a bucket's largest length,
is the cosine that a vector of the bucket must reach at least (its local threshold):

* above 1, the bucket is left out for this query, and for a whole block of queries before any vector moves;
* high, a vector's coordinate at the query's largest coordinate must lie in a narrow range (coordinate pruning);
* else vectors too short for the bound are left out (length pruning).

What remains is verified by exact integer products. Queries and vectors meet as blocks, so each pair of blocks is one
bounded matrix product, and per pair of blocks at most k rows a query go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Local thresholds from which on coordinates prune better than lengths.
COORDINATE_FROM = 0.7
#: Squared length below which every product of two vectors fits a 64-bit integer.
MAX_SQUARE = float(2**62)
_SLACK = 1 + 1e-9
_BLOCK = "part int, number int, size int, dim int, longest double, ids binary, data binary"
_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, square): components floor(scale * x) as 64-bit integers.

    Left out: null ids, null vectors, vectors with a null, NaN or infinite component or a squared length of 2**62 or more
    (their products don't fit a 64-bit integer).
    """
    numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(2**40))
    usable = numbers.filter("vec_id IS NOT NULL AND e IS NOT NULL").filter(~F.exists("e", bad))
    whole = usable.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole.withColumn("square", square).filter(F.col("square") < MAX_SQUARE)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks (`_BLOCK`) of at most `size` vectors of similar length, in a table. Equal lengths are spread over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            lists = table.column("v").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            dim = int(counts.max())
            data = np.zeros((len(counts), dim), "<i8")  # missing components are 0
            data[np.arange(dim) < counts[:, None]] = lists.flatten().to_numpy()
            number += 1
            row = [part, number, len(counts), dim, float(np.sqrt(max(table.column("square").to_pylist())))]
            row += [table.column("vec_id").to_numpy().astype("<i8").tobytes(), data.tobytes()]
            names = [x.split()[0] for x in _BLOCK.split(", ")]
            kinds = [pa.int32()] * 4 + [pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size).combine_chunks())
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held).combine_chunks())

    order = [F.col("square").desc(), F.xxhash64("vec_id")]
    return saved(vectors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK))


def _products(k: int):
    """Of rows that hold a block of queries (q_*), their bounds (or null) and a block of vectors (v_*): the k best
    products of each query at most, and nothing that is surely below its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def matrix(row: dict, side: str, dim: int) -> tuple:
            ids = np.frombuffer(row[f"{side}_ids"], "<i8")
            data = np.frombuffer(row[f"{side}_data"], "<i8").reshape(len(ids), -1)
            return ids, np.pad(data, ((0, 0), (0, dim - data.shape[1]))), np.sqrt((data.astype(float) ** 2).sum(1))

        def verify(q_ids, q, v_ids, v, bound, exact) -> tuple:
            score = (v.astype(float) @ q.astype(float).T).astype(np.int64) if exact else v @ q.T
            row, col = np.nonzero((score >= bound) & (v_ids[:, None] != q_ids))
            return q_ids[col], v_ids[row], score[row, col]

        def best(found: list[tuple]) -> pa.RecordBatch:
            one, other, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            order = np.lexsort((other, -score, one))
            one = one[order]
            rank = np.arange(len(one)) - np.searchsorted(one, one)
            keep = order[rank < k]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])[keep] if found else np.zeros(0, np.int64)) for i in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                dim = max(row["q_dim"], row["v_dim"])
                q_ids, q, q_long = matrix(row, "q", dim)
                v_ids, v, v_long = matrix(row, "v", dim)
                exact = float(q_long.max() * v_long.max()) < 2**52
                bound = np.frombuffer(row["bound"], "<f8") if row.get("bound") else np.full(len(q_ids), -np.inf)
                need = np.divide(bound, q_long * v_long.max() * _SLACK, out=np.full(len(bound), -1.0), where=(q_long > 0) & (bound > 0) & (v_long.max() > 0))
                need[(bound > 0) & ((q_long == 0) | (v_long.max() == 0))] = 2
                found = []
                by_coordinate = np.flatnonzero((need >= COORDINATE_FROM) & (need <= 1))
                if len(by_coordinate):
                    unit = v / np.maximum(v_long, 1e-300)[:, None]
                    sorted_by: dict[int, tuple] = {}
                    for j in by_coordinate.tolist():
                        focus = int(np.abs(q[j]).argmax())
                        if focus not in sorted_by:
                            order = np.argsort(unit[:, focus])
                            sorted_by[focus] = order, unit[order, focus]
                        order, values = sorted_by[focus]
                        share, cosine = q[j, focus] / q_long[j], need[j]
                        wide = np.sqrt(max(0.0, (1 - cosine**2) * (1 - share**2))) + 1e-9
                        # a cosine of `cosine` or more keeps the angle to the focus axis within the query's by that much
                        low = share * cosine - wide if share > -cosine else -1 - 1e-9
                        high = share * cosine + wide if share < cosine else 1 + 1e-9
                        a, b = np.searchsorted(values, [low, high + 1e-12])
                        some = order[a:b]
                        some = some[v_long[some] * q_long[j] * _SLACK >= bound[j]]
                        found.append(verify(q_ids[j : j + 1], q[j : j + 1], v_ids[some], v[some], bound[j : j + 1], exact))
                by_length = np.flatnonzero(need < COORDINATE_FROM)
                if len(by_length):
                    shortest = (need[by_length] * v_long.max()).min()
                    some = np.flatnonzero(v_long >= shortest) if shortest > 0 else slice(None)
                    found.append(verify(q_ids[by_length], q[by_length], v_ids[some], v[some], bound[by_length], exact))
                if found:
                    yield best(found)

    return run


def top_products(vectors: DataFrame, query_every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest products of each query, ties to the smaller vec_id.

    Queries are the ids divisible by `query_every` (of several rows with one id the smallest vector); candidates are all
    rows of other ids, repeated rows each. With fewer candidates all are returned. See `integer_vectors` for what is left
    out; vectors of different dimension are filled up with zeros, an empty vector is the zero vector. Other columns are
    ignored; an empty table gives no rows.
    """
    whole = saved(integer_vectors(vectors))
    asked = whole.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "square")).alias("m"))
    blocks = _blocks(whole, VECTOR_BLOCK)
    queries = _blocks(asked.select("vec_id", "m.v", "m.square"), QUERY_BLOCK)

    numbered = blocks.select("part", "number", "longest").withColumn(
        "v_block", F.row_number().over(Window.orderBy(F.desc("longest"), "part", "number")) - 1
    )  # one row per block
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    v = side(blocks.join(numbered.drop("longest"), ["part", "number"]), "v").withColumnRenamed("v_v_block", "v_block")

    # the longest vectors go to every block of queries, a copy each
    nth = queries.select("part", "number").withColumn("nth", F.row_number().over(Window.orderBy("part", "number")) - 1)  # one row per block
    asking = queries.join(nth, ["part", "number"])
    longest = v.filter("v_block = 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(max(0, queries.count() - 1)))))
    first = saved(side(asking, "q").join(longest, F.col("q_nth") == F.col("nth")).mapInArrow(_products(k), _FOUND))
    kth = (
        first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        .filter(F.col("rank") == k)
        .select("query_id", F.col("score").cast("double").alias("bound"))
    )
    bounded = saved(_with_bounds(queries, kth))
    count = blocks.count()
    pairs = (
        bounded.select("q_part", "q_number", "q_need")
        .withColumn("v_block", F.explode(F.sequence(F.lit(1), F.lit(count - 1))) if count > 1 else F.explode(F.array().cast("array<int>")))
        .join(numbered.select("v_block", "longest"), "v_block")
        .filter(F.col("longest") * _SLACK >= F.col("q_need"))
        .select("q_part", "q_number", "v_block")
    )
    rest = pairs.join(bounded, ["q_part", "q_number"]).join(v, "v_block").mapInArrow(_products(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.union(rest)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _with_bounds(queries: DataFrame, kth: DataFrame) -> DataFrame:
    """Query blocks with the bound of each of their queries and the least length of a vector that any of them needs."""
    members = queries.select("part", "number", "ids", "data", "dim")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                long = np.sqrt((np.frombuffer(row["data"], "<i8").reshape(len(ids), -1).astype(float) ** 2).sum(1))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["number"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ids), pa.array(long)],
                    ["part", "number", "at", "query_id", "long"],
                )

    each = members.mapInArrow(explode, "part int, number int, at int, query_id long, long double").join(kth, "query_id", "left")
    none = float("-inf")
    need = F.when(F.col("bound") > 0, F.when(F.col("long") > 0, F.col("bound") / F.col("long")).otherwise(F.lit(float("inf")))).otherwise(0.0)
    listed = each.groupBy("part", "number").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(none)).alias("bound")))).alias("b"),  # a block's
        F.min(need).alias("q_need"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = batch.to_pylist()
            bound = [np.array([x["bound"] for x in r["b"]], "<f8").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("number"), batch.column("q_need"), pa.array(bound, pa.binary())],
                ["q_part", "q_number", "q_need", "bound"],
            )

    names = [c for c in queries.columns if c not in ("part", "number")]
    payload = queries.select(F.col("part").alias("q_part"), F.col("number").alias("q_number"), *[F.col(c).alias(f"q_{c}") for c in names])
    return listed.mapInArrow(packed, "q_part int, q_number int, q_need double, bound binary").join(payload, ["q_part", "q_number"])
