"""Burrows's Delta over function-word vectors: profiles, bands, imposters, chunking."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..functions.fixed import FUNCTION_WORDS
from ..session import beside, cut_lineage, spread
from .stylometry import dense

WIDTH = len(FUNCTION_WORDS)
MIN_CHUNK_WORDS = 1000
MIN_BAND_DOCS = 6
BAND_ITERATIONS = 500
IMPOSTER_TRIALS = 150
FEATURE_SHARE = 0.5
MIN_FEATURES = 5
#: Draws of one group and iteration that documents leave their tasks for, and bits that one counting pass decides.
CANDIDATES, SLICE_BITS = 64, 10


def reference_profile(samples: DataFrame, *groups: str) -> DataFrame:
    """``*groups, pos, mean, sd`` per function word. Never build it from only the two compared samples."""
    return (
        samples.select(*groups, F.posexplode("freqs").alias("pos", "f"))
        .groupBy(*groups, "pos")
        .agg(F.avg("f").alias("mean"), F.coalesce(F.stddev_samp("f"), F.lit(0.0)).alias("sd"))
    )


def mean_vector(samples: DataFrame, *groups: str) -> DataFrame:
    """``*groups, pos, f``: average vector in long form."""
    return (
        samples.select(*groups, F.posexplode("freqs").alias("pos", "f")).groupBy(*groups, "pos").agg(F.avg("f").alias("f"))
    )


def _sd_array(profile: DataFrame, *groups: str) -> DataFrame:
    """Profile deviations as one array per group (150 entries)."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "sd")))
    return profile.groupBy(*groups).agg(F.transform(entries, lambda x: x["sd"]).alias("sds"))


def delta_expr(a: Column, b: Column, sds: Column) -> Column:
    """Mean |z_a - z_b| over words with spread; NULL when there are none. The means cancel."""
    gaps = F.zip_with(F.arrays_zip(a.alias("x"), b.alias("y")), sds, lambda p, sd: F.when(sd != 0, F.abs(p["x"] - p["y"]) / sd))
    used = F.filter(gaps, lambda g: g.isNotNull())
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda acc, g: acc + g) / F.size(used))


def burrows_delta(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Delta of each row's ``a_freqs`` and ``b_freqs`` under one profile."""
    sds = _sd_array(profile)
    return (
        pairs.withColumn("_one", F.lit(1))
        .join(F.broadcast(sds.withColumn("_one", F.lit(1))), "_one")
        .withColumn("delta", delta_expr(F.col("a_freqs"), F.col("b_freqs"), F.col("sds")))
        .drop("_one", "sds")
    )


def register_separation(samples: DataFrame, group: str, first: str, second: str, profile: DataFrame, *by: str) -> DataFrame:
    """Delta between the mean vectors of two registers (per ``by``)."""
    means = mean_vector(samples.filter(F.col(group).isin(first, second)), *by, group)
    wide = means.groupBy(*by, "pos").agg(
        F.max(F.when(F.col(group) == first, F.col("f"))).alias("a"),
        F.max(F.when(F.col(group) == second, F.col("f"))).alias("b"),
    )
    joined = wide.join(F.broadcast(profile.filter("sd <> 0").select("pos", "sd")), "pos")
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col("a") - F.col("b")) / F.col("sd")).alias("separation"))


_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
#: Messages of one block that are hashed at a time.
HASHED = 20_000


def _md5_heads(block: np.ndarray, size: int) -> np.ndarray:
    """The first 32 bits of the MD5 of many messages of `size` bytes, at most 55, in rows of 64 that end in zeros."""
    block[:, size], block[:, 56:64] = 128, np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
    empty = [size // 4 < k < 14 or k == 15 for k in range(16)]
    a, b, c, d = (np.full(len(block), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if not empty[k]:
            f += words[k]
        high = f << _TURNS[i]
        f >>= np.uint32(32) - _TURNS[i]
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (a + np.uint32(0x67452301)).byteswap()


def _draws(seed: int, keys: list[str], iterations: int) -> np.ndarray:
    """The draws of all keys and iterations, as ``functions.text.draw`` makes them: 32 bits each."""
    heads = [f"{seed}|band|{it}|".encode() for it in range(1, iterations + 1)]
    tails = [key.encode() for key in keys]
    out = np.empty((len(keys), iterations), np.uint32)
    widths = np.array([len(t) for t in tails], int)
    for head in dict.fromkeys(len(h) for h in heads):
        its = np.array([i for i, h in enumerate(heads) if len(h) == head])
        for tail in np.unique(widths):
            rows, size = np.flatnonzero(widths == tail), head + int(tail)
            if size > 55:
                for row in rows:
                    for it in its:
                        out[row, it] = int.from_bytes(hashlib.md5(heads[it] + tails[row]).digest()[:4], "big")
                continue
            ends = np.frombuffer(b"".join(tails[row] for row in rows), np.uint8).reshape(len(rows), tail)
            step = max(1, HASHED // len(rows))
            for some in (its[k : k + step] for k in range(0, len(its), step)):
                block = np.zeros((len(rows), len(some), 64), np.uint8)
                block[:, :, :head] = np.frombuffer(b"".join(heads[it] for it in some), np.uint8).reshape(len(some), head)
                block[:, :, head:size] = ends[:, None]
                out[np.ix_(rows, some)] = _md5_heads(block.reshape(-1, 64), size).reshape(len(rows), len(some))
    return out


def _by_group(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Pieces of batches that hold one group each, of at most so many rows. Columns: g, key, name, freqs."""
    for batch in batches:
        names = batch.column("g").to_pylist()
        for g in dict.fromkeys(names):
            at = [k for k, x in enumerate(names) if x == g]
            for k in range(0, len(at), rows):
                yield g, batch.take(pa.array(at[k : k + rows]))


def _halves(docs: DataFrame, sizes: dict, iterations: int, seed: int) -> dict:
    """``{group: (draw, key) of each iteration}``: the last document of the first half, by (draw, key).

    Selection by counting: each task counts its draws per group, iteration and slice (the next ten bits); the sums tell the
    slice that holds the wanted rank. Only when few draws are left in that slice do documents leave the tasks, so what is
    exchanged depends on iterations and groups, not on documents.
    """
    kind = docs.schema["key"].dataType.simpleString()
    group_kind = docs.schema["g"].dataType.simpleString()
    half = {g: n // 2 for g, n in sizes.items()}
    lead = {g: np.zeros(iterations, np.uint64) for g in sizes}  # bits known so far
    before = {g: np.zeros(iterations, np.int64) for g in sizes}  # draws of smaller slices
    bits, left = 0, dict(sizes)
    while bits < 30 and max(left.values()) > CANDIDATES:
        width = min(SLICE_BITS, 32 - bits)

        def count(batches):
            sums = {}
            for g, part in _by_group(batches):
                d = _draws(seed, part.column("name").to_pylist(), iterations).astype(np.uint64)
                inside = (d >> np.uint64(32 - bits)) == lead[g] if bits else np.ones(d.shape, bool)
                place = ((d >> np.uint64(32 - bits - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                place += np.arange(iterations) << width
                found = np.bincount(place[inside], minlength=iterations << width)
                sums[g] = sums.get(g, 0) + found
            for g, found in sums.items():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(iterations + 1) << width, pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([pa.array([g] * iterations, g_type), pa.array(np.arange(iterations)), lists], ["g", "it", "counts"])

        def pick(table):
            total = np.sum([np.asarray(x) for x in table.column("counts").to_pylist()], axis=0)
            g, it = table.column("g")[0].as_py(), table.column("it")[0].as_py()
            sums = before[g][it] + np.cumsum(total)
            at = int(np.searchsorted(sums, half[g]))
            return pa.table({"g": pa.array([g], g_type), "it": [it], "slice": [at], "before": [int(sums[at] - total[at])], "n": [int(total[at])]})

        g_type = to_arrow_type(docs.schema["g"].dataType)
        counted = docs.select("g", "name").mapInArrow(count, f"g {group_kind}, it long, counts array<long>")
        rows = counted.groupBy("g", "it").applyInArrow(pick, f"g {group_kind}, it long, slice long, before long, n long").collect()
        left = {}
        lead, before = {g: x.copy() for g, x in lead.items()}, {g: x.copy() for g, x in before.items()}
        for r in rows:  # one row per group and iteration
            lead[r.g][r.it] = (int(lead[r.g][r.it]) << width) | r.slice
            before[r.g][r.it] = r.before
            left[r.g] = max(left.get(r.g, 0), r.n)
        bits += width

    def candidates(batches):
        for g, part in _by_group(batches):
            d = _draws(seed, part.column("name").to_pylist(), iterations)
            inside = (d.astype(np.uint64) >> np.uint64(32 - bits)) == lead[g] if bits else np.ones(d.shape, bool)
            row, it = np.nonzero(inside)
            wanted = half[g] - before[g][it]
            columns = [pa.array([g] * len(row), part.column("g").type), pa.array(it), part.column("key").take(pa.array(row)), pa.array(d[row, it].astype(np.int64)), pa.array(wanted)]
            yield pa.RecordBatch.from_arrays(columns, ["g", "it", "key", "d", "wanted"])

    few = docs.select("g", "key", "name").mapInArrow(candidates, f"g {group_kind}, it long, key {kind}, d long, wanted long")
    place = F.row_number().over(W.partitionBy("g", "it").orderBy("d", "key"))
    last = few.withColumn("_at", place).filter(F.col("_at") == F.col("wanted")).select("g", "it", "d", "key").collect()
    out = {g: (np.zeros(iterations, np.uint32), [None] * iterations) for g in sizes}
    for r in last:
        out[r.g][0][r.it] = r.d
        out[r.g][1][r.it] = r.key
    return out


def within_band(samples: DataFrame, group: str, key: str, iterations: int = BAND_ITERATIONS, seed: int = 1, profile: DataFrame | None = None) -> DataFrame:
    """``group, documents, iterations, median, low, high, underpowered`` of split-half Deltas.

    Each iteration splits the group's documents in two random halves by a keyed draw and compares the half means. Where the
    halves part is found by counting (`_halves`); then one more pass adds up the first halves, all iterations of a batch as
    one matrix product, and the second ones are what is left of the group. Draws are made where they are needed and never
    stored: neither exchange has a row per document and iteration. Pass a table: it is read three times. On the driver:
    one row per group and iteration.
    """
    sizes = samples.groupBy(group).agg(F.count("*").alias("documents"))
    enough = {r[0]: r[1] for r in sizes.filter((F.col("documents") >= MIN_BAND_DOCS) & F.col(group).isNotNull()).collect()}
    docs = samples.select(F.col(group).alias("g"), F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), "freqs")
    docs = spread(docs.filter(F.col("g").isin(list(enough))), "key")  # many draws come of few bytes
    kind = samples.schema[group].dataType.simpleString()
    ends = _halves(docs, enough, iterations, seed) if enough else {}

    def half_sums(batches):
        sums = {}
        for g, part in _by_group(batches):
            d = _draws(seed, part.column("name").to_pylist(), iterations)
            draws, keys = ends[g]
            member = d < draws
            for row, it in zip(*np.nonzero(d == draws), strict=True):
                member[row, it] = part.column("key")[int(row)].as_py() <= keys[it]
            f = np.vstack(part.column("freqs").to_pylist())
            sums[g] = sums.get(g, 0) + member.T.astype(float) @ f
        for g, found in sums.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, WIDTH), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([g] * iterations, g_type), pa.array(np.arange(iterations)), lists], ["g", "it", "a"])

    def added(table):
        whole = np.sum(np.vstack(table.column("a").to_pylist()), axis=0)
        n = enough[table.column("g")[0].as_py()] // 2
        return pa.table({"g": table.column("g")[:1], "it": table.column("it")[:1], "a": pa.array([(whole / n).tolist()]), "s": pa.array([whole.tolist()])})

    g_type = to_arrow_type(samples.schema[group].dataType)
    # one row per (task, group, iteration) is exchanged, whatever the number of documents
    partial = docs.mapInArrow(half_sums, f"g {kind}, it long, a array<double>")
    halves = partial.groupBy("g", "it").applyInArrow(added, f"g {kind}, it long, a array<double>, s array<double>")
    own = reference_profile(docs, "g")
    means = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"])
    whole = own.groupBy("g").agg(means.alias("means")).join(sizes.withColumnRenamed(group, "g"), "g")
    rest = F.zip_with("means", "s", lambda m, x: (m * F.col("documents") - x) / (F.col("documents") - F.floor(F.col("documents") / 2)))
    split = halves.join(whole, "g").select("g", "a", rest.alias("b"))
    sds = _sd_array(own, "g") if profile is None else _sd_array(profile)
    scored = split.join(sds, "g") if profile is None else beside(split, sds)
    deltas = scored.select("g", delta_expr(F.col("a"), F.col("b"), F.col("sds")).alias("d")).filter("d IS NOT NULL")
    bands = deltas.groupBy(F.col("g").alias(group)).agg(
        F.count("*").alias("iterations"),
        F.expr("percentile(d, 0.5)").alias("median"),
        F.expr("percentile(d, 0.025)").alias("low"),
        F.expr("percentile(d, 0.975)").alias("high"),
    )
    return sizes.join(bands, group, "left").select(
        group,
        "documents",
        F.coalesce("iterations", F.lit(0)).alias("iterations"),
        "median",
        "low",
        "high",
        (F.col("documents") < MIN_BAND_DOCS).alias("underpowered"),
    )


def judge_band(observed: Column, high: Column, underpowered: Column) -> Column:
    """Inside the band iff observed <= high; NULL without a usable band. The low side is not tested."""
    return F.when(~underpowered & high.isNotNull(), observed <= high)


def _masks(trials: int, seed: int, share: float) -> np.ndarray:
    """Feature masks by the same keyed draws as :func:`draw`; they depend on parameters only."""
    def u(t: int, pos: int) -> float:
        return int(hashlib.md5(f"{seed}|mask|{t}|{pos}".encode()).hexdigest()[:8], 16) / 4294967296.0

    return np.array([[u(t, p) < share for p in range(WIDTH)] for t in range(1, trials + 1)], dtype=float)


def general_imposters(
    candidate_freqs: DataFrame,
    samples: DataFrame,
    trials: int = IMPOSTER_TRIALS,
    seed: int = 7,
    share: float = FEATURE_SHARE,
) -> DataFrame:
    """``score, trials``: share of random feature halves in which the author is nearer than any impostor.

    ``candidate_freqs`` has one row ``freqs``; ``samples`` has ``key, side ('author'|'impostor'),
    freqs``. Distances are a small matrix product per Arrow batch; only one minimum per trial and
    side is exchanged.
    """
    everyone = samples.select("freqs").unionByName(candidate_freqs.select("freqs"))
    sds = _sd_array(reference_profile(everyone)).withColumn("_one", F.lit(1))
    target = candidate_freqs.select(F.col("freqs").alias("cand"), F.lit(1).alias("_one")).join(sds, "_one")
    masks = _masks(trials, seed, share)

    def distances(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            f, c, s = (np.vstack(pdf[col].to_numpy()) for col in ("freqs", "cand", "sds"))
            ok = s != 0
            gap = np.where(ok, np.abs(f - c) / np.where(ok, s, 1.0), 0.0)
            used = ok.astype(float) @ masks.T
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.where(used > 0, (gap @ masks.T) / used, np.inf)
            best = pd.DataFrame(d).assign(side=pdf["side"].to_numpy()).groupby("side").min()
            for side, row in best.iterrows():
                yield pd.DataFrame({"side": side, "trial": np.arange(1, trials + 1), "d": row.to_numpy()})

    rows = samples.select("side", "freqs", F.lit(1).alias("_one")).join(F.broadcast(target), "_one")
    near = rows.mapInPandas(distances, "side string, trial int, d double").groupBy("trial", "side").agg(F.min("d").alias("d"))
    by_trial = near.groupBy("trial").agg(
        F.min(F.when(F.col("side") == "author", F.col("d"))).alias("author"),
        F.min(F.when(F.col("side") == "impostor", F.col("d"))).alias("impostor"),
    )
    big_enough = [int(t) + 1 for t in np.flatnonzero(masks.sum(axis=1) >= MIN_FEATURES)]
    infinite = F.lit(float("inf"))
    ran = by_trial.filter(F.col("trial").isin(big_enough) & (F.col("author") < infinite) & (F.col("impostor") < infinite))
    return ran.agg(
        (F.count_if(F.col("author") < F.col("impostor")) / F.count("*")).alias("score"), F.count("*").alias("trials")
    )


def aggregate_chunks(
    docs: DataFrame, group: str, order: str, words: str = "words", min_words: int = MIN_CHUNK_WORDS, block: int = 1_000_000, fan: int = 32
) -> DataFrame:
    """Number the chunks of consecutive documents that reach ``min_words``: adds ``chunk`` (from 0).

    The running count restarts whenever a chunk fills, which no window frame expresses, and one
    group may be far too long for one task. But the carried count is always below ``min_words``, so
    a block of documents is a small table: carried-in count -> (carried-out count, chunks closed).
    Blocks build their tables in parallel, a scan in levels of ``fan`` tables links them, and a last pass
    numbers the documents. The remainder joins the last full chunk.
    """
    cut = docs.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    name = docs.schema[group].dataType.simpleString()

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        carry = np.arange(min_words)
        closed = np.zeros(min_words, dtype=np.int64)
        for w in pdf.sort_values(order)[words].to_numpy():
            carry = carry + w
            full = carry >= min_words
            closed += full
            carry = np.where(full, 0, carry)
        return pd.DataFrame(
            {group: [pdf[group].iloc[0]], "_block": [pdf["_block"].iloc[0]], "carry": [carry.tolist()], "closed": [closed.tolist()]}
        )

    tables = cut.select(group, "_block", order, words).groupBy(group, "_block").applyInPandas(
        table, f"{group} {name}, _block long, carry array<long>, closed array<long>"
    )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One table for consecutive blocks: what the next one makes of each carry that comes out."""
        carry, closed = np.arange(min_words), np.zeros(min_words, dtype=np.int64)
        for carries, closes in pdf.sort_values("_block")[["carry", "closed"]].itertuples(index=False):
            closed, carry = closed + np.asarray(closes)[carry], np.asarray(carries)[carry]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "_block": [pdf["_up"].iloc[0]], "carry": [carry.tolist()], "closed": [closed.tolist()]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Carry and chunk number at which each of some consecutive blocks begins, from where their group begins."""
        carry, first, rows = int(pdf["start"].iloc[0]), int(pdf["first"].iloc[0]), []
        for b, carries, closes in pdf.sort_values("_block")[["_block", "carry", "closed"]].itertuples(index=False):
            rows.append((b, carry, first))
            carry, first = int(carries[carry]), first + int(closes[carry])
        return pd.DataFrame(rows, columns=["_block", "start", "first"]).assign(**{group: pdf[group].iloc[0], "total": int(pdf["total"].iloc[0])})

    # a parallel scan: tables are composed upwards in levels of `fan` and the starts are told downwards, so no task holds more
    above = F.floor(F.col("_block") / fan)
    columns = f"{group} {name}, _block long, carry array<long>, closed array<long>"
    levels = [cut_lineage(tables)]
    while not levels[-1].groupBy(group).count().filter("count > 1").isEmpty():
        levels.append(cut_lineage(levels[-1].withColumn("_up", above).groupBy(group, "_up").applyInPandas(compose, columns)))
    linked = levels.pop().select(group, "_block", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("first"), F.get("closed", F.lit(0)).alias("total"))
    for level in reversed(levels):
        met = level.withColumn("_up", above).join(linked.withColumnRenamed("_block", "_up"), [group, "_up"])
        linked = cut_lineage(met.groupBy(group, "_up").applyInPandas(link, f"_block long, start long, first long, {group} {name}, total long"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        carry, chunk, last = int(pdf["start"].iloc[0]), int(pdf["first"].iloc[0]), max(int(pdf["total"].iloc[0]) - 1, 0)
        out = []
        for w in pdf[words].to_numpy():
            out.append(min(chunk, last))
            carry += w
            if carry >= min_words:
                chunk, carry = chunk + 1, 0
        return pd.DataFrame({group: pdf[group], order: pdf[order], "chunk": out})

    order_type = docs.schema[order].dataType.simpleString()
    numbered = (
        cut.select(group, "_block", order, words)
        .join(linked, [group, "_block"])
        .groupBy(group, "_block")
        .applyInPandas(number, f"{group} {name}, {order} {order_type}, chunk long")
    )
    return docs.join(numbered, [group, order])


def chunk_vectors(numbered: DataFrame, counts: DataFrame, group: str, key: str, chunk: str = "chunk") -> DataFrame:
    """``group, chunk, freqs``: function-word shares of whole chunks.

    Counts add up over joined texts, so the texts themselves are never concatenated. ``numbered``
    has ``key, group, chunk, tokens``; ``counts`` has ``key, pos, c``.
    """
    places = numbered.select(key, group, chunk)
    sums = counts.join(places, key).groupBy(group, chunk, "pos").agg(F.sum("c").alias("c"))
    sizes = numbered.groupBy(group, chunk).agg(F.sum("tokens").alias("tokens"))
    return dense(sums, sizes, [group, chunk], "tokens")
