"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

A text is the set of its runs of five words. Each element of weight x owns the strips [0, x) of a plane whose other axis
is a rank; darts hit every strip as a Poisson process in rank order, given by hashes of the element alone, so a dart is
the same in every text. A dart has a coordinate (one of K); per coordinate a text keeps its dart of least rank. Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity. Only ranks up to about (ln K + 2) K /
weight are looked at, so long texts cost one hash per element; the few texts with an empty coordinate look twice as far.

Texts that agree in a whole band of coordinates are candidates. Equal texts are one node throughout. In a bucket of m
nodes the first is compared with the others, m - 1 pairs; nodes that stay in different classes meet in further rounds
(`_rounds`), so a link between any two classes of a bucket is found whatever the first node is. In large buckets only nodes
that share a rare shingle meet (`_prefixes`), which any two similar texts do, so nothing is lost there. Candidates are checked
by their exact Jaccard similarity; classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import Words, by_text_size, mix, shingles, texts_of
from .store import saved

WORDS, SIMILARITY = 5, 0.8
#: 72 bands of 8: two texts of similarity 0.8 share fewer than two bands with a chance of 2.8 in 100,000 (none: 1.8 in a million).
BANDS, BAND = 72, 8
COORDINATES = BANDS * BAND
#: Strips and darts that are held at a time; a text of more comes alone.
DARTS = 200_000
#: First nodes of a bucket that meet all others in the next round, and by what they grow from round to round; nodes from which
#: on a bucket is divided by rare shingles.
PIVOTS, GROWTH, LARGE = 16, 4, 32
#: Nodes of a bucket that one task joins with its pivots: a bucket of more nodes is dealt out in parts of about so many.
PART = 4096
#: Whole texts that go to a Python worker at a time.
TEXT_ROWS = 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = float(1 << 32)


def _throw(cell: np.ndarray, width: np.ndarray, owner: np.ndarray, reach: np.ndarray, k: int):
    """Darts on unit strips up to rank `reach`: (owner * k + coordinate, rank, dart)."""
    found = []

    def keep(cells, number, rank, widths, owners, limit):
        dart = mix(cells ^ mix(number * _STEP + np.uint64(1)))
        good = rank <= limit
        partial = widths < 1
        if partial.any():
            good &= ~partial | ((mix(dart + np.uint64(7)) >> np.uint64(11)) * 2.0**-53 < widths)
        dart, rank, owners = dart[good], rank[good], owners[good]
        found.append((owners * k + ((dart >> np.uint64(20)) % np.uint64(k)).astype(np.int64), rank, dart))

    def gap(cells, number):
        chance = ((mix(cells + number * _STEP) >> np.uint64(11)) + 0.5) * 2.0**-53
        return (-np.log(chance) * _UNIT).astype(np.uint64)

    limit = np.minimum(reach, 2.0**31) * _UNIT
    limit = limit.astype(np.uint64)
    many = reach >= 8
    # few darts a strip: one after another, while any strip has one left
    c, w, o, top = cell[~many], width[~many], owner[~many], limit[~many]
    rank, number = np.zeros(len(c), np.uint64), 0
    while len(c):
        number += 1
        nth = np.array([number], np.uint64)
        rank = rank + gap(c, nth)
        on = rank <= top
        c, w, o, top, rank = c[on], w[on], o[on], top[on], rank[on]
        keep(c, nth, rank, w, o, top)
    # many: as many as there can be, at once
    if many.any():
        c, w, o, top, far = cell[many], width[many], owner[many], limit[many], reach[many]
        times = np.ceil(far + 7 * np.sqrt(far) + 12).astype(np.int64)
        begin = np.cumsum(times) - times
        number = (np.arange(times.sum()) - np.repeat(begin, times) + 1).astype(np.uint64)
        each = np.repeat(c, times)
        total = np.cumsum(gap(each, number))
        before = np.where(begin > 0, total[begin - 1], np.uint64(0))
        keep(each, number, total - np.repeat(before, times), np.repeat(w, times), np.repeat(o, times), np.repeat(top, times))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def dart_signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Signatures (texts x k) of weighted sets. element, weight: of all sets, one after another, each element of a set
    once; first: where each set begins (one entry more). A set without weight has a row of zeros."""
    texts = len(first) - 1
    out = np.zeros((texts, k), np.uint64)
    strips = np.ceil(weight).astype(np.int64)
    load = np.concatenate([[0], np.cumsum(strips)])[first] + np.arange(texts + 1) * int(k * np.log(k) + 2 * k)
    till = 0
    while till < texts:
        begin, till = till, max(till + 1, int(np.searchsorted(load, load[till] + DARTS, "right")) - 1)
        a, b = first[begin], first[till]
        number = strips[a:b]
        owner = np.repeat(np.repeat(np.arange(till - begin), np.diff(first[begin : till + 1])), number)
        strip = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        cell = mix(np.repeat(element[a:b], number) + strip.astype(np.uint64) * _STEP)
        width = np.minimum(1.0, np.repeat(weight[a:b], number) - strip)
        total = np.bincount(owner, width, till - begin)
        reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
        open_ = total > 0
        while open_.any():
            mine = open_[owner]
            slot, rank, dart = _throw(cell[mine], width[mine], owner[mine], reach[owner[mine]], k)
            least = np.full((till - begin) * k, 2**64 - 1, np.uint64)
            np.minimum.at(least, slot, rank)
            won = rank == least[slot]
            chosen = np.full((till - begin) * k, 2**64 - 1, np.uint64)
            np.minimum.at(chosen, slot[won], dart[won])
            full = (least != 2**64 - 1).reshape(-1, k).all(1) & open_
            out[begin:till][full] = chosen.reshape(-1, k)[full]
            open_ &= ~full
            reach = reach * 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.full(parts.shape[:2], 0, np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.view(np.int64)


def shingle_sets(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of `size` words of each text, ascending, and where each text's begin."""
    every, first = shingles(Words(texts, fold=True), size)
    sets = [np.unique(every[a:b]) for a, b in zip(first, first[1:], strict=False)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def text_key(text: Column) -> Column:
    """Identifies a whole text; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _signed(docs: DataFrame) -> DataFrame:
    """(text_key, doc_id, n: distinct shingles, bands) per row, in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches):
            element, first = shingle_sets(texts_of(batch))
            keys = band_keys(dart_signatures(element, np.ones(len(element)), first))
            count = np.diff(first)
            ends = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[count > 0].ravel()))
            columns = [batch.column("text_key"), batch.column("doc_id"), pa.array(count.astype(np.int32)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "doc_id", "n", "bands"])

    rows = docs.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, "text_key binary, doc_id long, n int, bands array<long>"), TEXT_ROWS)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in `wanted` (node, text_key, rep), in a table. Each node's text comes from the row
    with its smallest id, so copies of a text do not meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches):
            element, first = shingle_sets(texts_of(batch))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(element.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])

    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    met = rows.join(wanted, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("rep")))
    return saved(met.select("node", "text").mapInArrow(run, "node long, shingles array<long>"), TEXT_ROWS)


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least `similarity`, in a table."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9
    return saved(both.filter(near).select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): the label is the smallest node of its connected component.

    Every round each node takes the smallest label among its neighbours' and its own, and then its label's label, so
    labels travel at growing distance. Rounds end when no label changes.
    """
    edges = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(edges.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        lower = (
            labels.join(near, labels["node"] == near["a"], "left")
            .join(jump, F.col("label") == F.col("at"), "left")
            .select("node", F.col("label").alias("old"), F.least("label", "near", "further").alias("label"))
        )
        lower = saved(lower)
        labels = lower.select("node", "label")
        if lower.filter("label < old").isEmpty():
            return labels


def _rounds(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of the nodes that have a link."""
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter(F.col("first") < F.col("last"))
    live = saved(members.join(buckets.select("key", "first"), "key"))
    sets = _sets(docs, nodes.join(live.select("node").distinct(), "node").select("node", "text_key", "rep"))
    sizes = nodes.select(F.col("node").alias("first"), F.col("n").alias("m"))
    fits = lambda x, y: (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9)
    pairs = (
        live.filter(F.col("node") != F.col("first"))
        .select("first", "node", "n")
        .distinct()
        .join(sizes, "first")
        .filter(fits(F.col("n"), F.col("m")))
        .select(F.col("first").alias("a"), F.col("node").alias("b"))
    )
    links = _links(pairs, sets, similarity)
    labels = components(links)
    # what is left: the other nodes of buckets that are not of one class
    rest = live.filter(F.col("node") != F.col("first")).select("key", "node", "n")
    rest = saved(_mixed(rest.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))))
    if rest.isEmpty():
        return labels
    # Large buckets of unlike texts are divided: similar texts share a shingle among the rarest of both, and meet there.
    large = rest.filter(F.col("m") > LARGE).select("node", "label").distinct()
    unsolved = saved(sets.join(rest.select("node").distinct(), "node", "left_semi"))
    finer = saved(_prefixes(unsolved.join(large, "node"), similarity))
    small = rest.filter(F.col("m") <= LARGE).withColumn("pos", F.lit(0))
    rest = small.unionByName(_mixed(finer)).select("key", "node", "n", "pos", "label", "m")
    first = PIVOTS
    while True:
        # nodes of a bucket's smaller classes come first: once they have met all others, the largest class alone is left
        rest = saved(rest)
        pivots = saved(_pivots(rest, first))
        parts = F.ceil(F.col("m") / PART).cast("int")
        met = pivots.select(
            "key",
            F.col("node").alias("a"),
            F.col("n").alias("na"),
            F.col("pos").alias("pa"),
            F.col("label").alias("la"),
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        )
        # what two texts share stands at their first common shingle or behind it
        most = F.least(F.col("n") - F.col("pos"), F.col("na") - F.col("pa"))
        enough = most * (1 + similarity) >= similarity * (F.col("n") + F.col("na")) - 1e-6
        pairs = (
            rest.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
            .join(met, ["key", "part"])
            .filter((F.col("la") != F.col("label")) & fits(F.col("n"), F.col("na")) & enough)
            .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
            .distinct()
        )
        links = links.union(_links(pairs, unsolved, similarity))
        rest = saved(_mixed(rest.join(pivots.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "pos", "label")))
        if rest.isEmpty():
            return components(links)
        first *= GROWTH


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, pos, label): the rarest shingles (key) of each of `sets` (node, shingles, label) that others hold too,
    and their places in the order of rareness.

    Texts of that similarity share so much of either that they share one of these, whatever the order. Shingles of one text
    alone come first, so a text with many of its own has few rows here or none.
    """
    held = sets.select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = held.join(common, "key").groupBy("node").agg(
        F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared")
    )
    alone = F.col("n") - F.size("shared")
    looked_at = F.col("n") - F.ceil(similarity * F.col("n") - 1e-6).cast("int") + 1
    rows = ranked.withColumn("alone", alone).withColumn("take", looked_at - F.col("alone")).filter("take > 0")
    placed = rows.select("node", "label", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("at", "s"))
    return placed.select(F.col("s.key").alias("key"), "node", "n", (F.col("alone") + F.col("at")).alias("pos"), "label")


def _pivots(rest: DataFrame, most: int = PIVOTS) -> DataFrame:
    """The first `most` rows of each bucket, by size of their class in it, label and node.

    Classes are counted in a map-side aggregate; the first nodes are of the first classes. Both ranks are filtered at
    once, so each task keeps that many rows of a bucket before the exchange, and no whole bucket is sorted in a task.
    """
    first = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("place") <= most).drop("place")
    smallest = first(rest.groupBy("key", "label").agg(F.count("*").alias("members")), "members", "label")
    return first(rest.join(smallest, ["key", "label"]), "members", "label", "node")


def _mixed(rest: DataFrame) -> DataFrame:
    """The rows of buckets with nodes of two classes or more, with the bucket's size m."""
    mixed = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"))
    return rest.join(mixed.filter(F.col("x") < F.col("y")).select("key", "m"), "key")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, doc_id, class_id, node, rep, first) per row of `docs`; see near_duplicates."""
    signed = _signed(docs)
    nodes = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))  # fixed once it is written
    labels = _rounds(docs, nodes, similarity)
    named = nodes.select("text_key", "node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    leaders = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("lead"))
    told = named.join(leaders, "label").select("text_key", F.col("lead.rep").alias("class_id"), (F.col("lead.node") == F.col("node")).alias("leads"), "label")
    return signed.select("text_key", "doc_id").join(saved(told), "text_key").withColumn(
        "first", F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, class_id (the smallest doc_id of its class), first.

    Texts are compared as sets of their runs of five words (`batches.Words`; shorter texts are one run) and linked from
    `similarity` on; a class is what links join. Equal texts are one class; texts without words only if they are equal;
    a null text is an empty one. Rows of one id but different texts may have different classes; a class all of whose ids
    are null has a null class_id. Repeated rows give repeated rows. first marks the rows to keep when one text of each
    class stays. Other columns are ignored.
    """
    return classes(docs, similarity).select("doc_id", "class_id", "first")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of `docs`, with all its columns, whatever their names: the one with the smallest doc_id (ids
    that are null last). Of repeated rows one stays; null and empty texts are one class; no rows give no rows."""
    kept = classes(docs, similarity).filter("first").select(F.col("text_key").alias("key"), F.col("doc_id").alias("id")).distinct()
    keyed = docs.select(F.struct("*").alias("__row"), text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"))
    met = keyed.join(kept, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return met.dropDuplicates(["text_key", "doc_id"]).select("__row.*")
