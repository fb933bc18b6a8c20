"""Repeated passages by relative Lempel-Ziv parsing against blocks of reference windows.

Every document is parsed against each block that can hold a match for it. A window (35 words) belongs to the block of its
anchor, the least hash among its runs of ten words; equal windows have equal anchors, so a window's other places stand in
the same block and a document meets no other block. Only anchors that occur twice at least in the corpus have a block;
the windows sent there are 64-bit hashes, one a window, and never texts. A block indexes its windows by their first place;
a piece of a document is factored greedily: a factor runs on as long as the next window stands next in the reference. Where
a factor ends the next window is looked up anew, so windows across factor boundaries are found as well. Every factor is at
least one window long and thus a duplicate span, and the reference place is a duplicate too.

A block of more than `HOT` pieces is dealt out: each part is parsed against itself, and the distinct windows of the parts
meet by hash, so that each part learns the places in other parts (`_foreign`). Equal texts take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SOLID, Words, by_text_size, mix, run_hashes, texts_of
from .neardup import text_key
from .store import saved

#: Words of a window, and of the runs that anchors are chosen from.
WINDOW, GRAM = 35, 10
#: Pieces of one anchor in one task.
HOT = 1000
NOTHING = hashlib.sha256(b"").digest()


def anchored(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of many texts: (text, first window, number of windows, anchor) of each, and the hashes of all windows, piece
    after piece. A piece is a run of consecutive windows with the same anchor place; positions count from the text's first
    word. A text of fewer than `window` words has none."""
    none = np.zeros(0, np.int64)
    counts = np.diff(words.first)
    if not (counts >= window).any():
        return none, none, none, none, none
    total = len(words.hash)
    grams, every = run_hashes(words.hash, gram), run_hashes(words.hash, window)
    # leftmost least gram of each window, by doubling
    size = window - gram + 1
    best, width = np.arange(len(grams)), 1
    while 2 * width <= size:
        right = best[width:]
        left = best[: len(right)]
        best, width = np.where(grams[right] < grams[left], right, left), 2 * width
    right = best[size - width :]
    left = best[: len(right)]
    best = np.where(grams[right] < grams[left], right, left)
    last = np.repeat(words.first[1:], counts)
    at = np.flatnonzero(np.arange(total) + window <= last)
    place = best[at]
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    text = np.repeat(np.arange(len(counts)), counts)[at[begins]]
    return text, at[begins] - words.first[text], np.diff(np.append(begins, len(at))), grams[place[begins]].view(np.int64), every[at].view(np.int64)


def _words(batch: pa.RecordBatch) -> Words:
    return Words(texts_of(batch), inside=SOLID, lower=False)


def _signed(docs: DataFrame, window: int) -> DataFrame:
    """(text_key, doc_id, n words, whole: SHA-256 of the words, anchors) per row, in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches):
            text, _, _, anchor, _ = anchored(_words(batch), window)
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch)]
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            columns = [
                batch.column("text_key"), batch.column("doc_id"), pa.array([len(s) for s in split], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(s)).digest() for s in split], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchor)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "doc_id", "n", "whole", "anchors"])

    return saved(_rows(docs).mapInArrow(run, "text_key binary, doc_id long, n long, whole binary, anchors array<long>"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _suspects(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text, anchors, times) of the texts with an anchor that occurs twice in all texts, in a table: those anchors and
    how often each occurs. The text comes from the rows with its smallest id."""
    seen = texts.select("node", F.explode("anchors").alias("anchor"))
    # a table of its own, so that the join below has two exchanges and a hot anchor can be split
    times = saved(seen.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"))
    held = seen.join(times, "anchor").groupBy("node").agg(F.collect_list(F.struct("anchor", "m")).alias("held"))
    wanted = texts.select("node", F.col("text_key").alias("key"), "rep").join(held, "node")
    met = _rows(docs).join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return saved(met.select("node", "text", F.col("held.anchor").alias("anchors"), F.col("held.m").alias("times")))


_PIECE = "anchor long, salts int, salt int, node long, start int, hashes array<long>, nodes array<long>, starts array<int>"


def _pieces(suspects: DataFrame, window: int, hot: int) -> DataFrame:
    """The pieces of the suspects whose anchors occur twice, each for one part of its anchor's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in by_text_size(batches):
            text, start, size, anchor, hashes = anchored(_words(batch), window)
            node = batch.column("node").to_numpy()
            lists, times = batch.column("anchors"), batch.column("times")
            owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
            told, number = lists.flatten().to_numpy(), times.flatten().to_numpy()
            fresh = np.concatenate([[len(node) > 0 and node[0] != seen], node[1:] != node[:-1]])  # repeated rows stand together
            seen = node[-1] if len(node) else seen
            # how often each piece's anchor occurs: look (text, anchor) up among the told ones
            names, code = np.unique(np.concatenate([told, anchor]), return_inverse=True)
            mine, theirs = text * len(names) + code[len(told) :], owner * len(names) + code[: len(told)]
            order = np.argsort(theirs)
            at = np.searchsorted(theirs[order], mine)
            found = np.zeros(len(mine), bool)
            inside = at < len(theirs)
            found[inside] = theirs[order][at[inside]] == mine[inside]
            found &= fresh[text]
            if not found.any():
                continue
            m = number[order][at[found]]
            salts = (m + hot - 1) // hot
            mixed = mix(node[text[found]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[found].astype(np.uint64))
            salt = (mixed % salts.astype(np.uint64)).astype(np.int32)
            kept = size[found]
            yield _batch(anchor[found], salts, salt, node[text[found]], start[found], hashes[np.repeat(found, size)], kept)

    return suspects.mapInArrow(run, _PIECE)


def _batch(anchor, salts, salt, node, start, hashes, sizes, nodes=None, starts=None) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
    rows = len(sizes)
    columns = [
        pa.array(anchor, pa.int64()), pa.array(salts, pa.int32()), pa.array(salt, pa.int32()),
        pa.nulls(rows, pa.int64()) if node is None else pa.array(node, pa.int64()),
        pa.nulls(rows, pa.int32()) if start is None else pa.array(start, pa.int32()),
        lists(hashes, pa.int64()),
        pa.nulls(rows, pa.list_(pa.int64())) if nodes is None else lists(nodes, pa.int64()),
        pa.nulls(rows, pa.list_(pa.int32())) if starts is None else lists(starts, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECE.split(", ")])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, about a batch at a time or one group, with the number of each row's group."""

    def table(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        return whole, np.concatenate([[0], np.cumsum(_changes(whole, keys))])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield table(held)
            held = []
        cuts = np.flatnonzero(_changes(batch, keys)) + 1
        if len(cuts):
            yield table([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield table(held)


def _changes(rows, keys: list[str]) -> np.ndarray:
    out = np.zeros(rows.num_rows - 1, bool)
    for k in keys:
        values = rows.column(k).to_numpy()
        out |= values[1:] != values[:-1]
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


class _Index:
    """The windows of whole blocks (or parts of them): group, hash and place of each, and the places with equal hashes."""

    def __init__(self, table: pa.Table, group: np.ndarray):
        lists = _column(table, "hashes")
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        begin = np.cumsum(self.sizes) - self.sizes
        self.hash, self.group = lists.flatten().to_numpy(), group[self.row]
        node = _column(table, "node")
        told = np.asarray(node.is_null())
        self.foreign = told[self.row]  # rows that tell places elsewhere
        self.node = node.fill_null(0).to_numpy()[self.row]
        self.start = _column(table, "start").fill_null(0).to_numpy()[self.row].astype(np.int64) + np.arange(len(self.row)) - begin[self.row]
        if told.any():
            self.node[self.foreign] = _column(table, "nodes").flatten().to_numpy()
            self.start[self.foreign] = _column(table, "starts").flatten().to_numpy()
        self.order = np.lexsort((self.hash, self.group))
        g, h = self.group[self.order], self.hash[self.order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]) if len(g) else np.zeros(0, bool)
        self.begins = np.flatnonzero(new)
        self.times = np.diff(np.append(self.begins, len(g)))

    def reference(self) -> np.ndarray:
        """For each window the first window equal to it; for a first one, the second; -1 if there is none."""
        first = self.order[self.begins]
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(first, self.times)
        second = self.order[np.minimum(self.begins + 1, len(self.order) - 1)]
        out[first] = np.where(self.times > 1, second, -1)
        return out


def _foreign(hot: DataFrame) -> DataFrame:
    """For each part of a large block the places of its windows in other parts, one for each. First every part tells its
    distinct windows, dealt out by hash over as many buckets as the block has parts; then each bucket answers."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["anchor", "salt"]):
            index = _Index(table, group)
            one = index.order[index.begins]
            salts = _column(table, "salts").to_numpy()[index.row[one]]
            bucket = ((index.hash[one].view(np.uint64) >> np.uint64(20)) % salts.astype(np.uint64)).astype(np.int32)
            yield from _lists(table, index, one, bucket, index.node[one], index.start[one])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["anchor", "bucket"]):
            index = _Index(table, group)
            place = index.reference()
            one = np.flatnonzero(place >= 0)
            yield from _lists(table, index, one, None, index.node[place[one]], index.start[place[one]])

    def _lists(table, index, one, bucket, node, start):
        """One row for each row (and bucket) of the table that has windows among `one`."""
        row = index.row[one]
        order = np.lexsort((row,) if bucket is None else (bucket, index.group[one]))
        row, one, node, start = row[order], one[order], node[order], start[order]
        key = row if bucket is None else index.group[one] * (int(bucket.max(initial=0)) + 1) + bucket[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(key)))
        of = lambda name: _column(table, name).to_numpy()[row[begins]]
        out = _batch(of("anchor"), of("salts"), of("salt"), None, None, index.hash[one], sizes, node, start)
        yield out if bucket is None else out.append_column("bucket", pa.array(bucket[order][begins], pa.int32()))

    parts = hot.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "node", "start")
    told = parts.mapInArrow(distinct, _PIECE + ", bucket int")
    return told.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket", "salt").mapInArrow(answers, _PIECE)


def _factors(pieces: DataFrame) -> DataFrame:
    """(node, start, windows, ref_node, ref_start): the factors of all pieces, each at least one window long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["anchor", "salt"]):
            index = _Index(table, group)
            place = index.reference()
            at = np.flatnonzero((place >= 0) & ~index.foreign)
            row, node, start = index.row[at], index.node[place[at]], index.start[place[at]]
            goes_on = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & (node[1:] == node[:-1]) & (start[1:] == start[:-1] + 1)
            begins = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(at) else np.zeros(0, np.int64)
            columns = [index.node[at[begins]], index.start[at[begins]], np.diff(np.append(begins, len(at))), node[begins], start[begins]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "start", "windows", "ref_node", "ref_start"])

    everything = pieces
    if not (hot := pieces.filter("salts > 1")).isEmpty():
        everything = pieces.unionByName(_foreign(hot))
    blocks = everything.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "node", "start")
    return blocks.mapInArrow(run, "node long, start long, windows long, ref_node long, ref_start long")


def _told(docs: DataFrame, window: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The table of rows (`_signed`), and (text_key, spans, kept text, its words' SHA-256, n_removed) of texts that lose words."""
    signed = _signed(docs, window)
    texts = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("anchors").alias("anchors"))
    texts = saved(texts.filter(F.col("n") >= window).withColumn("node", F.monotonically_increasing_id()))  # fixed once it is written
    suspects = _suspects(docs, texts)
    spans = _factors(saved(_pieces(suspects, window, hot))).groupBy("node").agg(F.collect_list(F.struct("start", "windows")).alias("factors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, schema = None, pa.schema([("text_key", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string()), ("sha", pa.binary()), ("n_removed", pa.int64())])
        for batch in by_text_size(batches):
            out = []
            for key, node, text, factors in zip(*(batch.column(c).to_pylist() for c in ("text_key", "node", "text", "factors")), strict=True):
                if node == seen:
                    continue
                seen = node
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for f in factors:
                    edge[f["start"]] += 1
                    edge[f["start"] + f["windows"] + window - 1] -= 1
                covered = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                out.append((key, turns.reshape(-1, 2).tolist(), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).digest(), int(covered.sum())))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    single = texts.filter("copies = 1").select("node", "text_key")
    cut = suspects.select("node", "text").join(single.join(spans, "node"), "node")
    schema = "text_key binary, spans array<array<long>>, kept string, sha binary, n_removed long"
    cut = cut.select("text_key", "node", "text", "factors").mapInArrow(run, schema)
    whole = texts.filter("copies > 1").select("text_key", F.array(F.array(F.lit(0).cast("long"), "n")).alias("spans"), F.lit("").alias("kept"), F.lit(NOTHING).alias("sha"), F.col("n").alias("n_removed"))
    return signed, cut.unionByName(whole)


def repeated_passages(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (hexadecimal, of the kept words
    joined by a blank), spans (first word and end of each removed stretch, ascending; null if there is none).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word is removed if it lies in a window of `window` words that also starts
    at any other place, in the same document or another; all places lose it. A null text has no words. Repeated rows are
    places of their own, whatever their doc_id; a null doc_id stays null. No rows give no rows. Other columns are ignored.
    """
    signed, told = _told(docs, window, hot)
    met = signed.join(told.drop("kept"), "text_key", "left")
    digest = F.lower(F.hex(F.coalesce("sha", "whole")))
    return met.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), digest.alias("kept_sha256"), "spans")


def without_passages(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """`docs` with all its rows and columns; a text that loses words becomes its kept words joined by a blank."""
    _, told = _told(docs, window, hot)
    slim = told.select(F.struct("text_key", "kept").alias("__told"))
    met = docs.select(F.struct("*").alias("__row")).join(slim, text_key(F.col("__row.text")) == F.col("__told.text_key"), "left")
    columns = [F.coalesce("__told.kept", "__row.text").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return met.select(*columns)
