"""Alignment of two tokenizers' tokens over the same text, by divide and conquer at shared cuts.

A is a byte-level vocabulary of the `tokenizers` library, B a `sentencepiece` model; both are read as bytes of blank + text.
Where a token of A and one of B end at the same byte is a shared cut. First, both cut a text before a single blank or line
break between two characters that are not white space, whatever stands further away; the chunks between are met again and
again, so each distinct one is encoded and aligned once per worker. Within a chunk a common end is looked for from the
middle of A's ends outwards, by bisection among B's, and both halves are treated alike; what has no cut is a group.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_text_size, texts_of
from .store import saved
from .tokens import CUT, RARE, encoder

#: Chunks that a worker remembers, and the longest remembered.
CHUNKS, CHUNK_CHARS = 400_000, 48
#: Id pairs whose counts every task holds, 16 bytes each: the most frequent ones. The others are joined.
FREQUENT = 1 << 20
_BLANK = "▁"


def shared_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Numbers of tokens of A and B before each byte where both have an end, ascending. a, b: ends of the tokens in bytes.

    Every end of A is looked up once at most: the ends between the middle and the cut found are known to be no cuts.
    """
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        low, high, first, last = work.pop()
        if low >= high or first >= last:
            continue
        left = right = (low + high) // 2  # ends in [left, right) are no cuts
        while left > low or right < high:
            if right < high:
                j = bisect_left(b, a[right], first, last)
                if j < last and b[j] == a[right]:
                    found.append((right + 1, j + 1))
                    work += [(low, left, first, j), (right + 1, high, j + 1, last)]
                    break
                right += 1
            if left > low:
                left -= 1
                j = bisect_left(b, a[left], first, last)
                if j < last and b[j] == a[left]:
                    found.append((left + 1, j + 1))
                    work += [(low, left, first, j), (right, high, j + 1, last)]
                    break
    return sorted(found)


def overlaps(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of tokens of one group whose bytes overlap. a, b: ends of its tokens, the last ones equal."""
    i = j = 0
    while i < len(a) and j < len(b):
        yield i, j
        if a[i] <= b[j]:
            i += 1
        else:
            j += 1


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One per worker and pair of vocabulary files."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


def _byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = encoder(a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        known = _byte_characters()
        entries = self.a.tokenizer.get_vocab()
        self.a_size, self.b_size = max(entries.values()) + 1, self.b.get_piece_size()
        self.a_length = np.zeros(self.a_size, np.int64)
        for entry, k in entries.items():
            self.a_length[k] = len(entry) if all(c in known for c in entry) else len(entry.encode())
        self.b_bytes = [self._piece(k) for k in range(self.b_size)]
        self.lone = self.b.piece_to_id(_BLANK)
        pieces = [self.b.id_to_piece(k) for k in range(self.b_size)]
        #: A blank or line break inside a piece would join what stands on both sides of a cut.
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) or "\n" in p for p in pieces)
        self._forget()

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(_BLANK, " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.count = 0
        self.strings: list[str | None] = []
        self.n = np.zeros((3, 1024), np.int64)  # tokens of A, of B, groups
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int64), 0

    def _chunks(self, text: str) -> list[str]:
        """Of blank + text, joined they are it."""
        text = " " + text
        if not self.cuts:
            return [text]
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or text[-1] in " \n" or RARE.search(text):
            return CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def _pieces(self, chunks: list[str]) -> list[list[int]]:
        """Ids of B. It puts a blank before what it is given."""
        told = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids if c[0] == " " else ids[1:] if ids[:1] == [self.lone] else [] for c, ids in zip(chunks, told, strict=True)]

    def _learn(self, chunks: list[str]) -> None:
        flat, sizes = self.a.encoded(chunks)
        ends = np.cumsum(self.a_length[flat]).tolist()
        ids, codes, rows, at, before = flat.tolist(), [], [], 0, 0
        for chunk, size, theirs in zip(chunks, sizes.tolist(), self._pieces(chunks), strict=True):
            mine, a_ends = ids[at : at + size], [e - before for e in ends[at : at + size]]
            at, before = at + size, ends[at + size - 1]
            if b"".join([self.b_bytes[k] for k in theirs]) != chunk.encode():
                rows.append((0, 0, 0, 0))
                self.strings.append(None)
                continue
            b_ends, till = [], 0
            for k in theirs:
                till += len(self.b_bytes[k])
                b_ends.append(till)
            i = j = links = 0
            groups = []
            for x, y in shared_cuts(a_ends, b_ends):
                groups.append(",".join(map(str, mine[i:x])) + "|" + ",".join(map(str, theirs[j:y])))
                for p, q in overlaps(a_ends[i:x], b_ends[j:y]):
                    codes.append(mine[i + p] * self.b_size + theirs[j + q])
                    links += 1
                i, j = x, y
            rows.append((size, len(theirs), len(groups), links))
            self.strings.append(";".join(groups))
        old, new, used = self.count, self.count + len(chunks), self.used + len(codes)
        if new > self.n.shape[1]:
            self.n = np.concatenate([self.n, np.zeros((3, 2 * new), np.int64)], 1)
            self.begin, self.size = np.resize(self.begin, self.n.shape[1]), np.resize(self.size, self.n.shape[1])
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.n[:, old:new], self.size[old:new] = np.array(rows, np.int64).T[:3], [r[3] for r in rows]
        self.begin[old:new] = self.used + np.cumsum(self.size[old:new]) - self.size[old:new]
        self.flat[self.used : used] = codes
        self.used, self.count = used, new
        self.known.update(zip(chunks, range(old, new), strict=True))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Tokens of A, of B and groups of each text (3 x texts), its groups written out, the codes of all links
        (A's id x B's vocabulary + B's id) and the number of links of each text. A text that B does not give back has none."""
        if self.count > CHUNKS or self.used > 16 * CHUNKS:
            self._forget()
        chunks: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                chunks += self._chunks(text)
            ends.append(len(chunks))
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        fresh = list(dict.fromkeys(chunks[k] for k in missing))
        if fresh:
            self._learn(fresh)
            at[missing] = [self.known[chunks[k]] for k in missing]
        counts = np.zeros((3, len(texts)), np.int64)
        written, spoilt = [], np.zeros(len(texts), bool)
        place = at.tolist()
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            told = [self.strings[x] for x in place[a:b]]
            spoilt[k] = None in told
            written.append("" if spoilt[k] else ";".join(told))
        bounds = np.array(ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        good = ~spoilt[owner]
        at, owner = at[good], owner[good]
        for k in range(3):
            counts[k] = np.bincount(owner, self.n[k][at], len(texts)).astype(np.int64)
        sizes = self.size[at]
        total = np.cumsum(sizes)
        shift = np.repeat(self.begin[at] - total + sizes, sizes) + np.arange(int(sizes.sum()))
        links = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        codes = self.flat[shift]
        for k in fresh:
            if len(k) > CHUNK_CHARS:
                self.strings[self.known.pop(k)] = None
        return counts, written, codes, links


def _aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times) per row, in a table; codes: its distinct linked
    pairs, ascending, and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = aligner(a, b), TaskContext.get().partitionId() << 33
        for batch in by_text_size(batches):
            counts, written, codes, links = code.align(texts_of(batch))
            texts = len(written)
            spread = np.int64(code.a_size * code.b_size)
            pairs, times = np.unique(np.repeat(np.arange(texts), links) * spread + codes, return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(texts + 1) * spread), pa.int32())
            told = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written]
            columns = [
                pa.array(np.arange(row, row + texts)), batch.column("doc_id"), *map(pa.array, counts), pa.array(links), pa.array(told, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(pairs % spread)), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
            ]
            row += texts
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema))


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, code = np.unique(codes, return_inverse=True)
    return names, np.bincount(code, times, len(names)).astype(np.int64)


def pair_counts(aligned: DataFrame, b_size: int, hold: int = 2_000_000) -> DataFrame:
    """(code, count, best: no other pair of its B id has a higher one) of all linked pairs, in a table. Each task sums what it
    has read, `hold` pairs at a time, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        told = lambda: pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], ["code", "count"])
        for batch in batches:
            held.append([batch.column(c).flatten().to_numpy() for c in ("codes", "times")])
            size += len(held[-1][0])
            if size > hold:
                codes, times = (np.concatenate(x) for x in zip((names, sums), *held, strict=True))
                names, sums = _summed(codes, times)
                held, size = [], 0
                if len(names) > hold:
                    yield told()
                    names, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, times = (np.concatenate(x) for x in zip((names, sums), *held, strict=True))
        names, sums = _summed(codes, times)
        yield told()

    parts = aligned.select("codes", "times").mapInArrow(run, "code long, count long")
    counts = saved(parts.groupBy("code").agg(F.sum("count").alias("count"))).withColumn("b", F.col("code") % b_size)
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    return saved(counts.join(best, "b").select("code", "count", (F.col("count") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The least power of two such that at most `most` pairs have that count or more, and those pairs by code."""
    sizes = counts.groupBy(F.floor(F.log2("count")).alias("k")).count().collect()  # 64 rows at most
    floor, total = 64, 0
    for k, number in sorted(sizes, reverse=True):
        total += number
        if total > most:
            break
        floor = k
    floor = 0 if total <= most else floor
    return floor, counts.filter(F.col("count") >= 2**floor if floor < 63 else F.lit(False)).toArrow().sort_by("code")


def _sums(aligned: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(row, n_best, count_sum) of all rows: frequent pairs from an array in every task, the others by a join."""
    floor, table = _frequent(counts, most)
    arrays = [table.column(c).to_numpy() for c in ("code", "count", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, best = shared.value
        for batch in batches:
            lists = batch.column("codes")
            code, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(names, code), max(len(names) - 1, 0))
            known = names[at] == code if len(names) else np.zeros(len(code), bool)
            at, rare = at[known], ~known
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner[known], times[known] * best[at])
            np.add.at(sums[1], owner[known], times[known] * number[at])
            ends = pa.array(np.searchsorted(owner[rare], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[rare])) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), *lists], ["row", "n_best", "count_sum", "codes", "times"])

    schema = "row long, n_best long, count_sum long, codes array<long>, times array<long>"
    sums = aligned.select("row", "codes", "times").mapInArrow(run, schema)
    if not floor:  # no pair is left
        return sums.select("row", "n_best", "count_sum")
    sums = saved(sums)
    left = sums.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    met = left.join(counts, "code").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    return sums.select("row", "n_best", "count_sum").unionByName(met).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a: str, b: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a byte-level file of the tokenizers library, read over blank + text; b: a sentencepiece model, which puts the blank
    itself. Strings of special tokens are plain text. Links are the pairs of tokens whose bytes overlap; a pair of ids
    counts as often as it is linked in all of `docs`. n_best: links whose count is the highest of their B id. The hash is of
    `a1,a2|b1;a3|b2,b3`, the ids of each group. Null and empty texts, and texts that either vocabulary does not give back byte
    by byte, have no tokens: zeros and ''. Repeated rows count each; a null doc_id stays. Other columns are ignored.
    """
    aligned = _aligned(docs, a, b)
    counts = pair_counts(aligned, aligner(a, b).b_size)
    told = aligned.drop("codes", "times").join(_sums(aligned, counts, frequent), "row")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, groups) per row of `docs`, where groups is an array of (a: ids of A, b: ids of B) in the order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(a, b)
        ids = lambda x: [int(k) for k in x.split(",")]
        kind = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
        for batch in by_text_size(batches):
            written = code.align(texts_of(batch))[1]
            rows = [[dict(zip("ab", map(ids, g.split("|")), strict=True)) for g in x.split(";")] if x else [] for x in written]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
