"""Packing of documents into sequences by order-preserving dynamic programming.

The documents of a partition, each with its end token, follow one another as one stream of tokens. Windows of at most
`capacity` tokens cover it without gap or overlap. Where a window may end: after a document (no penalty), after a
sentence (`SENTENCE`), and in long stretches without either every few tokens (`HARD`). With F(p) the least cost of the
stream up to p,

    F(p) = cut(p) + min over p - capacity <= q < p of F(q) + WINDOW + padding(p - q).

Padding is `capacity` - length, and none where the length is a power of two. The first makes the minimum one over
F(q) + q in a sliding window, which a monotone queue gives in constant time on average; the powers of two are a few
further transitions. So the work is linear in the tokens.

The stream is cut in blocks of bounded size: the best window end in the last `capacity` tokens of a block closes it and
the tokens after that open the next, so there is one short window per partition, not per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_text_size, texts_of
from .tokens import encoder

CAPACITY = 2048
#: Costs in tokens of padding: one more window, a cut after a sentence, a cut within one.
WINDOW, SENTENCE, HARD = 4, 2, 16
#: Stretches longer than GAP without a sentence's or document's end may be cut every STEP tokens.
GAP, STEP = 48, 16
#: Tokens that the plan is made for at a time.
BLOCK = 1 << 20
#: Tokens that end a sentence.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "...</w>", ".", "!", "?")

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


def cut_positions(size: int, soft: np.ndarray, ends: np.ndarray, final: bool, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a block of `size` tokens, ascending from 0, and the penalty of each.

    soft, ends: positions after a sentence, and after a document. The last tokens of the stream may be cut anywhere, so
    that they fall into powers of two.
    """
    cost = np.full(size + 1, -1, np.int32)
    known = np.unique(np.concatenate([[0], soft, ends, [size]]))
    gap = min(GAP, capacity // 2)
    step = min(STEP, gap)
    wide = np.flatnonzero(np.diff(known) > gap)
    if len(wide):
        number = (known[wide + 1] - known[wide] - 1) // step
        nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + 1
        cost[np.repeat(known[wide], number) + nth * step] = HARD
    if final:
        cost[max(0, size - capacity) :] = HARD
    cost[soft] = SENTENCE
    cost[ends] = 0
    cost[0] = 0
    if final:
        cost[size] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(at: np.ndarray, cut: np.ndarray, capacity: int, final: bool) -> list[int]:
    """Ends of the windows of least total cost, chosen from `at` (ascending, from 0; no gap above `capacity`).

    final: the last window ends at the last position; else at the cheapest in the last `capacity` tokens.
    """
    place, size = at.tolist(), len(at)
    if size < 2:
        return []
    index = np.full(place[-1] + 1, -1, np.int32)
    index[at] = np.arange(size)
    froms, tos = [], []
    power = 1
    while power <= capacity:
        back = at - power
        found = np.where(back >= 0, index[np.maximum(back, 0)], -1)
        hit = np.flatnonzero(found >= 0)
        tos.append(hit)
        froms.append(found[hit])
        power *= 2
    to, fro = np.concatenate(tos), np.concatenate(froms)
    order = np.argsort(to, kind="stable")
    fro = fro[order].tolist()
    till = np.searchsorted(to[order], np.arange(size), "right").tolist()

    cuts = cut.tolist()
    best, came, line = [0] * size, [0] * size, [0] * size
    queue = [0] * size
    head = tail = 0  # queue[head:tail]: candidates in ascending order of place and of best + place
    hit = till[0]
    pad = capacity + WINDOW
    for k in range(1, size):
        p, value = place[k], line[k - 1]
        while tail > head and line[queue[tail - 1]] > value:
            tail -= 1
        queue[tail] = k - 1
        tail += 1
        least = p - capacity
        while place[queue[head]] < least:
            head += 1
        source = queue[head]
        cost = line[source] + pad - p
        stop = till[k]
        while hit < stop:
            other = best[fro[hit]] + WINDOW
            if other < cost:
                cost, source = other, fro[hit]
            hit += 1
        best[k], came[k] = (cost := cost + cuts[k]), source
        line[k] = cost + p
    last = size - 1
    if not final:
        k = low = last
        while k > 0 and place[k] > place[-1] - capacity:
            if best[k] < best[low]:
                low = k
            k -= 1
        last = low
    ends = []
    while last > 0:
        ends.append(place[last])
        last = came[last]
    return ends[::-1]


class Packer:
    """Takes the documents of one partition in order, gives its pieces as record batches."""

    def __init__(self, task: int, capacity: int, sentence_ids: np.ndarray):
        self.task, self.capacity, self.sentence_ids = task, capacity, sentence_ids
        self.ids = np.zeros(0, np.uint32)
        # of the documents in `ids`: id, tokens in all, tokens before `ids`, end in `ids`
        self.name: list = []
        self.total = self.before = self.end = np.zeros(0, np.int64)
        self.sequences = 0

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.end = np.concatenate([self.end, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.total = np.concatenate([self.total, sizes])
        self.before = np.concatenate([self.before, np.zeros(len(sizes), np.int64)])
        self.name += names

    def pack(self, final: bool) -> Iterator[pa.RecordBatch]:
        size = len(self.ids)
        if not size:
            return
        soft = np.flatnonzero(np.isin(self.ids, self.sentence_ids)) + 1
        at, cost = cut_positions(size, soft, self.end, final, self.capacity)
        ends = np.array(plan(at, cost, self.capacity, final), np.int64)
        if not len(ends):
            return
        stop = int(ends[-1])
        whole = int(np.searchsorted(self.end, stop, "right"))
        cuts = np.unique(np.concatenate([ends, self.end[:whole]]))
        begins = np.concatenate([[0], cuts[:-1]])
        doc = np.searchsorted(self.end, begins, "right")
        window = np.searchsorted(ends, begins, "right")
        opened = np.concatenate([[0], ends[:-1]])
        doc_begin = np.concatenate([[0], self.end[:-1]])
        view = memoryview(self.ids[:stop].astype("<u4").tobytes())
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self.name[k] for k in doc.tolist()], pa.int64()),
                pa.array(begins - doc_begin[doc] + self.before[doc]),
                pa.array(cuts - begins),
                pa.array(sums, pa.int64()),
                pa.array(self.total[doc]),
                pa.array(window + self.sequences + (self.task << 33)),
                pa.array(begins - opened[window]),
                pa.array((ends - opened)[window]),
            ],
            [x.split()[0] for x in PIECES.split(", ")],
        )
        self.sequences += len(ends)
        self.ids = self.ids[stop:].copy()
        left = doc_begin[whole:]
        self.before = self.before[whole:] + np.maximum(stop - left, 0)
        self.name, self.total, self.end = self.name[whole:], self.total[whole:], self.end[whole:] - stop


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Packs every whole document of `docs` (doc_id, text) and returns its pieces (`PIECES`).

    The ids of a document are those of its text without special tokens, then `end_id`; each lies in exactly one piece.
    A piece gives its document, the document's ids before it, its length, the unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers, the document's number of ids, its sequence, its offset there, and the
    sequence's length before padding. A null or empty text is `end_id` alone. Repeated rows are packed as often as they
    come. Other columns are ignored, no rows give no piece. Documents keep their order in the input's partitions;
    nothing is shuffled, and a task that runs again gives the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        ends = [code.tokenizer.token_to_id(x) for x in SENTENCE_ENDS]
        packer = Packer(TaskContext.get().partitionId(), capacity, np.array([x for x in ends if x is not None], np.uint32))
        for batch in by_text_size(batches):
            ids, sizes = code.encode(texts_of(batch))
            packer.add(batch.column("doc_id").to_pylist(), np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1)
            if len(packer.ids) >= BLOCK:
                yield from packer.pack(False)
        yield from packer.pack(True)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES)
