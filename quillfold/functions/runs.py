"""Hashes of runs of tokens for whole Arrow batches: what the column functions in ``text`` say, without a string per token.

Used where an operator needs nothing but the hashes of many token windows; one array operation then does the work of
thousands of lambda calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at a time; a longer text comes alone.
SLICE = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, size: int) -> np.ndarray:
    table = np.full(size, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table, out=table)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most ``SLICE`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        load, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < batch.num_rows:
            till = max(begin + 1, int(np.searchsorted(load, load[begin] + SLICE, "right")) - 1)
            yield batch.slice(begin, till - begin)
            begin = till


def token_hashes(texts: pa.Array, inside: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, and where each text's begin (one entry more). A token is a run of the ASCII
    characters ``inside``; null reads as empty."""
    raw = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data, edge = data[edge[0] : edge[-1]], edge - edge[0]
    allowed = np.zeros(256, bool)
    allowed[list(inside.encode())] = True
    solid = np.concatenate([[False], allowed[data], [False]])
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = turns[0::2], turns[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    value = (total[end] - total[start]) * _powers(pow(_BASE, -1, 2**64), len(data) + 1)[start]
    return _mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48))), np.searchsorted(start, edge)


def window_hashes(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of ``n`` tokens within a text, in order, and where each text's begin."""
    number = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], number)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _ODD + _mix(tokens[at + k] + np.uint64(k + 1))
    return _mix(out), begin


#: The letters beyond ASCII whose lower case has one within, in UTF-8.
_OUTER = {"\u212a".encode(): b"k", "\u0130".encode(): "i\u0307".encode()}
_CASED = np.array([chr(b).isalpha() or b == 39 for b in range(128)] + [False] * 128)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def lower_letters(text: bytes) -> bytes:
    """A text in UTF-8 with the ASCII letters that its lower-cased form has; letters beyond ASCII keep their case."""
    for outer, inner in _OUTER.items():
        text = text.replace(outer, inner)
    return text.lower()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line break after each, and where each text begins (one entry more)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.cumsum([0, *(len(t) + 1 for t in texts)])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    solid = np.concatenate([[False], inside, [False]])
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    return turns[0::2], turns[1::2]


def space_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of bytes that are no white space."""
    return spans(~_SPACE[data])


def _text_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Words:
    """The style tokens of some texts in UTF-8, the runs of ``[a-z']`` that ``text.tok_alpha`` finds, as numbers:
    token ``i`` is ``words[ids[i]]``, and text ``t`` has the tokens ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, texts: list[bytes]):
        cased, at = joined(texts)
        begin, end = spans(_CASED[cased])
        form = np.searchsorted(begin, at)
        letters = cased
        if any(outer in t for t in texts for outer in _OUTER):
            letters, at = joined([lower_letters(t) for t in texts])
            start, stop = spans(_CASED[letters])
            self.first = np.searchsorted(start, at)
            also = np.ones(len(begin), bool)
        else:
            start, stop, self.first, also = begin, end, form, cased[begin] == 39
        # a cased word begins with a letter: where it is no token, it is numbered after them
        more, till, text = begin[also], end[also], _text_of(form)[also]
        while len(led := np.flatnonzero((more < till) & (cased[np.minimum(more, len(cased) - 1)] == 39))):
            more[led] += 1
        kept = more < till
        more, till, text = more[kept], till[kept], text[kept]
        self.words, numbers = self._numbered(np.concatenate([letters, cased]), np.append(start, more + len(letters)), np.append(stop, till + len(letters)))
        self.ids, self.texts = numbers[: len(start)], _text_of(self.first)
        same = np.zeros(0, np.int64) if letters is not cased else np.flatnonzero(~also)
        self._form_text = np.append(self.texts[same], text)
        self._form_id = np.append(self.ids[same], numbers[len(start) :])
        self._capital = cased[np.append(begin[~also] if letters is cased else [], more).astype(np.int64)] < 97

    @staticmethod
    def _numbered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        ends = np.cumsum(np.append(0, stop - start))
        at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], stop - start)
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_LOWER[data[at]])]
        coded = pa.Array.from_buffers(pa.binary(), len(start), buffers).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def counted(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text and word number that is ``wanted``: text, number, how often it comes, and whether it is always
        capitalised there; by text, then number."""
        size = max(len(self.words), 1)
        of = lambda text, number, rows: (text * size + number)[rows]
        pairs, n = np.unique(of(self.texts, self.ids, wanted[self.ids]), return_counts=True)
        forms = wanted[self._form_id]
        plain = np.unique(of(self._form_text, self._form_id, forms & ~self._capital))
        capital = np.unique(of(self._form_text, self._form_id, forms & self._capital))
        proper = np.isin(pairs, capital, assume_unique=True) & ~np.isin(pairs, plain, assume_unique=True)
        return pairs // size, pairs % size, n, proper


ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789'"


def shingle_hashes(df: DataFrame, text: Column, n: int, distinct: bool = True, name: str = "h") -> DataFrame:
    """``df`` with the hashes of all runs of ``n`` tokens ``[a-z0-9']+`` of the lower-cased text: sorted and distinct, or all
    in order. The columns of ``df`` are carried through Arrow, so pass few."""
    rows, names = df.withColumn("_low", F.lower(text)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_low"):
            every, first = window_hashes(*token_hashes(batch.column("_low"), ALNUM), n)
            values = every.view(np.int64)
            if distinct:
                sets = [np.unique(values[a:b]) for a, b in zip(first, first[1:], strict=False)]
                values = np.concatenate([np.zeros(0, np.int64), *sets])
                first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(run, f"{fields}, {name} array<long>")
