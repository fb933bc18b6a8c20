"""Arrow batches cut by the size of their texts, and the words of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task holds as arrays at a time; a longer text comes alone.
TEXT_BYTES = 400_000


def by_text_size(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text, or one row. Nothing is dropped or reordered. Memory that a batch leaves free
    goes back to the system, since a worker lives on beside the JVM for later stages."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > begin and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _malloc_trim():
    """glibc keeps freed memory; other C libraries have no such call."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _malloc_trim()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null reads as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


#: Word characters are 0-9, a-z (A-Z are lower-cased first) and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
#: All but blank, tab, line breaks and the like.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, size: int) -> np.ndarray:
    """Powers of the base or of its inverse. Only a table for ordinary slices is kept."""
    if len(_powers[which]) < size:
        base = int(_BASE) if which == "up" else pow(int(_BASE), -1, 2**64)
        table = np.full(max(size, TEXT_BYTES + 4096), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table, out=table)
        if size > TEXT_BYTES + 4096:
            return table
        _powers[which] = table
    return _powers[which][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a list of texts: lower-cased runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.

    With `fold`, letters beyond ASCII are lower-cased too (but for texts where that would move later bytes). `inside` tells
    other word bytes (a line break is none); without `lower`, texts stay as they are.

    Per word: 64-bit hash, start and end byte in `raw` (the texts as given, joined). Per text: range of its words in
    `first` (one entry more than texts).
    """

    def __init__(self, texts: list[str], fold: bool = False, inside: np.ndarray = _WORD, lower: bool = True):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n" + b"\n".join(encoded) + b"\n"
        low = self.raw.lower() if lower else self.raw
        if fold and len(low) > sum(map(len, texts)) + len(texts) + 1:  # not ASCII alone
            folded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
            low = b"\n".join([b"", *(b if len(b) == len(a) else a.lower() for a, b in zip(encoded, folded, strict=True)), b""])
        lowered = np.frombuffer(low, np.uint8)
        solid = inside[lowered]
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        values = lowered.astype(np.uint64) + np.uint64(1)
        values *= _power("up", len(values))
        totals = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=totals[1:])
        self._totals = totals
        self.hash = self.prefix_hash()
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.offset = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, self.offset)

    def prefix_hash(self, size: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first `size` bytes."""
        end = self.end if size is None else np.minimum(self.end, self.start + size)
        value = (self._totals[end] - self._totals[self.start]) * _power("down", len(self._totals))[self.start]
        return mix(value ^ ((end - self.start).astype(np.uint64) << np.uint64(56)))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_of(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words([word]).hash[0])


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of `size` consecutive hashes, from each place that has so many."""
    number = max(len(hashes) - size + 1, 0)
    totals = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(size)) * _power("up", len(hashes)), out=totals[1:])
    return mix((totals[size : size + number] - totals[:number]) * _power("down", number))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of `size` consecutive words of a text, and the first shingle of each text (one entry more).

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(words.first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], number)
    last = np.repeat(words.first[1:], number)
    out = np.zeros(first[-1], np.uint64)
    for k in range(size):
        there = at + k < last
        part = mix(words.hash[np.where(there, at + k, 0)] + np.uint64(k + 1)) if len(words.hash) else out
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(there, part, np.uint64(0))
    return mix(out), first
