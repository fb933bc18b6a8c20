"""Benchmark decontamination by templates.

Words become typed placeholders where a question can be re-parameterised: numbers, units, names (words
with a capital initial within a sentence). Windows of consecutive template words are hashed and joined between documents and benchmark items.
Whether a capital makes a name depends on what stands before it, which a copy may change: such words of an item, a capital at
its start always, are read both ways, each reading a window of its own. Windows of placeholders for the most part say too
little; they are hashed with what stands in them (exact windows), so that they meet verbatim copies. Scripts without spaces
between words are cut into characters.
Matching windows on one diagonal (document position minus item position) are chained; a chain that covers enough of an
item is a hit if its slots are consistent: one value of the item always stands for one value of the document. Equal
slots are a verbatim copy, consistently changed ones a re-parameterised one.

Documents do not shuffle their windows: a bit table of fixed size that holds the benchmark's windows goes to the tasks,
and only windows found there (true ones and a few in ten thousand others) go on to the join, which is exact.

Every window of every item takes part, however many items share it. Documents first meet the distinct places of windows,
whatever items have them; only diagonals that cover enough words for one of these items go on to the items themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import Words, by_text_size, hash_of, mix, texts_of
from .store import saved

#: Template words of a window, words of it that are no placeholders unless it is exact, and words of the shortest item that can be found.
WINDOW, LITERAL, SHORTEST = 8, 4, 5
#: Template words that a hit covers at least, or all that the item's windows cover.
COVERED = 12
#: Items of a window that one task joins with it: a window of more items is dealt out in parts of about so many.
SHARED = 32
#: Bits of the table of windows.
BITS = 1 << 24

#: Units, in lower case.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons tonne "
    "tonnes ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit "
    "kelvin watt watts volt volts joule joules newton newtons hz khz mhz kb mb gb tb mph kmh"
).split()

#: Words that a capital does not make a name, in lower case.
PLAIN = (
    "the a in on at to of for from by with as if when while where what which who whom whose why how is are was were do does did "
    "can could should would has have had and or but not no it its this that these those there then than they we you he she i "
    "his her their our your my each every all some any both one after before because since so"
).split()

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))
_fixed: list[np.ndarray] = []

#: Characters of scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo, Chinese.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3040-\u30ff\u3100-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
#: Punctuation and spaces beyond ASCII, and those of them that end a sentence.
_MARKS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] in "PZ" and c != "\u30fb")
_ENDS = "\u2026\u3002\uff01\uff0e\uff1a\uff1b\uff1f\uff61"
_beyond = re.compile(f"([{re.escape(_MARKS)}])|([{_UNSPACED}])")


def _spaced(text: str) -> str:
    """With characters of unspaced scripts as words of their own, and punctuation beyond ASCII as a stop or space."""
    if text.isascii():
        return text
    return _beyond.sub(lambda m: f" {m[2]} " if m[2] else ". " if m[1] in _ENDS else " ", text)


class Template:
    """Template words of many texts: `word` (hash or placeholder), `slot` (whether a placeholder), `value` (hash of what
    stood there), `first` (where each text's begin, one entry more) and `unclear` (whether it has a name's capital, and what
    stands before it leaves open if it is a name)."""

    def __init__(self, texts: list[str]):
        words = Words([_spaced(t) for t in texts], fold=True)
        raw = np.frombuffer(words.raw, np.uint8)
        start, end = words.start, words.end
        digit = (raw >= 0x30) & (raw <= 0x39)
        digits = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
        number = digits[end] - digits[start] == end - start
        if not _fixed:
            _fixed.extend(np.sort(np.array([hash_of(w) for w in each], np.uint64)) for each in (UNITS, PLAIN))
        unit, plain = (f[np.minimum(np.searchsorted(f, words.hash), len(f) - 1)] == words.hash for f in _fixed)
        lead, last = raw[start], len(raw) - 1
        next_at = np.minimum(start + 1 + (lead == 0xC3), last)  # its second character

        def capital(at):
            one, two = raw[at], raw[np.minimum(at + 1, last)]
            return ((one >= 0x41) & (one <= 0x5A)) | ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E) & (two != 0x97))

        blank = (raw == 0x20) | (raw == 0x09) | (raw == 0x22) | (raw == 0x27) | (raw == 0x28)
        seen = np.maximum.accumulate(np.where(blank, 0, np.arange(len(raw), dtype=np.int32)))
        before = raw[seen[start - 1]]
        opens = np.isin(before, np.frombuffer(b".!?:;\n", np.uint8))
        # a word in capitals, or a capital before a digit, is no name but a word like any other
        shaped = capital(start) & ~capital(next_at) & ~digit[next_at] & (next_at < end) & ~number & ~plain
        name = shaped & ~opens
        running = digit | ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A) | (raw >= 0x80) | (raw == 0x2C)
        self.unclear = shaped & ~unit & ~running[seen[start - 1]]
        # a number goes on after a point or comma: 3.14 and 1,000 are one number
        joint = np.zeros(len(start), bool)
        if len(start) > 1:
            between = raw[end[:-1]]
            joint[1:] = number[1:] & number[:-1] & (start[1:] - end[:-1] == 1) & ((between == 0x2E) | (between == 0x2C))
        self.word = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words.hash)))
        self.slot, value = number | unit | name, words.hash.copy()
        if joint.any():
            group = np.cumsum(~joint) - 1
            count = int(group[-1]) + 1
            total = np.zeros(count, np.uint64)
            position = np.arange(len(group)) - np.flatnonzero(~joint)[group]
            np.add.at(total, group, mix(value + position.astype(np.uint64)))
            value = np.where(np.bincount(group, joint)[group] > 0, total[group], value)
            keep = ~joint
            kept = np.concatenate([[0], np.cumsum(keep)])
            self.first = kept[words.first]
            self.word, self.slot, self.unclear, value = self.word[keep], self.slot[keep], self.unclear[keep], value[keep]
        else:
            self.first = words.first
        self.value = value

    def windows(self, size: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, position in it, hash, whether exact, words read the other way as bits) of the windows of `size` words.

        A window with too few words that are no placeholders is exact: its hash is of the words that stand there. With
        `every`, all readings of the unclear words are told, else those as they stand and the first word as a name.
        """
        count = np.diff(self.first)
        row = np.repeat(np.arange(len(count)), count)
        n = len(self.word) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        least = min(LITERAL, size - 1)
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        exact = literal[size:] - literal[:n] < least
        code, values = np.full(n, size, np.uint64), np.full(int(exact.sum()), size + WINDOW, np.uint64)
        place = np.flatnonzero(exact)
        for k in range(size):
            _stir(code, self.word[k : k + n])
            _stir(values, self.value[place + k])
        code[exact] = values
        at = np.flatnonzero(row[:n] == row[size - 1 :])
        told = [(at, code[at], exact[at], np.zeros(len(at), np.int64))]
        if not every:
            told.append(self._read(at[self.unclear[at] & ~self.slot[at]], np.int64(1), size, least))
        elif self.unclear.any():
            bits = sum(self.unclear[at + k].astype(np.int64) << k for k in range(size))
            for flips in range(1, 1 << size):
                told.append(self._read(at[bits & flips == flips], np.int64(flips), size, least))
        at, code, exact, flips = (np.concatenate(x) for x in zip(*told, strict=True))
        if every:  # readings that are exact have one hash
            _, once = np.unique(np.stack([at.astype(np.uint64), code]), axis=1, return_index=True)
            at, code, exact, flips = at[once], code[once], exact[once], flips[once]
        return row[at], at - self.first[row[at]], mix(code), exact, flips

    def _read(self, at: np.ndarray, flips: np.int64, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(at, hash, whether exact, flips) of the windows that begin `at`, with the words at the bits `flips` read the other way."""
        code, values, literals = np.full(len(at), size, np.uint64), np.full(len(at), size + WINDOW, np.uint64), np.zeros(len(at), np.int64)
        for k in range(size):
            slot, word = self.slot[at + k], self.word[at + k]
            if flips >> k & 1:
                slot, word = ~slot, np.where(slot, self.value[at + k], _NAME)
            literals += ~slot
            _stir(code, word)
            _stir(values, self.value[at + k])
        exact = literals < least
        return at, np.where(exact, values, code), exact, np.full(len(at), flips)

    def slots(self, row: np.ndarray, position: np.ndarray, size: int, exact: np.ndarray, flips: np.ndarray) -> pa.ListArray:
        """Values of the placeholders of each of these windows, of an exact one of all words, in order."""
        begin = self.first[row] + position
        place = begin[:, None] + np.arange(size)
        is_slot = self.slot[place] ^ (flips[:, None] >> np.arange(size) & 1 == 1) | exact[:, None] if len(begin) else np.zeros((0, size), bool)
        ends = np.concatenate([[0], np.cumsum(is_slot.sum(1))])
        values = self.value[place][is_slot] if len(begin) else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _stir(code: np.ndarray, word: np.ndarray) -> None:
    code ^= word
    code *= np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)


def text_key(text: Column) -> Column:
    """Identifies a whole text; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(code, size, item_id, at, slots, exact, covers, typed) of all windows of the items, in a table.

    Items of fewer than `SHORTEST` template words have none, shorter items than a window one of their own length. Items
    with equal templates and slots are one, under the smallest id. covers: template words to be covered for a hit; typed: those to be covered by windows
    that are not exact, null without such windows. Either will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches):
            made = Template(texts_of(batch))
            count = np.diff(made.first)
            for size in range(SHORTEST, WINDOW + 1):
                row, at, code, exact, flips = made.windows(size, every=True)
                mine = count[row] == size if size < WINDOW else count[row] >= size
                row, at, code, exact, flips = row[mine], at[mine], code[mine], exact[mine], flips[mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code.view(np.int64)),
                        pa.array(np.full(len(row), size, np.int32)),
                        batch.column("item_id").take(pa.array(row)),
                        pa.array(at.astype(np.int32)),
                        made.slots(row, at, size, exact, flips),
                        pa.array(exact),
                    ],
                    ["code", "size", "item_id", "at", "slots", "exact"],
                )

    texts = benchmark.filter("item_id IS NOT NULL").groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    rows = saved(texts.select("item_id", "text").mapInArrow(run, "code long, size int, item_id long, at int, slots array<long>, exact boolean"))
    typed = covered_words(F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("at")))), F.max("size"))
    ahead = covered_words(F.sort_array(F.collect_set("at")), F.max("size"))
    covers = rows.groupBy("item_id").agg(F.least(ahead, F.lit(COVERED)).alias("covers"), F.when(typed > 0, F.least(typed, F.lit(COVERED))).alias("typed"))
    return saved(rows.join(covers, "item_id").select("code", "size", "item_id", "at", "slots", "exact", "covers", "typed"))


def covered_words(places: Column, size: Column) -> Column:
    """Words covered by windows of `size` words at ascending, distinct `places`."""
    steps = F.transform(places, lambda p, i: F.least(size, F.coalesce(F.get(places, i + 1) - p, size)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def _bit_table(codes: DataFrame) -> bytes:
    """A table of `BITS` bits, of fixed size whatever the benchmark's, with the bits of `codes` set."""
    bit = F.col("code").bitwiseAND(BITS - 1) + 1
    parts = (
        codes.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    table, size = bytearray(BITS // 8), 4096
    for r in parts:
        table[(r["part"] - 1) * size : r["part"] * size] = r["bits"]
    return bytes(table)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_key, item_id, covered, verbatim) per text and benchmark item in it."""
    windows = benchmark_windows(benchmark)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most four
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(windows))  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in by_text_size(batches):
            made = Template(texts_of(batch))
            for size in sizes:
                row, at, code, exact, flips = made.windows(size)
                place = (code & np.uint64(BITS - 1)).astype(np.int64)
                there = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                row, at, code, exact, flips = row[there], at[there], code[there], exact[there], flips[there]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("text_key").take(pa.array(row)),
                        pa.array(code.view(np.int64)),
                        pa.array(at.astype(np.int32)),
                        made.slots(row, at, size, exact, flips),
                    ],
                    ["text_key", "code", "doc_at", "doc_slots"],
                )

    texts = docs.select(text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "text_key binary, code long, doc_at int, doc_slots array<long>").dropDuplicates(["text_key", "code", "doc_at"])
    # distinct places of windows, in how many parts their items are dealt out, and the words that one of these covers at least
    parts = F.ceil(F.count("*") / SHARED).cast("int").alias("parts")
    places = saved(windows.groupBy("code", "at").agg(F.max("size").alias("size"), F.min(F.least("covers", "typed")).alias("least"), parts))
    diagonal = (F.col("doc_at") - F.col("at")).alias("diagonal")
    placed = saved(saved(found).join(places, "code").select("text_key", "code", "at", "doc_slots", diagonal, "size", "least", "parts"))
    # covers no less than any single item's windows on this diagonal do
    enough = covered_words(F.sort_array(F.collect_set("at")), F.max("size")) >= F.min("least")
    alive = placed.groupBy("text_key", "diagonal").agg(enough.alias("enough")).filter("enough").select("text_key", "diagonal")
    dealt = placed.join(alive, ["text_key", "diagonal"]).select("text_key", "diagonal", "code", "at", "doc_slots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = windows.join(places.select("code", "at", "parts"), ["code", "at"]).withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("parts")
    met = dealt.join(own, ["code", "at", "part"]).filter(F.size("slots") == F.size("doc_slots"))
    zipped, typed = F.arrays_zip(F.col("slots").alias("b"), F.col("doc_slots").alias("d")), ~F.col("exact")
    pairs_of = lambda x: F.array_distinct(F.flatten(F.collect_set(x)))
    places_of = lambda x: covered_words(F.sort_array(F.collect_set(x)), F.max("size"))
    chains = met.groupBy("text_key", "item_id", "diagonal").agg(
        places_of(F.col("at")).alias("covered"),
        places_of(F.when(typed, F.col("at"))).alias("by_typed"),
        F.max("covers").alias("covers"),
        F.max("typed").alias("typed"),
        pairs_of(zipped).alias("pairs"),
        pairs_of(F.when(typed, zipped)).alias("typed_pairs"),
    )
    consistent = lambda pairs: F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs)
    whole = (F.col("covered") >= F.col("covers")) & consistent("pairs")
    by_typed = (F.col("by_typed") >= F.col("typed")) & consistent("typed_pairs")
    return (
        chains.filter(whole | by_typed)
        .groupBy("text_key", "item_id")
        .agg(F.max("covered").alias("covered"), F.max(F.forall("pairs", lambda p: p["b"] == p["d"])).alias("verbatim"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text) that holds a benchmark item: doc_id, items (ids, ascending), covered (the
    most template words of one item), verbatim (whether any of them is copied with its slots unchanged).

    Whole texts are searched. Clean, null and empty texts give no row, nor do null, empty or very short items
    (`benchmark_windows`). Of items with one text the smallest id is told. Repeated rows give repeated rows; other
    columns are ignored.
    """
    told = hits(docs, benchmark).groupBy("text_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"), F.max("verbatim").alias("verbatim")
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    return keyed.join(saved(told), "text_key").select("doc_id", "items", "covered", "verbatim")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, unchanged, whatever the names of their columns. Null and empty
    texts stay, repeated rows share their text's fate; without items or rows nothing goes."""
    found = saved(hits(docs, benchmark).select("text_key").distinct())
    keyed = docs.select(F.struct("*").alias("__row"), text_key(F.col("text")).alias("text_key"))
    return keyed.join(found, "text_key", "left_anti").select("__row.*")
