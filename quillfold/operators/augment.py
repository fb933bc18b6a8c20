"""Seeded orthographic noise from a mined error table."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import draw
from ..session import beside, cut_lineage

ATTEMPTS_PER_ERROR = 12
_WORD = re.compile(r"[A-Za-z0-9_]+")


def cumulative_weights(errors: DataFrame) -> DataFrame:
    """``correct, variant, low, high, total``: each row's stretch of the running weight, by count, then alphabet.

    A running sum over a table of any size: parts of the order add up on their own, and only the sums of the parts, a row
    each, are run through one window.
    """
    order = [F.desc("n"), F.col("correct"), F.col("variant")]
    rows = errors.select("correct", "variant", F.greatest(F.lit(1), F.coalesce("n", F.lit(1))).cast("long").alias("n"))
    parts = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("n").alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    high = F.col("_base") + F.sum("n").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = parts.join(base.select("_part", "_base"), "_part").withColumn("high", high).select("correct", "variant", (F.col("high") - F.col("n")).alias("low"), "high")
    return beside(placed, parts.agg(F.sum("n").alias("total"), F.count("*").alias("rows")))


def weighted_draws(wanted: DataFrame, errors: DataFrame) -> DataFrame:
    """``wanted`` (with ``roll`` in [0, 1)) and the ``correct, variant`` whose stretch of the running weight it falls in.

    A range join as an equi-join: the running weight is cut in as many strips as the table has rows, each row stands in the
    strips that it touches (two per row on average), and a draw meets the rows of its own strip.
    """
    table = cut_lineage(cumulative_weights(errors))
    width = F.greatest(F.lit(1), F.floor(F.col("total") / F.col("rows")))
    strips = table.select("correct", "variant", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("strip"))
    sized = beside(wanted, table.select("total", width.alias("width")).limit(1))
    placed = sized.withColumn("_at", F.floor(F.col("roll") * F.col("total"))).withColumn("strip", F.floor(F.col("_at") / F.col("width")))
    met = placed.join(strips, "strip").filter((F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high")))
    return met.select(*wanted.columns, "correct", "variant")


class _Words:
    """A text as its words and what stands between them, with the places of each word in order."""

    def __init__(self, text: str):
        self.parts, last = [], 0  # separator, word, separator, word, ..., separator
        for m in _WORD.finditer(text):
            self.parts += [text[last : m.start()], m.group()]
            last = m.end()
        self.parts.append(text[last:])
        self.places: dict[str, list[int]] = {}
        for k in range(1, len(self.parts), 2):
            self.places.setdefault(self.parts[k].lower(), []).append(k)

    def swap(self, correct: str, variant: str) -> bool:
        """The first place of ``correct`` becomes ``variant``, with the capital that stood there."""
        if _WORD.fullmatch(correct) and _WORD.fullmatch(variant):
            places = self.places.get(correct.lower())
            if not places:
                return False
            at = places.pop(0)
            new = _capital(self.parts[at], variant)
            self.parts[at] = new
            bisect.insort(self.places.setdefault(new.lower(), []), at)
            return True
        text = self.text()  # words with other characters in them are rare
        hit = re.search(rf"(?<![A-Za-z0-9_]){re.escape(correct)}(?![A-Za-z0-9_])", text, re.IGNORECASE | re.ASCII)
        if hit is None:
            return False
        self.__init__(text[: hit.start()] + _capital(hit.group(), variant) + text[hit.end() :])
        return True

    def text(self) -> str:
        return "".join(self.parts)


def _capital(found: str, variant: str) -> str:
    return variant[:1].upper() + variant[1:] if found[:1] == found[:1].upper() else variant


def _noisy(text: str, budget: int, picks: list[tuple[str, str]]) -> str:
    words, used = _Words(text), set()
    for correct, variant in picks:
        if len(used) >= budget:
            break
        if correct not in used and words.swap(correct, variant):
            used.add(correct)
    return words.text()


def inject_errors(df: DataFrame, errors: DataFrame, key: str, rate: float | None, seed: int = 13, text: str = "text") -> DataFrame:
    """Add ``noisy``: up to ``rate`` per thousand words become their usual misspelling, each correct word once, at its first
    place. Unchanged without a table, a rate, or a budget of at least one error.

    ``errors``: correct, variant, n. A document draws up to ``ATTEMPTS_PER_ERROR`` rows per error from the table, by weight,
    in a join; the table is neither collected nor sent to every task. ``key`` is unique.
    """
    if rate is None or rate <= 0:
        return df.withColumn("noisy", F.col(text))
    errors = errors.filter(F.col("correct").isNotNull() & F.col("variant").isNotNull() & (F.col("correct") != ""))
    budget = F.floor(F.lit(rate) / 1000 * F.regexp_count(text, F.lit(r"\S+")) + 0.5).cast("int")
    docs = df.select(key, budget.alias("_budget")).filter("_budget > 0")
    tries = docs.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.col("_budget") * ATTEMPTS_PER_ERROR - 1)).alias("_try"))
    drawn = weighted_draws(tries.withColumn("roll", draw(seed, F.col("_key"), F.col("_try"))), errors)
    picks = drawn.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_try", "correct", "variant"))).alias("_picks"))
    picks = picks.select("_key", F.col("_picks.correct").alias("_correct"), F.col("_picks.variant").alias("_variant"))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), budget.alias("_budget")).join(picks, "_key")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                _noisy(t, n, list(zip(c, v, strict=True)))
                for t, n, c, v in zip(*(batch.column(x).to_pylist() for x in ("_text", "_budget", "_correct", "_variant")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, pa.string())], ["_key", "_noisy"])

    changed = rows.mapInArrow(run, f"_key {kind}, _noisy string")
    met = df.join(changed.withColumnRenamed("_key", key), key, "left")
    return met.withColumn("noisy", F.coalesce("_noisy", F.col(text))).select(*df.columns, "noisy")
