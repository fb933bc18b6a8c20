"""Hashed terms of texts, bounded labelled samples, and the small models that are fitted on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import Words, by_text_size, mix, texts_of
from .store import saved

#: Number of hashed terms. A term is a word, or the first 4 to 7 bytes of a longer word.
TERMS = 1 << 18
PREFIXES = (4, 5, 6, 7)
#: Chi-square from which on a term is taken to tell something: one in a thousand terms without meaning reaches it.
ABOVE_CHANCE = 10.83


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_numbers(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hashed term) for all words, then for each kind of prefix."""
    mask, row = np.uint64(TERMS - 1), words.text_of_word()
    yield row, (words.hash & mask).astype(np.int64)
    for size in PREFIXES:
        longer = words.end - words.start > size
        yield row[longer], (mix(words.prefix_hash(size)[longer] + np.uint64(size)) & mask).astype(np.int64)


def chosen_terms(words: Words, place: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of the distinct chosen terms of each text, in order; `place` gives a term's position or -1."""
    pairs = []
    for row, term in term_numbers(words):
        at = place[term]
        pairs.append((row * number + at)[at >= 0])
    both = np.unique(np.concatenate(pairs))
    return both // number, both % number


def places(terms: list[int]) -> np.ndarray:
    place = np.full(TERMS, -1, np.int32)
    place[np.array(terms, np.int64)] = np.arange(len(terms))
    return place


def labelled_sample(labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, y, weight): about `size` labelled rows outside the held-out third, half of each class where possible.

    Rows are drawn by a hash of their id, so the draw is the same on every run; the share that is drawn follows from the
    counts of all labels. weight is the inverse of a class's share. Of several labels of one id the largest counts;
    null ids and labels take no part.
    """
    clean = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    share = {y: min(1.0, size / 2 / n) for y, n in counts.items()}
    part = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    return clean.filter(draw < part).withColumn("weight", 1.0 / part)


def with_terms(docs: DataFrame, extra: str = "") -> DataFrame:
    """docs (doc_id, text and the `extra` columns, as a schema string) with their distinct hashed terms instead of text."""
    names = [x.split()[0] for x in extra.split(", ") if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches):
            words = Words(texts_of(batch), fold=True)
            both = np.unique(np.concatenate([row * TERMS + term for row, term in term_numbers(words)]))
            ends = np.searchsorted(both, np.arange(batch.num_rows + 1) * TERMS)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((both % TERMS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in names], lists], ["doc_id", *names, "terms"])

    schema = ", ".join(["doc_id long", *([extra] if extra else []), "terms array<int>"])
    return docs.select("doc_id", "text", *names).mapInArrow(run, schema)


def telling_terms(sample: DataFrame, number: int) -> list[int]:
    """The terms with the largest chi-square statistic against y among `sample` (y, terms), if it is above chance."""
    seen = {r["y"]: float(r["count"]) for r in sample.groupBy("y").count().collect()}
    pos, neg = seen.get(1, 0.0), seen.get(0, 0.0)
    if not pos or not neg:
        return []
    a, b = F.col("a"), F.col("n") - F.col("a")
    chi = (pos + neg) * (a * (neg - b) - b * (pos - a)) ** 2 / (F.col("n") * (pos + neg - F.col("n") + 1.0) * pos * neg)
    counted = (
        sample.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
        .withColumn("chi", chi)
        .filter((F.col("n") >= 3) & (F.col("chi") >= ABOVE_CHANCE))
    )
    return [r["term"] for r in counted.orderBy(F.desc("chi"), "term").limit(number).select("term").collect()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.kept = rate, 0, {}

    def update(self, values: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, slope in slopes.items():
            m, v = self.kept.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            self.kept[name] = m, v
            values[name] = values[name] - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the last is the constant) of weighted ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ beta)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - keep * beta)
        beta = beta + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sample_texts(docs: DataFrame, sample: DataFrame, columns: str = "y int, weight double") -> DataFrame:
    """The sample with the hashed terms of its documents, in a table. The sample is bounded by its parameter, so it is
    sent to the tasks that read the documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(with_terms(texts.join(F.broadcast(sample), "doc_id"), columns))
