"""Toxicity of texts: a factorization machine over hashed terms.

score = sigmoid(c + sum of w_i + sum over pairs i < j of <v_i, v_j>) over the distinct chosen terms of a text. The pair
terms learn that two words together mean something that neither means alone, such as an insult and the name of a group,
and that an insult in a quoting context means less; additive weights can't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, by_text_size, texts_of
from .learn import Adam, chosen_terms, held_out, labelled_sample, places, sample_texts, sigmoid, telling_terms

#: Labelled rows that the model is fitted on, at most about; terms it uses; numbers per term for pairs.
SAMPLE, CHOSEN, FACTORS = 12_000, 2_048, 6
ROUNDS, RATE, RIDGE = 200, 0.05, 2e-4
THRESHOLD = 0.7


class FactorizationMachine:
    """Over sets of positions 0..size-1. Parameters: constant c, weights w, factors v."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.values = {"c": np.zeros(1), "w": np.zeros(size), "v": random.normal(0, 0.05, (size, factors))}

    def raw(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        c, w, v = (self.values[x] for x in "cwv")
        linear = np.bincount(row, w[at], rows)
        square = np.bincount(row, (v[at] ** 2).sum(1), rows)
        sums = self._sums(row, at, rows)
        return c[0] + linear + 0.5 * ((sums**2).sum(1) - square)

    def _sums(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        v = self.values["v"]
        return np.column_stack([np.bincount(row, v[at, f], rows) for f in range(v.shape[1])])

    def fit(self, row, at, y, weight, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> None:
        """Weighted logistic loss with a ridge on w and v; Adam over the whole sample."""
        rows, size, adam = len(y), len(self.values["w"]), Adam(rate)
        weight = weight / weight.sum()
        for _ in range(rounds):
            v = self.values["v"]
            slope = weight * (sigmoid(self.raw(row, at, rows)) - y)
            each = slope[row]
            sums = self._sums(row, at, rows)
            of_v = np.column_stack([np.bincount(at, each * sums[row, f], size) for f in range(v.shape[1])])
            of_w = np.bincount(at, each, size)
            of_v -= of_w[:, None] * v
            adam.update(
                self.values,
                {"c": np.array([slope.sum()]), "w": of_w + ridge * self.values["w"], "v": of_v + ridge * v},
            )


def best_cut(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where to cut `raw` for the largest weighted F1, in the middle between the values around; without both classes
    where the chance is THRESHOLD."""
    if len(set(y)) < 2:
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    order = np.argsort(-raw, kind="stable")
    raw, hit, all_ = raw[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + hit[-1])
    last = np.append(raw[1:] < raw[:-1], True)  # equal values stay on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((raw[k] + (raw[k + 1] if k + 1 < len(raw) else raw[k] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[int], FactorizationMachine]:
    """The chosen terms and the machine, from about `sample` labelled rows outside the held-out third.

    Without labels of both classes no term is chosen, and every text gets the share of toxic labels.
    """
    drawn = sample_texts(docs, labelled_sample(labels, "toxic", sample))
    terms = telling_terms(drawn, CHOSEN)
    wanted = F.array_intersect(F.col("terms"), F.expr(f"cast(array({','.join(map(str, terms))}) as array<int>)"))
    known = drawn.orderBy("doc_id").select("y", "weight", wanted.alias("terms")).toPandas()
    model = FactorizationMachine(len(terms))
    if len(known) and terms:
        row = np.repeat(np.arange(len(known)), known["terms"].map(len))
        at = places(terms)[np.concatenate([np.asarray(x, np.int64) for x in known["terms"]])]
        y, weight = known["y"].to_numpy(float), known["weight"].to_numpy(float)
        test = np.arange(len(y)) % 5 == 4  # these set the threshold only
        model.fit(row[~test[row]], at[~test[row]], y, np.where(test, 0.0, weight))
        cut = best_cut(model.raw(row, at, len(y))[test], y[test], weight[test])
        model.values["c"] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    elif len(known):
        share = np.average(known["y"], weights=known["weight"])
        model.values["c"][:] = np.log((share + 1e-6) / (1 - share + 1e-6))
    return terms, model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    The whole text counts; a null or empty text has no terms and gets the constant's score. The id decides only whether
    a label may be learnt from. Repeated rows give repeated rows; other columns are ignored; a null id is not held out.
    """
    terms, model = train(docs, labels, sample)
    values = {k: v.astype(np.float64) for k, v in model.values.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(len(terms))
        machine.values = values
        place = places(terms)
        for batch in by_text_size(batches):
            row, at = chosen_terms(Words(texts_of(batch), fold=True), place, max(1, len(terms)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(machine.raw(row, at, batch.num_rows)))], ["doc_id", "score"]
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not toxic, unchanged. The score is computed beside the row, in one narrow pass. Null and
    empty texts score as texts without terms, repeated rows alike; without labels nothing can be learnt and all rows score
    the same; no rows give no rows."""
    terms, model = train(docs, labels)
    values = {k: v.astype(np.float64) for k, v in model.values.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(len(terms))
        machine.values = values
        place = places(terms)
        for batch in by_text_size(batches):
            row, at = chosen_terms(Words(texts_of(batch), fold=True), place, max(1, len(terms)))
            kept = sigmoid(machine.raw(row, at, batch.num_rows)) < threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
