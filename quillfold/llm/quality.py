"""Quality of documents by co-training of two views.

The text view sees words: chosen hashed terms, how often a word repeats the word before it, how many words are new. The
page view sees metadata and the look of the page: source, language, length, lines, shares of letter cases, digits,
symbols and blanks; never a word. Both are logistic regressions. In each round a view labels the documents of an
unlabelled pool that it is sure of, and the other view learns them. In the end each view is calibrated on labels it has
not learnt from, and the calibrated views are combined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, by_text_size, mix, texts_of
from .learn import chosen_terms, held_out, labelled_sample, logistic, places, sample_texts, sigmoid, telling_terms
from .store import saved

#: Labelled rows and unlabelled rows that the views are fitted on, at most about; terms of the text view.
SAMPLE, POOL, CHOSEN = 8_000, 8_000, 256
#: Rounds of co-training, how sure a view must be to label, and the share of the pool it may label in a round per class.
ROUNDS, SURE, SHARE = 4, 0.95, 0.05
#: Buckets that sources and languages are hashed into.
BUCKETS = 16
KEEP = 0.5

_FIELDS = "lang string, source string, n_chars long"
RESULT = "doc_id long, text_score double, page_score double, score double"


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for a, b in ranges:
        table[a : b + 1] = 1
    return table


_CLASSES = (
    _byte_class((0x41, 0x5A)),  # upper case
    _byte_class((0x61, 0x7A)),  # lower case
    _byte_class((0x80, 0xFF)),  # beyond ASCII
    _byte_class((0x30, 0x39)),  # digits
    _byte_class((0x20, 0x20), (0x09, 0x09)),  # blanks
    _byte_class((0x0A, 0x0A)),  # line breaks
    _byte_class((0x2C, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x27, 0x29)),  # punctuation of prose
    _byte_class((0x21, 0x21), (0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),  # symbols
)


def _hashed(values: list[str | None]) -> np.ndarray:
    """One of BUCKETS per value; null is a value like others."""
    names = Words([f"v{v if v is not None else ''}" for v in values])
    first = np.where(np.diff(names.first) > 0, names.hash[np.minimum(names.first[:-1], max(0, len(names.hash) - 1))], 0)
    return (mix(first) % np.uint64(BUCKETS)).astype(np.int64)


def page_view(words: Words, fields: dict[str, list]) -> np.ndarray:
    rows = len(words.first) - 1
    raw = np.frombuffer(words.raw, np.uint8)
    begin = words.offset[:-1]
    size = np.diff(words.offset) - 1
    shares = []
    for table in _CLASSES:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        shares.append((total[begin + size] - total[begin]) / np.maximum(size, 1))
    lines = shares[5] * size + 1
    told = np.array([np.log1p(max(0, x or 0)) for x in fields["n_chars"]])
    one_hot = np.zeros((rows, 2 * BUCKETS))
    for k, name in enumerate(("source", "lang")):
        one_hot[np.arange(rows), k * BUCKETS + _hashed(fields[name])] = 0.3
    dense = np.column_stack([np.sqrt(np.column_stack(shares)), told / 10, np.log1p(size) / 10, np.log1p(size / lines) / 5, size == 0])
    return np.column_stack([dense, dense[:, :8] ** 2, one_hot])


def text_view(words: Words, place: np.ndarray, number: int) -> np.ndarray:
    rows, count = len(words.first) - 1, np.diff(words.first)
    row = words.text_of_word()
    again = np.zeros(rows)
    if len(row) > 1:
        same = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:], same, rows)
    new = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first, words.first[1:], strict=False)])
    known = np.zeros((rows, number))
    at = chosen_terms(words, place, max(1, number))
    known[at] = 1
    length = np.bincount(row, words.end - words.start, rows) / np.maximum(count, 1)
    share = new / np.maximum(count, 1)
    dense = [again / np.maximum(count, 1), share, share * np.log1p(count) / 5, np.log1p(count) / 10, length / 10, count == 0]
    return np.column_stack([*dense, known])


class Views:
    """The fitted model: plain numbers of bounded size."""

    def __init__(self, terms: list[int]):
        self.terms, self.text, self.page = terms, None, None
        self.calibrated = {"text": np.array([1.0, 0.0]), "page": np.array([1.0, 0.0]), "both": np.array([0.5, 0.5, 0.0])}

    def raw(self, texts: list[str], fields: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts, fold=True)
        t, p = text_view(words, places(self.terms), len(self.terms)), page_view(words, fields)
        return t @ self.text[:-1] + self.text[-1], p @ self.page[:-1] + self.page[-1]

    def scores(self, texts: list[str], fields: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.raw(texts, fields)
        t, p = (x * c[0] + c[1] for x, c in ((t, self.calibrated["text"]), (p, self.calibrated["page"])))
        a, b, c = self.calibrated["both"]
        return sigmoid(t), sigmoid(p), sigmoid(a * t + b * p + c)


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, weight: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS):
    """Coefficients of both views after `rounds` exchanges of confident labels of the pool."""
    views, learnt = [text, page], [[], []]  # learnt[k]: (rows of the pool, labels) that view k got from the other
    free = np.ones(len(pool[0]), bool)
    fitted = [logistic(x, y, weight) for x in views]
    for _ in range(rounds):
        found = []
        for k in range(2):
            p = sigmoid(pool[k] @ fitted[k][:-1] + fitted[k][-1])
            most = max(1, int(SHARE * len(free)))
            for label, sure in ((1, p), (0, 1 - p)):
                rows = np.flatnonzero(free & (sure >= SURE))
                rows = rows[np.argsort(-sure[rows], kind="stable")[:most]]
                found.append((1 - k, rows, np.full(len(rows), float(label))))
        given: dict[int, set] = {0: set(), 1: set()}
        for to, rows, labels in found:
            learnt[to].append((rows, labels))
            given[to] |= set(rows.tolist())
        free[list(given[0] | given[1])] = False
        for k in range(2):
            rows = np.concatenate([r for r, _ in learnt[k]]).astype(int)
            labels = np.concatenate([v for _, v in learnt[k]])
            x = np.concatenate([views[k], pool[k][rows]])
            w = np.concatenate([weight, np.full(len(rows), 0.5 * weight.mean() if len(weight) else 1.0)])
            fitted[k] = logistic(x, np.concatenate([y, labels]), w)
    return fitted


def _matrix(rows: pd.DataFrame, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.array(rows["text_view"].tolist(), float).reshape(len(rows), -1),
        np.array(rows["page_view"].tolist(), float).reshape(len(rows), -1),
    )


def _drawn(docs: DataFrame, extra: DataFrame, terms: list[int]) -> pd.DataFrame:
    """Both views of the documents named in `extra` (doc_id, y, weight), a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(terms)
        for batch in by_text_size(batches):
            words = Words(texts_of(batch), fold=True)
            fields = {c: batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")}
            t, p = text_view(words, place, len(terms)), page_view(words, fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), batch.column("weight"), pa.array(t.tolist(), pa.list_(pa.float32())), pa.array(p.tolist(), pa.list_(pa.float32()))],
                ["doc_id", "y", "weight", "text_view", "page_view"],
            )

    schema = "doc_id long, y int, weight double, text_view array<float>, page_view array<float>"
    return docs.join(F.broadcast(extra), "doc_id").mapInArrow(run, schema).orderBy("doc_id").toPandas()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL, rounds: int = ROUNDS) -> Views | None:
    """The model, from about `sample` labelled rows outside the held-out third and about `pool` unlabelled rows; None
    without labels of both classes. Every fifth labelled row is kept for calibration."""
    docs = _columns(docs)
    labelled = saved(labelled_sample(labels, "quality", sample))
    terms = telling_terms(sample_texts(docs, labelled), CHOSEN)
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    free = ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").filter(~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("pool")), F.lit(1 << 30)) / float(1 << 30)
    free = saved(free)
    unlabelled = free.filter(draw < pool / max(1, free.count())).select("doc_id", F.lit(-1).alias("y"), F.lit(1.0).alias("weight"))
    rows = _drawn(docs, saved(labelled.select("doc_id", "y", "weight").union(unlabelled)), terms)
    known, rest = rows[rows["y"] >= 0], rows[rows["y"] < 0]
    if known["y"].nunique() < 2:
        return None
    test = np.arange(len(known)) % 5 == 4
    text, page = _matrix(known, terms)
    y, weight = known["y"].to_numpy(float), known["weight"].to_numpy(float)
    pooled = _matrix(rest, terms) if len(rest) else (text[:0], page[:0])
    views = Views(terms)
    views.text, views.page = co_train(text[~test], page[~test], y[~test], weight[~test], pooled, rounds)
    if len(set(y[test])) == 2:
        t, p = text[test] @ views.text[:-1] + views.text[-1], page[test] @ views.page[:-1] + views.page[-1]
        views.calibrated["text"] = logistic(t[:, None], y[test], weight[test])
        views.calibrated["page"] = logistic(p[:, None], y[test], weight[test])
        t, p = (x * c[0] + c[1] for x, c in ((t, views.calibrated["text"]), (p, views.calibrated["page"])))
        views.calibrated["both"] = logistic(np.column_stack([t, p]), y[test], weight[test])
    return views


def _columns(docs: DataFrame) -> DataFrame:
    """The columns used, with their types; a metadata column that the table lacks reads as null."""
    kinds = {"doc_id": "long", "text": "string"} | dict(x.split() for x in _FIELDS.split(", "))
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source, n_chars): doc_id, held_out, text_score, page_score, score,
    keep. Scores are chances of good quality; keep: score of `keep` or more.

    The whole text counts. Null and empty texts have no words and are scored like others, null metadata is a value like
    others, repeated rows give repeated rows, other columns are ignored. Without labels of both classes scores are 1 and
    all rows are kept.
    """
    views = train(docs, labels)
    chosen = _columns(docs)
    if views is None:
        one = F.lit(1.0)
        scored = chosen.select("doc_id", one.alias("text_score"), one.alias("page_score"), one.alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_text_size(batches):
                fields = {c: batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")}
                found = views.scores(texts_of(batch), fields)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], [x.split()[0] for x in RESULT.split(", ")])

        scored = chosen.mapInArrow(run, RESULT)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= keep).alias("keep")
    )
