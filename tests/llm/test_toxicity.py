from __future__ import annotations

import zlib

import numpy as np
from llm_helpers import no_documents, odd_documents, prose

from quillfold.llm import toxicity
from quillfold.llm.learn import logistic, sigmoid

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score))
    p = y == 1
    return (order[p].sum() - p.sum() * (p.sum() - 1) / 2) / p.sum() / (~p).sum()


def test_pairs_that_linear_weights_miss():
    """Insult and group together are toxic, each alone is not: the machine learns it, additive weights can't."""
    draw = np.random.default_rng(1)
    x = draw.random((1500, 12)) < 0.5
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    row, at = np.nonzero(x)
    model = toxicity.FactorizationMachine(12)
    model.fit(row, at, y, np.ones(1500), rounds=400)
    assert auc(model.raw(row, at, 1500), y) > 0.99
    beta = logistic(x.astype(float), y, np.ones(1500))
    assert auc(x @ beta[:-1], y) < 0.65


def test_raw_equals_all_pairs():
    draw = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(9, 4)
    model.values = {"c": draw.normal(size=1), "w": draw.normal(size=9), "v": draw.normal(size=(9, 4))}
    sets = [draw.permutation(9)[: draw.integers(0, 9)] for _ in range(20)]
    row, at = np.repeat(np.arange(20), [len(s) for s in sets]), np.concatenate(sets)
    c, w, v = (model.values[k] for k in "cwv")
    want = [c[0] + w[s].sum() + sum(v[i] @ v[j] for i in s for j in s if i < j) for s in sets]
    assert np.allclose(model.raw(row, at, 20), want)


def test_held_out_documents_are_told_apart(spark):
    insult = ("gromp", "blarg", "snivel")
    docs = [(i, prose(i, 60) + (f" {insult[i % 3]} " if i % 4 == 0 else " ") + prose(-i, 60)) for i in range(1200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_documents(spark).selectExpr("doc_id + 5000 AS doc_id", "text"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1200)] + [(None, 1, 1), (3, None, None)], LABELS)
    found = toxicity.score(frame, labels).collect()
    assert len(found) == 1200 + 11
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    mine = [r for r in found if r.doc_id is not None and r.doc_id < 1200 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in mine]) > 0.98
    kept = {r.doc_id for r in toxicity.without_toxic(frame, labels).collect()}
    assert kept == {r.doc_id for r in found if not r.predicted}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(i, prose(i, 30) + (" gromp" if i % 4 == 0 else "")) for i in range(300)], "doc_id long, text string")
    told = [(i, 1, int(i % 4 == 0)) for i in range(300)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in told]
    one, other = (
        sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (told, flipped)
    )
    assert one == other


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(no_documents(spark), none).collect() == []
    odd = odd_documents(spark)
    assert [r.predicted for r in toxicity.score(odd, none).collect()] == [0] * 11
    assert toxicity.without_toxic(odd, none).columns == odd.columns
    assert abs(sigmoid(np.zeros(1))[0] - 0.5) < 1e-12
