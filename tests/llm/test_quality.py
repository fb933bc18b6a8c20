from __future__ import annotations

import numpy as np
from llm_helpers import no_documents, odd_documents, prose

from quillfold.llm import quality
from quillfold.llm.learn import logistic, sigmoid

LABELS = "doc_id long, quality int, toxic int"


def test_views_teach_each_other():
    """With few labels, a view that is weak alone gains from the pool that the other view labels."""
    draw = np.random.default_rng(6)

    def views(y):
        text = draw.normal(size=(len(y), 30))
        text[:, 0] += 3.0 * (2 * y - 1)
        page = draw.normal(size=(len(y), 30))
        page[:, :10] += 0.3 * (2 * y[:, None] - 1)
        return text, page

    y, pool_y, test_y = ((draw.random(n) < 0.5).astype(float) for n in (40, 3000, 2000))
    text, page = views(y)
    fitted = quality.co_train(text, page, y, np.ones(40), views(pool_y))
    test = views(test_y)

    def right(beta, x):
        return np.mean((sigmoid(x @ beta[:-1] + beta[-1]) > 0.5) == test_y)

    assert right(fitted[1], test[1]) > right(logistic(page, y, np.ones(40)), test[1]) + 0.02
    assert right(fitted[0], test[0]) > 0.97


def document(i):
    kind = i % 5
    text = ". ".join(prose(7 * i + k, 9).capitalize() for k in range(6))
    if kind == 0:
        text = text.replace(" ", " | ") if i % 2 else " ".join(["again"] * 60)
    return text


def test_held_out_documents(spark):
    docs = spark.createDataFrame([(i, document(i), "en", f"s{i % 3}", len(document(i))) for i in range(1500)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(900)] + [(None, 1, 0), (4, None, 0)], LABELS)
    both = docs.unionByName(odd_documents(spark).selectExpr("doc_id + 9000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = quality.classify(both, labels).collect()
    assert len(rows) == 1511 and all(0 <= x <= 1 for r in rows for x in (r.text_score, r.page_score, r.score))
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 1500 and (r.held_out or r.doc_id >= 900)]
    assert np.mean([r.keep == (r.doc_id % 5 > 0) for r in unseen]) > 0.97


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep and r.score == 1.0 for r in quality.classify(odd_documents(spark), none).collect())
    assert quality.classify(no_documents(spark), none).collect() == []
    bare = odd_documents(spark).select("doc_id", "text")
    assert len(quality.classify(bare, spark.createDataFrame([(2, 1, 0), (4, 0, 0), (9, 1, 0), (8, 0, 0)], LABELS)).collect()) == 11
