from __future__ import annotations

import numpy as np
import pytest

from quillfold.llm import topk


def brute(rows, every=100, k=10):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        c = [int(np.floor(1024 * float(x))) for x in v]
        if sum(x * x for x in c) < 2**62:
            whole.append((i, c))
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        own = min(c for i, c in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, c, strict=False)), i) for i, c in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.fixture(params=["mixed lengths", "one length", "close groups", "large", "ties"])
def rows(request):
    draw = np.random.default_rng(3)
    if request.param == "mixed lengths":
        made = [(i, (draw.normal(size=draw.integers(0, 9)) * draw.choice([0.01, 1, 50, 3000])).tolist()) for i in range(1500)]
        return [*made, (None, [1.0]), (7, None), (8, [1.0, None]), (9, [float("nan")]), (10, [float("inf")]), (100, [1.0, 2.0]), (100, [1.0, 2.0])]
    if request.param == "one length":
        return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(draw.normal(size=(1200, 6)))]
    if request.param == "close groups":  # high local thresholds: pruned by coordinate
        heads = draw.normal(size=(60, 8))
        return [(i, (heads[i % 60] + 0.01 * draw.normal(size=8)).tolist()) for i in range(1200)]
    if request.param == "large":
        return [(i, (v * 1e5).tolist()) for i, v in enumerate(draw.normal(size=(600, 5)))] + [(601, [1e300, 1.0]), (602, [2.0**60])]
    return [(i, [0.5, -0.25]) for i in range(500)] + [(1000, [0.0, 0.0]), (1100, [])]


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, v int, square int")
    assert sorted(map(tuple, topk.top_products(frame).collect())) == brute(rows)


def test_few_and_no_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_products(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)).collect() == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_products(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    assert topk.top_products(spark.createDataFrame([], kind)).collect() == []
