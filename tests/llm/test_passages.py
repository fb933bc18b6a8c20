from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from llm_helpers import ODD, no_documents, odd_documents, prose

from quillfold.llm import passages as p


def plain(rows, window=35):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    passages = [prose(1000 + seed * 50 + i, draw.choice([34, 35, 36, 60, 120])) for i in range(12)]
    rows = []
    for i in range(160):
        parts = [prose(seed * 10_000 + i, draw.randrange(60), 50)]
        for _ in range(draw.randrange(4)):
            x = draw.choice(passages).split(" ")
            a = draw.randrange(3)
            parts += [draw.choice(["\n", " \t", "  "]).join(x[a : len(x) - draw.randrange(3)]), prose(draw.randrange(10**9), draw.randrange(20), 50)]
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(30)]  # copies
    rows += [(2000 + i, prose(i, 20, 30) + " " + passages[0] + " " + prose(-i, 15, 30)) for i in range(60)]  # a hot passage
    rows += [(3000, "na " * 300), (3001, "na " * 35 + "batman"), (3002, " ".join(["a b c"] * 40)), (3003, "na " * 34)]
    return rows


@pytest.mark.parametrize("seed, hot, window", [(1, 4, 35), (2, 1000, 35), (3, 1, 35), (4, 6, 12)])
def test_against_brute_force(spark, seed, hot, window):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, anchor string").repartition(5)
    assert found(p.repeated_passages(docs, window, hot)) == plain(rows, window)


def test_odd_documents(spark):
    rows = [(i, t) for i, t, *_ in ODD]
    assert found(p.repeated_passages(odd_documents(spark))) == plain(rows)
    again = odd_documents(spark).union(odd_documents(spark))
    assert found(p.repeated_passages(again, hot=2)) == plain(rows + rows)
    assert p.repeated_passages(no_documents(spark)).collect() == []


def test_texts_without_passages(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __told string, __row int")
    texts = {r.doc_id: r for r in p.without_passages(docs).collect()}
    spans = {r.doc_id: r for r in p.repeated_passages(docs).collect()}
    assert len(texts) == len(rows) and texts[0].asDict().keys() == set(docs.columns) and texts[0]["__told"] == "x"
    for key, text in rows:
        words = text.split()
        for a, b in reversed(spans[key].spans or []):
            del words[a:b]
        assert texts[key].text == (" ".join(words) if spans[key].spans else text)
        assert spans[key].n_removed == len(text.split()) - len(words)


def test_factors_name_their_reference(spark):
    a, b = prose(1, 80), prose(2, 50)
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{a} z {b}"), (3, f"q q {b}")], "doc_id long, text string")
    texts = p.saved(p._signed(docs, 35).selectExpr("text_key", "doc_id AS rep", "1 AS copies", "n", "anchors", "doc_id AS node"))
    factors = p._factors(p._pieces(p._suspects(docs, texts), 35, 1000)).collect()
    words = {1: f"x {a} y".split(), 2: f"{a} z {b}".split(), 3: f"q q {b}".split()}
    assert factors and all((f.node, f.start) != (f.ref_node, f.ref_start) for f in factors)
    for f in factors:
        size = f.windows + 34
        assert words[f.node][f.start : f.start + size] == words[f.ref_node][f.ref_start : f.ref_start + size]
    assert {(f.node, f.ref_node) for f in factors} == {(1, 2), (2, 1), (2, 3), (3, 2)}
