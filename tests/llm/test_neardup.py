from __future__ import annotations

import random

import numpy as np
from llm_helpers import ODD, no_documents, odd_documents, prose

from quillfold.llm import neardup


def plain_classes(docs, similarity=0.8):
    """doc number -> class number, from all pairs."""
    element, first = neardup.shingle_sets([t or "" for _, t in docs])
    sets = [frozenset(element[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            same = (docs[i][1] or "") == (docs[j][1] or "")
            common = len(sets[i] & sets[j])
            if same or (common and common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(docs))]


def want_ids(docs):
    classes = plain_classes(docs)
    least = {}
    for (i, _), c in zip(docs, classes, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    return sorted(repr((i, least[c])) for (i, _), c in zip(docs, classes, strict=True))


def changed(text: str, seed: int, times: int) -> str:
    draw, words = random.Random(seed), text.split()
    for _ in range(times):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(4)
    names = draw.integers(0, 2**63, 500).astype(np.uint64)
    weights = [np.ones(300), np.ones(300), draw.uniform(0, 3, 400), draw.uniform(0, 3, 400), np.full(1, 0.01), np.ones(0)]
    sets = [names[:300], names[50:350], names[:400], names[:400], names[:1], names[:0]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    k = 4000
    signature = neardup.dart_signatures(np.concatenate(sets), np.concatenate(weights), first, k)

    def weighted(i, j):
        a, b = (dict(zip(sets[x].tolist(), weights[x].tolist(), strict=True)) for x in (i, j))
        keys = a.keys() | b.keys()
        return sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys)

    for i in range(4):
        for j in range(i):
            assert abs((signature[i] == signature[j]).mean() - weighted(i, j)) < 0.03
    assert not signature[5].any() and signature[4].all()
    again = neardup.dart_signatures(sets[2][::-1], weights[2][::-1], np.array([0, 400]), k)
    assert (again[0] == signature[2]).all()  # neither order nor neighbours matter


def test_classes_equal_all_pairs(spark):
    docs = [(i, prose(i, 80)) for i in range(60)]
    docs += [(1000 + i, changed(docs[i % 9][1], i, i % 8)) for i in range(120)]  # around the threshold
    docs += [(2000 + i, docs[3][1]) for i in range(30)] + [(3000 + i, t) for i, t in enumerate(["short", "Short!", "two words", "", None, "..."])]
    docs += [(2001, docs[4][1]), (2001, docs[4][1]), (None, docs[5][1]), (None, "only nulls have this text at all"), *((r[0], r[1]) for r in ODD)]
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = found.collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in rows) == want_ids(docs)


def test_unlike_texts_with_shared_passages(spark, monkeypatch):
    """Texts of 11 of 13 shared paragraphs are in common buckets but no duplicates; some of them have a near copy."""
    monkeypatch.setattr(neardup, "LARGE", 6)
    shared = [prose(900 + k, 25) for k in range(13)]
    docs = []
    for i in range(70):
        own = list(shared)
        for k in random.Random(i).sample(range(13), 3):
            own[k] = prose(5000 + 13 * i + k, 25)
        docs.append((i, "\n".join(own)))
    docs += [(100 + i, changed(docs[i][1], i, 3)) for i in range(0, 70, 7)]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in rows) == want_ids(docs)


def test_one_of_each_class_stays(spark):
    docs = odd_documents(spark)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect(), key=repr) == sorted([(None,), (1,), (3,), (4,), (5,), (7,), (8,), (9,)], key=repr)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    assert {(r.node, r.label) for r in neardup.components(links).collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}


def test_no_rows(spark):
    assert neardup.near_duplicates(no_documents(spark)).collect() == []
    assert neardup.keep_first(no_documents(spark)).collect() == []


def test_bands_are_enough_for_two():
    """Large buckets are divided by their common ones: texts meet there if they share two bands."""
    one = neardup.SIMILARITY**neardup.BAND
    fewer = (1 - one) ** neardup.BANDS + neardup.BANDS * one * (1 - one) ** (neardup.BANDS - 1)
    assert fewer < 3e-5


def test_first_nodes_without_sorting_buckets(spark):
    """The same nodes as by sorting whole buckets, but only the first rows of a task go on to a sort."""
    draw = random.Random(5)
    rest = [(k, node, 9, 0 if draw.random() < 0.5 else node % 7 if k else node) for k in range(3) for node in range(1, 400)]
    frame = spark.createDataFrame(rest, "key long, node long, n int, label long")
    members = {}
    for key, _, _, label in rest:
        members[key, label] = members.get((key, label), 0) + 1
    want = [r for k in range(3) for r in sorted((r for r in rest if r[0] == k), key=lambda r: (members[k, r[3]], r[3], r[1]))[: neardup.PIVOTS]]
    found = neardup._pivots(frame)
    plan = found._jdf.queryExecution().executedPlan().toString()  # each rank is cut before its exchange and after it
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") == 2
    assert sorted((r.key, r.node, r.n, r.label) for r in found.collect()) == sorted(want)


def test_buckets_in_parts(spark, monkeypatch):
    """Buckets dealt out in parts give the same classes."""
    monkeypatch.setattr(neardup, "LARGE", 6)
    base = prose(1, 120).split()
    docs = []
    for i in range(60):
        words, draw = list(base), random.Random(i // 2)
        for at in draw.sample(range(120), 6):
            words[at] = f"x{i // 2}y{at}"
        docs.append((i, " ".join([*words, f"z{i}"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(frame).collect())
    monkeypatch.setattr(neardup, "PART", 3)
    assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(frame).collect()) == whole
    want = plain_classes(docs)
    assert all((want[a] == want[b]) == (ca == cb) for a, ca in whole for b, cb in whole)


def test_edited_copies_of_one_text_make_few_rows(spark, monkeypatch):
    """Most pairs of edited copies are no duplicates but share many buckets: they have few rows in later rounds, and classes are
    those of all pairs."""
    monkeypatch.setattr(neardup, "LARGE", 6)
    base = prose(77, 300)
    docs = [(i, changed(base, i, 7)) for i in range(250)]
    made = []
    pivots = neardup._pivots
    monkeypatch.setattr(neardup, "_pivots", lambda rest, *more: made.append(rest.count()) or pivots(rest, *more))
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in rows) == want_ids(docs)
    assert made and made[0] < 60 * len(docs)  # 8,116; divided by pairs of common buckets, 29,453
