from __future__ import annotations

import random
import re

from llm_helpers import ODD, no_documents, odd_documents

from quillfold.llm import licenses

MIT = licenses.TEMPLATES[0][1]
DOCS = [
    (1, "x MIT License, the mit\nlicense; Apache-License and the GENERAL public license"),
    (2, "general public licenses are mit licensed"),
    (3, "intro words " + MIT.replace("Software", "software") + " outro"),
    (4, "intro " + MIT.replace("limitation the rights", "any limits on rights") + " outro"),
    (5, "permission is hereby granted to all"),
    (6, "Foo.\nLicensed under CC BY-NC 4.0."),
]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    w = words(text)
    hits = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").unionByName(odd_documents(spark).select("doc_id", "text"))
    found = licenses.detect(docs).collect()
    want = sorted(repr((i, *base(t))) for i, t in [*DOCS, *((r[0], r[1]) for r in ODD)])
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found) == want
    told = {r.doc_id: r for r in licenses.detect(docs.limit(len(DOCS))).collect()}
    assert [told[k].labels for k in (1, 2, 5, 6)] == ["apache,gpl,mit", "", "", "cc-by-nc-4.0"]
    assert told[3].labels == "mit-text" and told[3].score == 1.0
    assert "mit-text" in told[4].labels and 0.6 < told[4].score < 1.0
    assert all(0 <= r.score <= 1 for r in found)


def test_no_rows(spark):
    assert licenses.detect(no_documents(spark)).collect() == []


def test_matching_statistics_equal_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        sequences = [[draw.randrange(4) for _ in range(draw.randrange(1, 25))] for _ in range(draw.randrange(1, 4))]
        machine = licenses.SuffixAutomaton(sequences)
        text = [draw.randrange(5) for _ in range(40)]
        runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        longest = [max((n for n in range(k + 1) if tuple(text[k - n : k]) in runs), default=0) for k in range(1, 41)]
        want = [(k + 1 - n, k + 1) for k, n in enumerate(longest) if n >= 2 and (k == 39 or longest[k + 1] != n + 1)]
        found = machine.long_runs(text, 2)
        assert [(a, b) for a, b, _ in found] == want
        for a, b, state in found:
            assert machine.ends[state] == {(i, e) for i, s in enumerate(sequences) for e in range(b - a, len(s) + 1) if s[e - (b - a) : e] == text[a:b]}
