from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_helpers import ODD, no_documents, odd_documents, prose

from quillfold.llm import packing

PATHS = pytest.importorskip("public_tokenizers")
WORD = PATHS.path("word_bpe_49k.json")


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


@pytest.mark.parametrize("final", [True, False])
def test_plan_costs_the_least(final):
    """Against dynamic programming over all pairs of positions."""
    draw = random.Random(8)
    for _ in range(60):
        capacity, size = 64, draw.randrange(1, 400)
        soft = np.array(sorted(draw.sample(range(1, size + 1), size // 9)), np.int64)
        ends = np.array(sorted({*draw.sample(range(1, size + 1), size // 40), size}), np.int64)
        at, cut = packing.cut_positions(size, soft, ends, final, capacity)
        place, cost = at.tolist(), cut.tolist()
        best = [0.0] + [float("inf")] * (len(place) - 1)
        for k in range(1, len(place)):
            for j in range(k):
                if place[k] - place[j] <= capacity:
                    best[k] = min(best[k], best[j] + packing.WINDOW + padding(place[k] - place[j], capacity) + cost[k])
        found = packing.plan(at, cut, capacity, final)
        index = {p: k for k, p in enumerate(place)}
        paid = sum(packing.WINDOW + padding(b - a, capacity) + cost[index[b]] for a, b in zip([0, *found], found, strict=False))
        assert paid == best[index[found[-1]]]
        least = best[-1] if final else min(b for b, p in zip(best, place, strict=True) if p > max(0, size - capacity))
        assert paid == least


def check(pieces, ids, capacity):
    """Every id once, in order; sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, want in ids.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    assert by_doc.keys() == ids.keys()
    lengths = []
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and all(p.sequence_length == at for p in members)
        lengths.append(at)
    return sum(padding(n, capacity) for n in lengths) / sum(lengths)


def test_pieces_of_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 5000)
    docs = [(i, " ".join(prose(100 * i + k, 6 + k % 11).capitalize() + "." for k in range(i % 37))) for i in range(150)]
    docs += [(200 + i, t) for i, (_, t, *_) in enumerate(ODD)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    code = Tokenizer.from_file(WORD)
    ids = {i: [*code.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    assert check(packing.pack(frame, WORD).collect(), ids, 2048) < 0.02


def test_repeated_rows_null_ids_and_no_rows(spark):
    odd = odd_documents(spark)
    pieces = packing.pack(odd, WORD).collect()
    assert sum(p.length for p in pieces if p.doc_id == 5) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 5)
    assert any(p.doc_id is None for p in pieces)
    assert packing.pack(no_documents(spark), WORD).collect() == []
