from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillfold.llm import trie as t

SCHEMA = "conv_id long, turn long, role string, text string, key int, node int, n int"


def plain(rows, fork=True):
    """The contract, literally."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: v[:2])] for c, v in convs.items()}
    if fork:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
        turns = {c: turns.get(c - c % 5, [])[: cut[c]] + v[cut[c] :] for c, v in turns.items()}
    members = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saving = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saving[p] = own + sum(saving[x] for x in children[p])
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(turns[c]) == len(p))))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saving[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in members.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def told(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def made(seed, convs, words, most):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(draw.randint(1, most)):
            rows.append((c * 2 + 1 if seed % 2 else c, turn, draw.choice(["user", "assistant"][: 1 + seed % 2]), "é" * draw.randint(0, words)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rows, fan", [(1, 4, 2), (2, 3, 2), (3, 1, 3), (4, 4096, 32)])
def test_against_brute_force(spark, monkeypatch, seed, rows, fan):
    """Blocks of a few rows and several levels of merging."""
    monkeypatch.setattr(t, "ROWS", rows)
    monkeypatch.setattr(t, "FAN", fan)
    monkeypatch.setattr(t, "PIECE", 3)
    data = made(seed, 120, 1 + seed % 3, 7)
    data += [(1000 + k, d, "user", "a common beginning") for k in range(40) for d in range(3)]  # a hot conversation
    data += [(5000, d, "user", "long") for d in range(300)] + [(5001, d, "user", "long") for d in range(200)]
    conversations = table(spark, data)
    assert told(t.trie(t.forked(t.sequences(conversations)))) == plain(data)
    assert told(t.trie(t.sequences(conversations))) == plain(data, fork=False)


def test_odd_rows(spark):
    """Null turns come first, null roles and texts are empty, rows without a conversation are no conversation, ties in turn
    go by symbol, turnless conversations end at the root."""
    rows = [(10, 1, "user", "b"), (10, None, None, None), (11, 5, "user", "x" * 100_000), (12, 0, "", ""), (None, 0, "user", "b"), (-3, 0, "user", "b")]
    rows += [(7, 0, "user", "own only")]  # its base is absent; what is left of it depends on its number
    assert told(t.trie(t.forked(t.sequences(table(spark, rows))))) == plain([r for r in rows])
    tied = [(1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x")]
    assert [r.n_convs for r in t.trie(t.sequences(table(spark, tied))).collect()] == [2, 2, 2]
    assert told(t.trie(t.forked(t.sequences(table(spark, []))))) == []


def test_turns_of_nodes(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "there"), (1, 0, "user", "hi")]
    conversations = table(spark, rows)
    found = t.with_turns(t.trie(t.sequences(conversations)), conversations).orderBy("depth").collect()
    assert [(r.depth, r.role, r.text) for r in found] == [(0, None, None), (1, "user", "hi"), (2, "assistant", "there")]
