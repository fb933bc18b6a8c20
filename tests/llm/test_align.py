from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
from llm_helpers import ODD, no_documents, odd_documents, prose

from quillfold.llm import align as al

PATHS = pytest.importorskip("public_tokenizers")
A, B = PATHS.path("byte_bpe_50k.json"), PATHS.path("piece_bpe_32k.model")


def plain(rows):
    """Whole texts encoded by the libraries, bytes compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = al._byte_characters()
    told, counts = [], Counter()
    for key, text in rows:
        want = b" " + (text or "").encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sa = [bytes(letters[c] for c in a.id_to_token(k)) for k in ia]
        sb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        if not text or b"".join(sa) != want or b"".join(sb) != want:
            told.append((key, [], [], [], []))
            continue
        owner_a = [i for i, x in enumerate(sa) for _ in x]
        owner_b = [i for i, x in enumerate(sb) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        counts.update((ia[i], ib[j]) for i, j in links)
        ends_a, ends_b = ({end: i + 1 for i, end in enumerate(accumulate(map(len, s)))} for s in (sa, sb))
        cuts = [(0, 0)] + [(ends_a[e], ends_b[e]) for e in sorted(set(ends_a) & set(ends_b))]
        groups = [",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])) for (i, j), (x, y) in zip(cuts, cuts[1:], strict=False)]
        told.append((key, ia, ib, groups, [(ia[i], ib[j]) for i, j in links]))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (key, len(ia), len(ib), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "")
            for key, ia, ib, g, links in told
        ),
        key=repr,
    )


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


STRANGE = ["a  b", " lead", "trail ", "trail  ", "\n", "x\n\ny", "tab\tin", "▁under", "a ▁ b", "ideo　graphic 漢字かな", "<|endoftext|> <s> </s> <unk> <0x0A>", "é́ ﬁ Ａ",
           "\0 nul \0", "x\r\ny \r z", "don't we'll I'M", "1234567 3.14", "emoji 👩‍👩‍👧 ok", "a b​c", "  ", "x \n y\n", "\x1c\x1d x", "؀ العربية", "_" * 300, "==>>>!!! ((())) {};\r"]


@pytest.mark.parametrize("frequent", [al.FREQUENT, 40, 0])
def test_against_whole_texts(spark, frequent):
    draw = random.Random(frequent)
    rows = [(i, t) for i, t in enumerate(STRANGE)] + [(100 + i, prose(i, draw.randrange(40), 300)) for i in range(40)]
    rows += [(200 + i, "".join(draw.choice([" ", "  ", "\n", "word", "Ünï", "the", ".", "'s", "7", "-", "▁", "字"]) for _ in range(draw.randrange(30)))) for i in range(150)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, codes string").repartition(3)
    assert found(al.align(docs, A, B, frequent)) == plain(rows)


def test_odd_documents(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in ODD]
    assert found(al.align(odd_documents(spark), A, B)) == plain(rows)
    assert al.align(no_documents(spark), A, B).collect() == []
    assert al.aligned_groups(spark.createDataFrame([(1, "hi you"), (2, None)], "doc_id long, text string"), A, B).orderBy("doc_id").collect()[1]["groups"] == []


def test_forgetting(monkeypatch):
    """What a worker forgets is encoded again."""
    texts = [prose(i, 30, 60) for i in range(30)] + ["y" * 100 + " z"] * 2
    fresh = al.Aligner(A, B)
    want = [fresh.align([t]) for t in texts]
    monkeypatch.setattr(al, "CHUNKS", 20)
    small = al.Aligner(A, B)
    for t, (counts, written, codes, links) in zip(texts, want, strict=True):
        got = small.align([t])
        assert (got[0] == counts).all() and got[1] == written and (got[2] == codes).all() and (got[3] == links).all()


def test_shared_cuts():
    draw = random.Random(1)
    for _ in range(3000):
        size = draw.randrange(1, 40)
        a, b = (sorted({*draw.sample(range(1, size + 1), draw.randrange(size)), size}) for _ in range(2))
        assert al.shared_cuts(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in sorted({*a} & {*b})]
    assert al.shared_cuts([], []) == []
    assert al.shared_cuts(list(range(1, 200_000, 2)), list(range(2, 200_000, 2))) == []
