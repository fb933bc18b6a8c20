"""Words, shingles and token ids against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillfold.llm.batches import Words, hash_of, shingles
from quillfold.llm.tokens import Encoder

TEXTS = [
    "", " ", "One two  two", "Ünder_score é2 ÀB", "a\nb\n\nc", "x" * 300, "MIT-License, 𝔘nicode 汉字 tail", "\0nul and\ttabs",
    "don't I'll 've", " \n x\n\ny", "a . , b", "ends, with. commas,\nand stops.", "Σίσυφος ΣΑΣ", "<|endoftext|> plain", "  ", " nbsp  em",
]


def plain_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_words_are_those_of_the_pattern():
    words = Words(TEXTS)
    for k, text in enumerate(TEXTS):
        a, b = words.first[k], words.first[k + 1]
        assert [int(h) for h in words.hash[a:b]] == [hash_of(w) for w in plain_words(text)]
    assert len({hash_of(w) for t in TEXTS for w in plain_words(t)}) == len({w for t in TEXTS for w in plain_words(t)})


def test_folding_lowers_letters_beyond_ascii():
    assert Words(["ÉCOLE Straße"], fold=True).hash.tolist() == Words(["école straße"]).hash.tolist()
    assert Words(["ÉCOLE"]).hash.tolist() != Words(["école"]).hash.tolist()


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles(size):
    texts = [*TEXTS, "a b c d e f", "z a b c d e f", "a b c"]
    found, first = shingles(Words(texts), size)
    sets = [found[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    for text, hashes in zip(texts, sets, strict=True):
        n = len(plain_words(text))
        assert len(hashes) == (n - size + 1 if n >= size else min(n, 1))
    whole, later = sets[-3], sets[-2]
    assert later[1:] == whole  # the same run has the same hash wherever it stands
    if size == 5:
        assert not set(sets[-1]) & set(whole)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    paths = pytest.importorskip("public_tokenizers")
    code = Encoder(paths.path(name))
    texts = [*TEXTS, *TEXTS[::-1], "The the THE, the. the\nThe", "a" * 100 + " b"]
    for _ in range(2):  # the second time from memory
        ids, sizes = code.encode(texts)
        ends = np.cumsum(sizes)
        got = [ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)]
        assert got == [x.ids for x in code.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_and_white_space(name):
    """An untouched tokenizer gives special strings their own ids; white space at the end of a piece depends on what follows."""
    paths = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, draw = Tokenizer.from_file(paths.path(name)), random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "hello", "World", " ", "\n", "\n\n", "  ", ".", "<|", "\0", "é", "\t"]
    texts = ["hello <|endoftext|> world <|endoftext|>", "foo\n\n", "bar  "] + ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(400)]
    for special in (False, True):
        plain.encode_special_tokens = special
        code = Encoder(paths.path(name), plain=special)
        for _ in range(2):
            ids, sizes = code.encode(texts)
            got = [ids[b - n : b].tolist() for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
