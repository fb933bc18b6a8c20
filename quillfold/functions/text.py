"""Text primitives as Column expressions.

There are four tokenisers and two sentence splitters and they are kept apart on purpose: shingles,
style features, retrieval and plain word counts each define a token differently.

Word characters are ASCII throughout. JDK 17's ``\\b`` looks at Unicode letters, so word edges are
written as explicit lookarounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

CONTRACTION = rf"(?i){NOT_AFTER_WORD}\w+'(?:t|s|re|ve|ll|d|m){NOT_BEFORE_WORD}"


def ascii_edges(pattern: str) -> str:
    """Rewrite ``\\b`` into an ASCII word edge, as one lookaround where its side is known."""
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:]):
        opens = not before or before[-1] in "|(:"
        tail = before.rstrip(")")
        if tail.endswith("?") and tail[-2:-1].isalpha():
            tail = tail[:-1]
        closes = (not after or after[0] in "|)") and tail[-1:].isalnum() and tail[-2:-1] != "\\"
        out += (NOT_AFTER_WORD if opens else NOT_BEFORE_WORD if closes else WORD_EDGE) + after
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside higher-order functions.

    Without this, Spark inlines the expression into every lambda that mentions it, and a tokeniser
    regex would rerun for each array position.
    """
    return F.transform(F.array(value), body)[0]


def plain_spaces(text: Column) -> Column:
    """Map no-break and other exotic one-character spaces to a blank, one for one."""
    exotic = "               　﻿"
    return F.translate(text, exotic, " " * len(exotic))


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    return count_matches(text, r"\S+")


def _extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tok_alnum(text: Column) -> Column:
    return _extract(F.lower(text), r"[a-z0-9']+")


def tok_alpha(text: Column) -> Column:
    return _extract(F.lower(text), r"[a-z']+")


def tok_retrieval(text: Column) -> Column:
    return _extract(F.lower(text), r"[a-z][a-z'-]{2,}")


def _split_sentences(text: Column, pattern: str) -> Column:
    flat = F.regexp_replace(text, r"\n+", " ")
    pieces = F.transform(F.split(flat, pattern), trim_all)
    return F.filter(pieces, lambda s: F.length(s) > 0)


def sentences_plain(text: Column) -> Column:
    return _split_sentences(text, r"(?<=[.!?])\s+")


def sentences_quote(text: Column) -> Column:
    return _split_sentences(text, r"""(?<=[.!?])["')\]]?\s+""")


def windows(tokens: Column, n: int) -> Column:
    """Every run of ``n`` tokens, in order, joined by blanks. Too few tokens give an empty array."""
    empty = F.array().cast("array<string>")
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))),
                lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "),
            ),
        ).otherwise(empty),
    )


def window_hashes(tokens: Column, n: int) -> Column:
    """64-bit hash of every run of ``n`` tokens, without building the joined strings."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def ngram_set(text: Column, n: int) -> Column:
    return F.array_distinct(windows(tok_alnum(text), n))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays of distinct values.

    Duplicate removal calls two empty sets equal (1); diversity checks call them unrelated (0).
    """
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(both_empty)).otherwise(inter / union)


def draw(*parts) -> Column:
    """A uniform number in [0, 1) that depends only on the given key parts.

    Keyed draws replace a stateful generator: results do not depend on row order or partitioning.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rlike(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)
