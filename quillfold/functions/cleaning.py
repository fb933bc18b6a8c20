"""Prose cleaning steps. Each takes a text Column and returns a text Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_AFTER_WORD, WORD_EDGE, let, trim_all, words

# Thresholds and patterns that decide what counts as prose.
MIN_WORDS = 8
MAX_STRIPPED_RATIO = 0.5
MIN_ALPHA_RATIO = 0.7
INDENTED_LINE = r"^(\s{4,}|\t)\S"
OUTPUT_LINE = (
    r"^\s*(at\s+\S+|Error:|Traceback|npm ERR|warning:|\+\+\+|---|\d+\s*\||[│├└─╭╰]|\$\s|>\s*bun|✓|✗|PASS|FAIL)"
)
SENTENCE_END = r"""[.!?:][)"']?\s*\z"""
LIST_OR_QUOTE = r"^[-*>]\s"
CODE_EXTENSIONS = "ts|tsx|js|jsx|py|json|md|sh|css|html"
INDENT_RUN = 3
OUTPUT_RUN = 4


def strip_fenced_code(text: Column) -> Column:
    closed = r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*\n[\s\S]*?^[ \t]*\1[^\n]*$"
    unclosed = r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*\n[\s\S]*\z"
    return F.regexp_replace(F.regexp_replace(text, closed, "\n"), unclosed, "\n")


def _in_run(flags: Column, i: Column, length: int) -> Column:
    """True where position ``i`` lies in a run of at least ``length`` set flags.

    Such a run exists iff some window of ``length`` flags around ``i`` is all set, so each line
    looks at a fixed neighbourhood and the whole text stays linear.
    """
    hit = F.lit(False)
    for start in range(-(length - 1), 1):
        window = F.lit(True)
        for k in range(length):
            window = window & F.coalesce(F.get(flags, i + (start + k)), F.lit(False))
        hit = hit | window
    return hit


def _positions(arr: Column) -> Column:
    return F.sequence(F.lit(0), F.size(arr) - 1)


def strip_indented_blocks(text: Column) -> Column:
    """Runs of three or more indented lines become one blank line."""

    def rebuild(lines: Column, flags: Column) -> Column:
        def line_at(i: Column) -> Column:
            starts = ~F.coalesce(F.get(flags, i - 1), F.lit(False))
            return F.when(
                F.get(flags, i) & _in_run(flags, i, INDENT_RUN), F.when(starts, F.lit(""))
            ).otherwise(F.get(lines, i))

        return F.array_join(F.filter(F.transform(_positions(lines), line_at), lambda x: x.isNotNull()), "\n")

    return let(
        F.split(text, "\n"),
        lambda lines: let(F.transform(lines, lambda x: x.rlike(INDENTED_LINE)), lambda flags: rebuild(lines, flags)),
    )


def _unsentenceish(line: Column) -> Column:
    t = trim_all(line)
    return (
        ~line.rlike(OUTPUT_LINE) & (F.length(t) > 0) & ~t.rlike(SENTENCE_END) & ~t.rlike(LIST_OR_QUOTE)
    )


def strip_pasted_output(text: Column) -> Column:
    """Drop tool-output lines, and runs of four or more lines that never end a sentence."""

    def rebuild(lines: Column, flags: Column) -> Column:
        def line_at(i: Column) -> Column:
            line = F.get(lines, i)
            drop = F.when(F.get(flags, i), _in_run(flags, i, OUTPUT_RUN)).otherwise(line.rlike(OUTPUT_LINE))
            return F.when(~drop, line)

        return F.array_join(F.filter(F.transform(_positions(lines), line_at), lambda x: x.isNotNull()), "\n")

    return let(
        F.split(text, "\n"),
        lambda lines: let(F.transform(lines, _unsentenceish), lambda flags: rebuild(lines, flags)),
    )


def mask_urls_paths(text: Column) -> Column:
    urls = F.regexp_replace(text, NOT_AFTER_WORD + r"https?://\S+", "[url]")
    return F.regexp_replace(urls, r"(^|\s)(~|\.{0,2})/[\w.\-/]{4,}", "$1[path]")


def mask_file_refs(text: Column) -> Column:
    mentions = F.regexp_replace(text, r"(^|\s)@[\w.\-/]+[ \t]?", "$1")
    place = rf"\.({CODE_EXTENSIONS}):\d"
    # the pattern is slow where it finds nothing, so it only runs on texts that hold such a place
    masked = lambda t: F.regexp_replace(t, WORD_EDGE + rf"[\w\-/]+{place}+(:\d+)?", "[ref]")
    return let(mentions, lambda t: F.when(t.rlike(place), masked(t)).otherwise(t))


def collapse_ws(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


STEPS = (
    strip_fenced_code,
    strip_indented_blocks,
    strip_pasted_output,
    mask_urls_paths,
    mask_file_refs,
    collapse_ws,
)


def clean_expr(text: Column) -> Column:
    for step in STEPS:
        text = step(text)
    return text


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean``, ``stripped_ratio``, ``alpha_ratio``, ``word_count`` and ``rejected``."""
    raw_len = F.length(text)

    def measure(clean: Column) -> Column:
        new_len = F.length(clean)
        letters = new_len - F.length(F.regexp_replace(clean, r"[a-zA-Z'\s]+", ""))
        return F.struct(
            clean.alias("clean"),
            F.when(raw_len > 0, 1 - new_len / raw_len).otherwise(1.0).alias("stripped_ratio"),
            F.when(new_len > 0, letters / new_len).otherwise(0.0).alias("alpha_ratio"),
            words(clean).alias("word_count"),
        )

    # as a generator's output a text is cleaned once; as an expression, a filter on the verdict would clean it for each measure
    cleaned = df.withColumn("_c", F.explode(F.array(let(clean_expr(F.col(text)), measure))))
    verdict = (
        F.when(F.col("stripped_ratio") > MAX_STRIPPED_RATIO, "mostly-stripped")
        .when(F.col("word_count") < MIN_WORDS, "too-short")
        .when(F.col("alpha_ratio") < MIN_ALPHA_RATIO, "mostly-symbols")
    )
    measured = cleaned.withColumns({name: F.col("_c")[name] for name in ("clean", "stripped_ratio", "alpha_ratio", "word_count")})
    return measured.drop("_c").withColumn("rejected", verdict)


def normalize_doc(text: Column) -> Column:
    """Line ends to LF, no trailing blanks, at most one empty line in a row."""
    lf = F.regexp_replace(text, r"\r\n", "\n")
    rstripped = F.regexp_replace(lf, r"[ \t]+(?=\n|\z)", "")
    return trim_all(F.regexp_replace(rstripped, r"\n{3,}", "\n\n"))


def normalize_passage(text: Column, target_words: int = 400) -> Column:
    """Strip markdown dressing and cut to ``target_words``, at a sentence end when one is near."""
    bare = F.regexp_replace(text, r"(?m)^#{1,6}\s+.*$", "")
    bare = F.regexp_replace(bare, r"(?m)^\s*[-*]\s+", "")
    bare = F.regexp_replace(bare, r"\*\*", "")
    bare = trim_all(F.regexp_replace(bare, r"\n{3,}", "\n\n"))

    def cut(body: Column) -> Column:
        def shorten(w: Column) -> Column:
            head = F.array_join(F.slice(w, 1, target_words), " ")

            def at_stop(h: Column) -> Column:
                last = F.length(F.regexp_extract(h, r"(?s)^.*[.!?]", 0))
                return F.when(last - 1 > F.length(h) * 0.5, F.substring(h, F.lit(1), last)).otherwise(h)

            return F.when(F.size(w) <= target_words, body).otherwise(let(head, at_stop))

        return let(F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0)), shorten)

    return let(bare, cut)


# Zero-width, bidirectional and byte-order control characters.
INVISIBLE = "[​-‏‪-‮⁠-⁯﻿]"


def defang(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(text, INVISIBLE, ""), r"(?i)-{3,}(BEGIN|END) UNTRUSTED", "[fence removed]"
    )


def excerpt(text: Column, n: int = 40) -> Column:
    flat = F.split(trim_all(F.regexp_replace(text, r"\s+", " ")), " ")
    return let(
        flat,
        lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " …").otherwise("")),
    )
