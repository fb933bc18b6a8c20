"""Per-document style features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import FUNCTION_WORDS
from ..functions.runs import Words, joined, slices, space_spans
from ..functions.text import CONTRACTION, let, sentences_quote, tok_alpha, words
from .spelling import WordLists

MTLD_FACTOR = 0.72
MTLD_MIN_TOKENS = 10

# The features a register contract covers.
CONTRACT_FEATURES = (
    "mean_sentence_words", "sd_sentence_words", "comma_rate", "semicolon_rate", "em_dash_rate",
    "commas_per_sentence", "mtld", "lowercase_start_rate", "contraction_rate", "misspelling_rate",
    "en_dash_rate", "doubled_period_rate", "bold_mid_paragraph_rate",
)


def _mtld_pass(tokens) -> float:
    factors, types, count = 0.0, set(), 0
    for w in tokens:
        count += 1
        if w not in types:  # a new type never lowers the ratio
            types.add(w)
        elif len(types) / count <= MTLD_FACTOR:
            factors += 1
            types, count = set(), 0
    if count:
        factors += (1 - len(types) / count) / (1 - MTLD_FACTOR)
    return len(tokens) / factors if factors > 0 else float(len(tokens))


def _mtld(tokens) -> float:
    return 0.0 if len(tokens) < MTLD_MIN_TOKENS else (_mtld_pass(tokens) + _mtld_pass(tokens[::-1])) / 2


@F.pandas_udf(T.DoubleType())
def mtld_of_tokens(tokens: pd.Series) -> pd.Series:
    """Lexical diversity; each factor depends on where the last one closed, so it walks the tokens."""
    return pd.Series([_mtld(t) for t in tokens], dtype="float64")


def _interpolated(sorted_values: Column, p: float) -> Column:
    """Linear-interpolation percentile of a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(p)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return F.when(F.size(sorted_values) > 0, a + (b - a) * (at - lo)).otherwise(0.0)


def sentence_stats(text: Column) -> Column:
    """Struct of sentence counts and word-per-sentence statistics."""

    def stats(sents: Column) -> Column:
        lens = F.array_sort(F.filter(F.transform(sents, words), lambda n: n > 0))

        def summary(x: Column) -> Column:
            n = F.size(x)
            total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
            return let(
                F.when(n > 0, total / n).otherwise(0.0),
                lambda mean: F.struct(
                    F.size(sents).cast("long").alias("sentences"),
                    mean.alias("mean"),
                    F.when(
                        n > 1,
                        F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / (n - 1)),
                    )
                    .otherwise(0.0)
                    .alias("sd"),
                    _interpolated(x, 0.1).alias("p10"),
                    _interpolated(x, 0.9).alias("p90"),
                    F.size(F.filter(sents, lambda s: s.rlike("^[a-zA-Z]"))).alias("alpha"),
                    F.size(F.filter(sents, lambda s: s.rlike("^[a-z]"))).alias("lower"),
                ),
            )

        return let(lens, summary)

    return let(sentences_quote(text), stats)


def function_word_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, c``: occurrences of each function word, positions in list order."""
    index = F.create_map(*[F.lit(x) for i, w in enumerate(FUNCTION_WORDS) for x in (w, i)])
    # a document's tokens sit in one task, so the partial count leaves at most 150 rows per document
    return (
        df.select(key, F.explode(tok_alpha(F.col(text))).alias("w"))
        .filter(F.col("w").isin(*FUNCTION_WORDS))
        .groupBy(key, "w")
        .agg(F.count("*").alias("c"))
        .select(key, index[F.col("w")].alias("pos"), "c")
    )


def dense(counts: DataFrame, sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Shares of all function words per key from sparse counts; keys without any get zeros."""
    n = len(FUNCTION_WORDS)
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "c"))).alias("m"))
    total = F.greatest(F.col(size), F.lit(1))
    shares = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)) / total)
    return sizes.join(maps, keys, "left").select(
        *keys, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(shares).alias("freqs")
    )


def function_word_freqs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, freqs``: share of each function word among all tokens, in list order."""
    sizes = df.select(key, F.size(tok_alpha(F.col(text))).alias("_n"))
    return dense(function_word_counts(df, key, text), sizes, [key], "_n")


#: What is counted in a text: single characters, and patterns over UTF-8 bytes.
_MARKS = {"_comma": b",", "_semi": b";", "_em": "—".encode(), "_period": b".", "_colon": b":"}
_PATTERNS = {
    "_en": r"\w–\w|\s–\s|–\s", "_dbl": r"\.\s+\.", "_bold": r"(?<=[^\n\r])\*\*[^*\n]+\*\*", "_contr": CONTRACTION,
}
#: Without these bytes a pattern has no match.
_NEEDS = {"_en": "–".encode(), "_dbl": b".", "_bold": b"**", "_contr": b"'"}
_STATS = {"_sentences": "long", "_mean": "double", "_sd": "double", "_p10": "double", "_p90": "double", "_alpha": "int", "_lower": "int"}


_ENDS, _CLOSES = (np.isin(np.arange(256), list(x)) for x in (b".!?", b"\"')]"))


def _sentence_columns(texts: list[bytes]) -> list[np.ndarray]:
    """What :func:`sentence_stats` says of each text, in the order of ``_STATS``: a word (what is between white space) ends a
    sentence with its mark, or with one closing sign after that."""
    data, at = joined(texts)
    start, end = space_spans(data)
    last = data[end - 1]
    ends = _ENDS[last] | _CLOSES[last] & (end - start > 1) & _ENDS[data[end - 2]]
    first = np.searchsorted(start, at)
    ends[first[1:][np.diff(first) > 0] - 1] = True
    stop = np.flatnonzero(ends)
    begin = np.append(0, stop[:-1] + 1) if len(stop) else stop
    text = np.searchsorted(first, begin, "right") - 1
    number = np.bincount(text, minlength=len(texts))
    order = np.lexsort((stop - begin, text))
    lens, text, some = (stop - begin + 1)[order].astype(np.float64), text[order], np.maximum(number, 1)
    mean = np.bincount(text, lens, len(texts)) / some
    spread = np.bincount(text, (lens - mean[text]) * (lens - mean[text]), len(texts))  # in ascending order, one by one
    sd = np.where(number > 1, np.sqrt(spread / np.maximum(number - 1, 1)), 0.0)
    lens, base = np.append(lens, 0.0), np.cumsum(number) - number

    def percentile(p: float) -> np.ndarray:
        at = (some - 1) * p
        low = np.floor(at).astype(np.int64)
        a, b = (lens[np.minimum(base + i, len(lens) - 1)] for i in (low, np.ceil(at).astype(np.int64)))
        return np.where(number > 0, a + (b - a) * (at - low), 0.0)

    letter = data[start[begin]]
    lower, upper = (letter >= 97) & (letter <= 122), (letter >= 65) & (letter <= 90)
    lower, alpha = (np.bincount((np.searchsorted(first, begin, "right") - 1)[x], minlength=len(texts)) for x in (lower, lower | upper))
    return [number, mean, sd, percentile(0.1), percentile(0.9), alpha, lower]


def measured(df: DataFrame, key: str, text: str = "text", settled: int | None = None) -> DataFrame:
    """Sentence statistics, counts, ``word_count`` and ``mtld`` of each text, in one narrow pass: a text is split and its
    tokens are found once, and they do not leave the task. Bytes are read, since no pattern looks at letters beyond ASCII.

    With ``settled``, the same pass also gives rows of another kind, with ``raw, docs, judged, held`` of
    :class:`spelling.WordLists` and nothing else; ``raw`` is NULL in the rows of texts.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {name: re.compile(p.encode()) for name, p in _PATTERNS.items()}
        lists = WordLists(settled) if settled else None
        names = [key, *(f.name for f in fields)]

        def both(of_texts: list[pa.Array] | None, of_words: list[pa.Array] | None = None) -> pa.RecordBatch:
            """Rows of one kind, the columns of the other being NULL."""
            size = len((of_texts or of_words)[0])
            first = of_texts or [pa.nulls(size, t) for t in (key_type, *(f.type for f in fields))]
            last = of_words or [pa.nulls(size, t) for t in (pa.string(), pa.int64(), pa.bool_(), held)]
            return pa.RecordBatch.from_arrays([*first, *last], [*names, "raw", "docs", "judged", "held"])

        for batch in slices(batches, "_text"):
            keys, whole = batch.column("_key"), batch.column("_text").cast(pa.binary())
            texts, null = whole.fill_null(b"").to_pylist(), whole.is_null().to_numpy(zero_copy_only=False)
            words = Words(texts)
            ids, first = words.ids.tolist(), words.first.tolist()
            counts = [[t.count(m) for t in texts] for m in _MARKS.values()]
            counts += [[len(p.findall(t)) if _NEEDS[name] in t else 0 for t in texts] for name, p in patterns.items()]
            sentences = _sentence_columns(texts)
            mtld = [_mtld(ids[a:b]) for a, b in zip(first, first[1:], strict=False)]
            # a null text is not measured, but for the zeros that an empty one has as statistics of sentences
            columns = [pa.array(np.asarray(x), mask=null) for x in (*sentences, *counts, np.diff(words.first), mtld)]
            columns[1:5] = map(pa.array, sentences[1:5])
            columns = [keys, *(c.cast(f.type) for c, f in zip(columns, fields, strict=True))]
            if not lists:
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            key_type = keys.type
            held = pa.list_(pa.struct([("key", key_type), ("n", pa.int64()), ("proper", pa.bool_())]))
            yield both(columns)
            if lists.add(keys, words):
                yield both(None, lists.told())
        if lists and lists.parts:
            yield both(None, lists.told())

    types = _STATS | dict.fromkeys([*_MARKS, *_PATTERNS], "long") | {"word_count": "long", "mtld": "double"}
    as_arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [pa.field(name, as_arrow[t]) for name, t in types.items()]
    words = ["raw string", "docs long", "judged boolean", f"held array<struct<key: {kind}, n: long, proper: boolean>>"] if settled else []
    return rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{name} {t}" for name, t in types.items()), *words]))


def style_features(
    df: DataFrame, key: str, text: str = "text", spelling: DataFrame | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """One row of scalar features per document.

    ``spelling`` (``key, misspellings, out_of_vocabulary``) fills the two spelling rates; without a
    dictionary they stay NULL, which means unmeasured and not zero. ``rows``: what :func:`measured` says of the texts of
    ``df``, if it is at hand as a table.
    """
    n = F.greatest(F.col("word_count"), F.lit(1))
    per100 = lambda c: F.col(c) / n * 100
    per1k = lambda c: F.col(c) / n * 1000
    out = (measured(df, key, text) if rows is None else rows).select(
        key,
        "word_count",
        F.col("_sentences").alias("sentence_count"),
        F.col("_mean").alias("mean_sentence_words"),
        F.col("_sd").alias("sd_sentence_words"),
        F.col("_p10").alias("p10_sentence_words"),
        F.col("_p90").alias("p90_sentence_words"),
        per100("_comma").alias("comma_rate"),
        per100("_semi").alias("semicolon_rate"),
        per100("_em").alias("em_dash_rate"),
        per100("_period").alias("period_rate"),
        per100("_colon").alias("colon_rate"),
        F.when(F.col("_sentences") > 0, F.col("_comma") / F.col("_sentences")).otherwise(0.0).alias("commas_per_sentence"),
        "mtld",
        per1k("_en").alias("en_dash_rate"),
        per1k("_dbl").alias("doubled_period_rate"),
        per1k("_bold").alias("bold_mid_paragraph_rate"),
        F.when(F.col("_alpha") > 0, F.col("_lower") / F.col("_alpha")).otherwise(0.0).alias("lowercase_start_rate"),
        per100("_contr").alias("contraction_rate"),
    )
    if spelling is None:
        null = F.lit(None).cast("double")
        return out.select("*", null.alias("misspelling_rate"), null.alias("out_of_vocabulary_rate"))
    rate = lambda c: F.coalesce(F.col(c), F.lit(0)) / n * 1000
    return (
        out.join(spelling, key, "left")
        .withColumn("misspelling_rate", rate("misspellings"))
        .withColumn("out_of_vocabulary_rate", rate("out_of_vocabulary"))
        .drop("misspellings", "out_of_vocabulary")
    )


def scalars(features: DataFrame, keys: list[str]) -> DataFrame:
    """Long form ``*keys, feature, value`` of the contract features."""
    return features.unpivot(keys, list(CONTRACT_FEATURES), "feature", "value")
