"""Spelling: proper nouns, morphology, corpus vocabulary, misspellings and corrections.

Every verdict about a word is computed once per distinct word and joined back to (document, word)
counts; only the proper-noun rule is per document. Texts are read once, in a narrow pass that counts each document's words
(:func:`token_table`); pass its result, as a table, to the other functions as ``tokens``. Where only verdicts are wanted, the pass
gives each word with its documents (:class:`WordLists`), so that what follows has a row per word and not per document and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runs import Words, slices
from ..functions.text import tok_alpha
from ..session import cut_lineage

# Fixed values
SUFFIXES = ("s", "es", "ed", "ing", "er", "est", "ly", "ment", "ness", "d", "n")
MIN_WORD = 3
MIN_MISSPELLING = 6
MIN_VOCABULARY_DOCS = 3
#: Pairs of word and text, and settled words, that a task holds at most; what it holds beyond that is handed on and forgotten.
HELD = 1 << 20
#: New pairs after which it first looks for settled words.
FEW = 1 << 16


def proper_nouns(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, word`` (lower case) for words always capitalised within their document."""
    seen = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z']*"), F.lit(0))).alias("w"))
    return (
        seen.groupBy(key, F.lower("w").alias("word"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("w").rlike("^[A-Z]")).alias("capped"))
        .filter("n = capped")
        .select(key, "word")
    )


def morph_variants(word: Column) -> Column:
    """The word and its plausible stems, for dictionary lookup."""
    options = [word]
    for suffix in SUFFIXES:
        applies = word.endswith(suffix) & (F.length(word) > len(suffix) + 1)
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        shorter = F.substring(stem, F.lit(1), F.length(stem) - 1)
        for form, cond in (
            (stem, F.lit(True)),
            (F.concat(stem, F.lit("e")), F.lit(True)),
            (shorter, stem.rlike(r"(.)\1\z")),
            (F.concat(shorter, F.lit("y")), stem.endswith("i")),
        ):
            options.append(F.when(applies & cond & (F.length(form) >= 2), form))
    return F.array_distinct(F.array_compact(F.array(*options)))


def stems(words: DataFrame) -> DataFrame:
    """``word, v``: the :func:`morph_variants` of many words without the words themselves. A word meets each suffix as a row, so
    that only the few that apply are worked out."""
    w, suffix = F.col("word"), F.col("_suffix")
    met = words.select("word", F.explode(F.array(*map(F.lit, SUFFIXES))).alias("_suffix"))
    met = met.filter(w.endswith(suffix) & (F.length(w) > F.length(suffix) + 1))
    cut = met.select("word", F.substring(w, F.lit(1), F.length(w) - F.length(suffix)).alias("_stem"))
    stem = F.col("_stem")
    shorter = F.substring(stem, F.lit(1), F.length(stem) - 1)
    forms = F.array(
        stem, F.concat(stem, F.lit("e")), F.when(stem.rlike(r"(.)\1\z"), shorter), F.when(stem.endswith("i"), F.concat(shorter, F.lit("y")))
    )
    return cut.select("word", F.explode(forms).alias("v")).filter(F.length("v") >= 2)


class WordLists:
    """For each word of the texts of one task, the texts that hold it: how often, and whether always capitalised there.

    A word that ``settled`` texts hold is in any dictionary of the words of at most so many documents, so it has no verdict: it
    is told with that number of documents and no texts, and left out from then on. Words with an apostrophe are never settled,
    since verdicts are on the part before it. Whatever a task holds or forgets, a word's rows have ``settled`` documents in all,
    or all its texts.
    """

    def __init__(self, settled: int):
        self.settled = settled
        self.known = pa.array([], pa.binary())
        self._forget()

    def _forget(self) -> None:
        self.sure = pa.array([], pa.binary())
        self.parts: list[list[pa.Array]] = []  # word, key, n, proper: a row per word and text
        self.kept = self.fresh = 0

    def add(self, keys: pa.Array, words: Words) -> bool:
        """More texts; whether it is time for :meth:`told`."""
        known = pc.is_in(words.words, value_set=self.known).to_numpy(zero_copy_only=False)
        text, number, n, proper = words.counted(~known)
        raw = words.words.take(pa.array(number))
        self.parts.append([raw, keys.take(pa.array(text)), pa.array(n, pa.int64()), pa.array(proper)])
        self.fresh += len(raw)
        if self.fresh > max(self.kept, FEW):
            self._settle()
        return self.kept + self.fresh >= HELD

    def _settle(self) -> None:
        """Leave out the words that enough texts hold by now."""
        raw, *columns = (pa.concat_arrays(x) for x in zip(*self.parts, strict=True))
        coded = raw.dictionary_encode()
        ids, words = coded.indices.to_numpy(), coded.dictionary
        whole = ~pc.match_substring(words, "'").to_numpy(zero_copy_only=False)
        enough = (np.bincount(ids, minlength=len(words)) >= self.settled) & whole
        some, left = words.filter(pa.array(enough)), pa.array(~enough[ids])
        self.known, self.sure = pa.concat_arrays([self.known, some]), pa.concat_arrays([self.sure, some])
        self.parts = [[x.filter(left) for x in (raw, *columns)]]
        self.kept, self.fresh = len(self.parts[0][0]), 0

    def told(self) -> list[pa.Array]:
        """Columns ``raw``, ``docs``, ``judged`` (not always capitalised) and ``held`` (key, n, proper) of what was added since
        the last call, which is forgotten."""
        self._settle()
        (raw, *columns), sure = self.parts[0], self.sure
        coded = raw.dictionary_encode()
        ids, size = coded.indices.to_numpy(), len(coded.dictionary)
        order = pa.array(np.argsort(ids, kind="stable"))
        none = np.zeros(len(sure), np.int64)
        docs = np.append(np.bincount(ids, minlength=size), none)
        rows = pa.StructArray.from_arrays([x.take(order) for x in columns], ["key", "n", "proper"])
        held = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, docs)), pa.int32()), rows)
        judged = np.append(np.bincount(ids[~columns[-1].to_numpy(zero_copy_only=False)], minlength=size), none) > 0
        docs[size:] = self.settled
        self._forget()
        if len(self.known) > HELD:
            self.known = self.known.slice(0, 0)
        return [pa.concat_arrays([coded.dictionary, sure]).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(judged), held]


def token_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, raw, word, n, proper``: the style tokens of each document with their counts; ``word`` is cut at the first
    apostrophe; ``proper``: always capitalised there. A document's words are counted where its text is read, so nothing is
    shuffled."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = Words(batch.column("_text").cast(pa.binary()).to_pylist())
            at, number, n, proper = words.counted(np.ones(len(words.words), bool))
            raw = words.words.take(pa.array(number)).cast(pa.string())
            columns = [batch.column("_key").take(pa.array(at)), raw, pa.array(n, pa.int64()), pa.array(proper)]
            yield pa.RecordBatch.from_arrays(columns, [key, "raw", "n", "proper"])

    return with_word(rows.mapInArrow(run, f"`{key}` {kind}, raw string, n long, proper boolean")).select(key, "raw", "word", "n", "proper")


def with_word(tokens: DataFrame) -> DataFrame:
    """Tokens with their ``word``, so that a table of them need not hold it."""
    return tokens.withColumn("word", F.substring_index("raw", "'", 1))


def document_frequency_dictionary(df: DataFrame, key: str, min_docs: int, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """A dictionary mined from the corpus: tokens found in at least ``min_docs`` documents."""
    tokens = token_table(df, key, text) if tokens is None else tokens
    return tokens.groupBy(F.col("raw").alias("word")).agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("word")


def word_frequencies(df: DataFrame, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    if tokens is None:
        return df.select(F.explode(tok_alpha(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return tokens.groupBy(F.col("raw").alias("word")).agg(F.sum("n").alias("n"))


def _unknown(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct words none of whose stems is in the dictionary."""
    absent = words.join(dictionary.select("word"), "word", "left_anti")
    known = stems(absent).join(dictionary.select(F.col("word").alias("v")), "v", "left_semi").select("word").distinct()
    return absent.join(known, "word", "left_anti")


def candidate_tokens(df: DataFrame, key: str, allow: DataFrame | None = None, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """Token counts without proper nouns, short words and allowed words."""
    tokens = token_table(df, key, text) if tokens is None else tokens
    kept = tokens.filter((F.length("word") >= MIN_WORD) & ~F.col("proper")).drop("proper")
    if allow is not None:
        listed = allow.select("word")
        kept = kept.join(listed, "word", "left_anti").join(listed.withColumnRenamed("word", "raw"), "raw", "left_anti")
    return kept


def build_vocabulary(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    allow: DataFrame | None = None,
    min_docs: int = MIN_VOCABULARY_DOCS,
    text: str = "text",
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Out-of-dictionary words used in at least ``min_docs`` documents: the author's own vocabulary."""
    used = candidate_tokens(df, key, allow, text, tokens).select(key, "word").distinct()
    per_word = used.groupBy("word").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return _unknown(per_word.select("word"), dictionary).join(per_word, "word")


def _one_deleted(word: Column) -> Column:
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def _one_swap(a: Column, b: Column) -> Column:
    swapped = lambda i: F.concat(
        F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))
    )
    return (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swapped(i) == b)


def one_edit_matches(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``word, correct``: dictionary words one deletion, insertion, substitution or swap away.

    Two such words always meet among themselves with one letter removed, so the join needs about
    ``len`` keys per word in place of the ``54 * len`` possible edits.
    """
    plain = dictionary.filter((F.length("word") >= MIN_WORD) & ~F.col("word").contains("'"))
    d = plain.select(F.col("word").alias("correct"), F.explode(_one_deleted(F.col("word"))).alias("k"))
    w = words.select("word", F.explode(_one_deleted(F.col("word"))).alias("k"))
    near = (F.levenshtein("word", "correct") == 1) | _one_swap(F.col("word"), F.col("correct"))
    # a word has many keys, which the sizes of tables do not tell, so neither side is sent around whole on their account
    return w.join(d.hint("merge"), "k").filter((F.col("word") != F.col("correct")) & near).select("word", "correct").distinct()


def _verdicts(words: DataFrame, dictionary: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``word, verdict`` of the distinct words that have one."""
    unknown = cut_lineage(_unknown(words, dictionary))
    suspects = unknown.filter(F.length("word") >= MIN_MISSPELLING)
    if vocabulary is not None:
        suspects = suspects.join(vocabulary.select("word"), "word", "left_anti")
    wrong = one_edit_matches(suspects, dictionary).select("word").distinct().withColumn("_wrong", F.lit(True))
    return unknown.join(wrong, "word", "left").select(
        "word", F.when(F.col("_wrong"), "misspelling").otherwise("out_of_vocabulary").alias("verdict")
    )


def spell_check(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    allow: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    text: str = "text",
    tokens: DataFrame | None = None,
) -> DataFrame:
    """``key, word, n, verdict`` with verdict ``misspelling`` or ``out_of_vocabulary``."""
    tokens = cut_lineage(token_table(df, key, text)) if tokens is None else tokens
    tokens = candidate_tokens(df, key, allow, text, tokens)
    verdicts = _verdicts(tokens.select("word").distinct(), dictionary, vocabulary)
    # most tokens are known words, so documents are counted after the join
    return tokens.join(verdicts, "word").groupBy(key, "word", "verdict").agg(F.sum("n").alias("n")).select(key, "word", "n", "verdict")


def listed_verdicts(lists: DataFrame, min_docs: int, key: str) -> DataFrame:
    """``key, word, n, verdict`` as :func:`spell_check` gives with the :func:`document_frequency_dictionary` of ``min_docs``, the
    tokens of a word not yet added up. ``lists``: ``raw, docs, judged, held`` of :class:`WordLists` settled at ``min_docs`` or
    more; they are read several times, so pass something materialised."""
    spelt = cut_lineage(lists.groupBy("raw").agg(F.sum("docs").alias("docs"), F.max("judged").alias("judged")))
    dictionary = cut_lineage(spelt.filter(F.col("docs") >= min_docs).select(F.col("raw").alias("word")))
    long = lambda df: with_word(df.filter("judged")).filter(F.length("word") >= MIN_WORD)
    verdicts = _verdicts(long(spelt).select("word").distinct(), dictionary)
    judged = long(lists)
    # files tell little of the size of lists, so they are not sent around whole on their account
    held = judged.join(verdicts.hint("merge"), "word").select("word", "verdict", F.explode("held").alias("x")).filter("NOT x.proper")
    return held.select(F.col("x.key").alias(key), "word", F.col("x.n").alias("n"), "verdict")


def spelling_rates(checked: DataFrame, key: str) -> DataFrame:
    """``key, misspellings, out_of_vocabulary`` from the rows of :func:`spell_check` or :func:`listed_verdicts`."""
    return checked.groupBy(key).agg(
        F.sum(F.when(F.col("verdict") == "misspelling", F.col("n")).otherwise(0)).alias("misspellings"),
        F.sum(F.when(F.col("verdict") == "out_of_vocabulary", F.col("n")).otherwise(0)).alias("out_of_vocabulary"),
    )


def correction_for(words: DataFrame, dictionary: DataFrame, freq: DataFrame) -> DataFrame:
    """Best correction per word: most frequent, then longest, then alphabetical."""
    ranked = one_edit_matches(words, dictionary).join(
        freq.select(F.col("word").alias("correct"), F.col("n").alias("correct_n")), "correct", "left"
    )
    order = F.struct(-F.coalesce("correct_n", F.lit(0)), -F.length("correct"), F.col("correct"))
    return ranked.groupBy("word").agg(F.min_by(F.struct("correct", F.coalesce("correct_n", F.lit(0)).alias("n")), order).alias("b")).select(
        "word", F.col("b.correct").alias("correct"), F.col("b.n").alias("correct_n")
    )


def build_error_table(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    register: str,
    allow: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    text: str = "text",
    tokens: DataFrame | None = None,
) -> DataFrame:
    """``correct, variant, n, registers``: what gets mistyped and how often.

    A variant commoner than its correction is no error.
    """
    table = cut_lineage(token_table(df, key, text)) if tokens is None else tokens
    tokens = candidate_tokens(df, key, allow, text, table).filter(F.length("word") >= MIN_MISSPELLING)
    if vocabulary is not None:
        tokens = tokens.join(vocabulary.select("word"), "word", "left_anti")
    freq = word_frequencies(df, text, table)
    unknown = _unknown(tokens.select("word").distinct(), dictionary)
    fixes = (
        correction_for(unknown, dictionary, freq)
        .join(freq.withColumnRenamed("n", "own_n"), "word", "left")
        .filter(F.coalesce("own_n", F.lit(0)) <= F.col("correct_n"))
    )
    groups = df.select(key, F.col(register).alias("_register"))
    # the few registers of a pair are gathered as a set
    return (
        tokens.join(fixes.select("word", "correct"), "word")
        .join(groups, key)
        .groupBy("correct", F.col("word").alias("variant"))
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("_register")).alias("registers"))
    )
