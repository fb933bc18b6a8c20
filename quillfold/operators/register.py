"""Register tagging: additive scores over surface signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    CONTRACTION,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    count_matches,
    let,
    sentences_plain,
    words,
)

# Registers in tie-break order, and the cue lists that score them.
REGISTERS = ("directive", "raw", "narrative", "academic", "persuasive")
CONNECTIVES = (
    "however", "therefore", "moreover", "furthermore", "nevertheless", "thus", "hence",
    "in contrast", "on the other hand", "but this", "the problem with", "it follows that",
    "this means that", "even so", "granted", "admittedly",
)
PAST_VERBS = (
    "was|were|had|did|went|saw|found|built|started|remember|thought|felt|learned|realised|realized"
)
IMPERATIVES = (
    "add|fix|run|make|build|check|update|remove|delete|write|create|use|set|move|change|commit|push|pull|test|show|"
    "open|close|start|stop|read|find|search|refactor|rename|revert|merge|deploy|install|try|do|give|get|put|keep|let|"
    "go|look|see|tell|explain|continue|finish|implement|verify|confirm|ship|clean|kill|restart"
)
CASUAL = (
    "idk|lol|yeah|yep|nah|ok|okay|gonna|wanna|kinda|sorta|dunno|tbh|imo|btw|anyway|whatever|shit|damn|fuck|hell"
)
CITATION = r"\((?:[A-Z][a-z]+(?:\s+(?:et al\.?|and\s+[A-Z][a-z]+))?,?\s*\d{1,4}|\d{4})\)|\[\d+\]"
CONFIDENCE_FLOOR = 0.2


def _word(alternatives: str) -> str:
    return rf"(?i){NOT_AFTER_WORD}(?:{alternatives}){NOT_BEFORE_WORD}"


def register_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the eleven signal columns."""
    t = F.col(text)
    paragraphs = F.array_max(F.transform(F.split(t, r"\n{2,}"), words))
    sents = sentences_plain(t)

    def sentence_facts(s: Column) -> Column:
        return F.struct(
            F.size(s).cast("long").alias("n"),
            F.size(F.filter(s, lambda x: x.rlike(r"^[a-zA-Z]"))).alias("alpha"),
            F.size(F.filter(s, lambda x: x.rlike(r"^[a-z]"))).alias("lower"),
        )

    lower = F.lower(t)
    connectives = sum((F.when(lower.contains(c), 1).otherwise(0) for c in CONNECTIVES), F.lit(0))
    base = df.select(
        "*",
        let(sents, sentence_facts).alias("_s"),
        words(t).alias("sig_words"),
        count_matches(t, CONTRACTION).alias("_contractions"),
        connectives.cast("long").alias("sig_connectives"),
        count_matches(t, rf"(?i){NOT_AFTER_WORD}(?:i|we)\s+(?:{PAST_VERBS}){NOT_BEFORE_WORD}").alias("sig_first_person_past"),
        t.rlike(CITATION).alias("sig_citation"),
        paragraphs.alias("sig_max_paragraph"),
        t.rlike(rf"(?i)^\s*(?:{IMPERATIVES}){NOT_BEFORE_WORD}").alias("sig_imperative"),
        count_matches(t, _word(CASUAL)).alias("sig_casual"),
    )
    n_words = F.col("sig_words")
    return base.select(
        "*",
        F.col("_s.n").alias("sig_sentences"),
        F.when(F.col("_s.n") > 0, n_words / F.col("_s.n")).otherwise(n_words.cast("double")).alias("sig_mean_sentence"),
        F.when(F.col("_s.alpha") > 0, F.col("_s.lower") / F.col("_s.alpha")).otherwise(0.0).alias("sig_lower_starts"),
        F.when(n_words > 0, F.col("_contractions") / n_words * 100).otherwise(0.0).alias("sig_contraction_rate"),
    ).drop("_s", "_contractions")


def _points(*rules: tuple[Column, float]) -> Column:
    return sum((F.when(cond, F.lit(pts)).otherwise(0.0) for cond, pts in rules), F.lit(0.0))


def tag_register(df: DataFrame, is_document: Column | None = None, text: str = "text") -> DataFrame:
    """Add ``register`` and ``register_confidence`` (margin over the runner-up)."""
    doc = is_document if is_document is not None else F.lit(False)
    c = F.col
    n, mean, low = c("sig_words"), c("sig_mean_sentence"), c("sig_lower_starts")
    directive = _points(
        (n < 20, 0.5), (n < 40, 0.2), (c("sig_imperative"), 0.4), (c("sig_sentences") <= 2, 0.2)
    )
    raw = _points(
        (n.between(20, 400), 0.35),
        (low >= 0.6, 0.4),
        (c("sig_contraction_rate") > 1, 0.2),
        (c("sig_casual") > 0, 0.25),
        (~c("sig_imperative") & (n >= 20), 0.1),
    )
    past = c("sig_first_person_past")
    narrative = _points(
        (past >= 2, 0.5), ((past >= 1) & (c("sig_connectives") <= 1), 0.25), ((mean >= 12) & (low < 0.3), 0.2)
    )
    formal = _points((low < 0.1, 0.4), (c("sig_max_paragraph") > 80, 0.3), (c("sig_citation"), 0.3), (mean >= 15, 0.2))
    argued = formal + F.least(c("sig_connectives"), F.lit(4)) * 0.15
    zero = F.lit(0.0)
    scores = (
        F.when(doc, zero).otherwise(directive),
        raw,
        narrative,
        F.when(doc, formal).otherwise(zero),
        F.when(doc, argued).otherwise(zero),
    )
    # highest score first, declared order on ties; rounding removes float-sum noise
    entries = F.array(
        *[
            F.struct((-F.round(s, 9)).alias("neg"), F.lit(i).alias("ord"), F.lit(r).alias("register"))
            for i, (s, r) in enumerate(zip(scores, REGISTERS))
        ]
    )
    top = F.slice(F.array_sort(entries), 1, 2)
    tagged = register_signals(df, text).withColumn("_top", top)
    margin = F.col("_top")[1]["neg"] - F.col("_top")[0]["neg"]
    return tagged.select(
        *[c(name) for name in df.columns],
        *[c(name) for name in tagged.columns if name.startswith("sig_")],
        F.col("_top")[0]["register"].alias("register"),
        F.round(margin, 3).alias("register_confidence"),
    )


def needs_triage(is_document: Column, verified_by: Column, confidence: Column) -> Column:
    """Documents wait for their author; anything else only when the tag is a near tie."""
    return F.when(is_document, ~verified_by.eqNullSafe(F.lit("author"))).otherwise(confidence < CONFIDENCE_FLOOR)


def verified_gate(df: DataFrame, split: str | None = None) -> DataFrame:
    """Only verified, unquarantined records go downstream; optionally one split of them."""
    ok = df.filter(F.col("verified_by").isNotNull() & F.col("quarantine_reason").isNull())
    return ok.filter(F.col("split") == split) if split else ok


WRITTEN = ("narrative", "academic", "persuasive")


def select_seeds(
    df: DataFrame, split: str | None = None, register: str | None = None, min_words: int = 150
) -> DataFrame:
    wanted = F.col("register") == register if register else F.col("register").isin(*WRITTEN)
    in_split = F.col("split") == split if split else F.lit(True)
    return df.filter(wanted & in_split & (F.col("word_count") >= min_words))
