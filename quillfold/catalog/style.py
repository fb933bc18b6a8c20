"""Style and evaluation queries over ``documents`` and ``labels``; the language stands in for the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import FUNCTION_WORDS
from ..functions.text import tok_alpha, tok_retrieval
from ..operators import augment, contracts, delta, panel, retrieval, spelling, stylometry
from ..operators.split import frozen_digest
from ..session import cut_lineage, read_table, spread
from .common import ALPHA, documents, duck_draw
from .corpus import _split_sql as corpus_split

DICT_DOCS = 20
BAND_RUNS = delta.BAND_ITERATIONS
TRIALS = 150


def _features(spark, sf_dir, spelled: bool = False):
    docs = documents(spark, sf_dir)
    rates, rows = None, None
    if spelled:
        table = cut_lineage(stylometry.measured(docs, "doc_id", settled=DICT_DOCS))
        rows = table.filter("raw IS NULL")
        judged = spelling.listed_verdicts(table.filter("raw IS NOT NULL").select("raw", "docs", "judged", "held"), DICT_DOCS, "doc_id")
        rates = spelling.spelling_rates(judged, "doc_id")
    features = stylometry.style_features(docs, "doc_id", spelling=rates, rows=rows)
    return features.join(docs.select("doc_id", F.col("lang").alias("register"), "source"), "doc_id")


def _tokens(docs):
    kept = cut_lineage(spelling.token_table(docs, "doc_id").drop("word"))  # `word` is the beginning of `raw`
    return spelling.with_word(kept)


def _dictionary(docs, tokens=None):
    return spelling.document_frequency_dictionary(docs, "doc_id", DICT_DOCS, tokens=tokens)


def _rounded(df, digits=6, keep=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def q_sentence_stats(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", stylometry.sentence_stats(F.col("text")).alias("s"))
    return _rounded(s.select("doc_id", F.col("s.sentences").alias("sentences"), "s.mean", "s.sd", "s.p10", "s.p90"))


def q_punct_rates(spark, sf_dir):
    return _rounded(
        _features(spark, sf_dir).select(
            "doc_id", "comma_rate", "semicolon_rate", "em_dash_rate", "period_rate", "colon_rate", "commas_per_sentence"
        )
    )


def q_function_word_freqs(spark, sf_dir):
    v = stylometry.function_word_freqs(documents(spark, sf_dir), "doc_id")
    return v.select("doc_id", F.posexplode("freqs").alias("pos", "f")).select("doc_id", "pos", F.round("f", 9).alias("f"))


def q_mtld(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(stylometry.mtld_of_tokens(tok_alpha(F.col("text"))), 6).alias("mtld"))


def q_markers(spark, sf_dir):
    return _rounded(
        _features(spark, sf_dir).select(
            "doc_id", "en_dash_rate", "doubled_period_rate", "bold_mid_paragraph_rate", "lowercase_start_rate", "contraction_rate"
        )
    )


def q_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir, spelled=True).drop("register", "source"))


def q_scalars(spark, sf_dir):
    f = _features(spark, sf_dir, spelled=True)
    return stylometry.scalars(f, ["doc_id"]).select("doc_id", "feature", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- spelling


def q_proper_nouns(spark, sf_dir):
    return spelling.proper_nouns(documents(spark, sf_dir), "doc_id")


def q_morph_variants(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.array_distinct(tok_alpha(F.col("text")))).alias("word")).distinct()
    return words.select("word", F.explode(spelling.morph_variants(F.col("word"))).alias("variant"))


def q_word_frequencies(spark, sf_dir):
    return spelling.word_frequencies(documents(spark, sf_dir))


def q_doc_frequency_vocab(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tokens = _tokens(docs)
    return spelling.build_vocabulary(docs, _dictionary(docs, tokens), "doc_id", tokens=tokens)


def q_spell_check(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tokens = _tokens(docs)
    dictionary = cut_lineage(_dictionary(docs, tokens))
    vocabulary = spelling.build_vocabulary(docs, dictionary, "doc_id", min_docs=10, tokens=tokens)
    return spelling.spell_check(docs, dictionary, "doc_id", vocabulary=vocabulary, tokens=tokens)


def q_correction_for(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tokens = _tokens(docs)
    dictionary = cut_lineage(_dictionary(docs, tokens))
    freq = cut_lineage(spelling.word_frequencies(docs, tokens=tokens))
    suspects = freq.select("word").join(dictionary, "word", "left_anti").filter(F.length("word") >= spelling.MIN_MISSPELLING)
    return spelling.correction_for(suspects, dictionary, freq)


def q_error_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tokens = _tokens(docs)
    t = spelling.build_error_table(docs, cut_lineage(_dictionary(docs, tokens)), "doc_id", "lang", tokens=tokens)
    return t.select("correct", "variant", "n", F.array_join("registers", ",").alias("registers"))


def q_inject_errors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    errors = q_error_table(spark, sf_dir)
    out = augment.inject_errors(docs.select("doc_id", "text"), errors, "doc_id", rate=8.0)
    return out.select("doc_id", F.md5("noisy").alias("digest"), (F.col("noisy") != F.col("text")).alias("changed"))


# ---------------------------------------------------------------- register statistics and contracts


def _lang_stats(features):
    langs = features.select("register").distinct()
    return contracts.register_stats(features, langs)


def q_register_stats(spark, sf_dir):
    f = _features(spark, sf_dir, spelled=True)
    s = _lang_stats(f)
    return _rounded(s.select("register", "documents", "words", "underpowered", "feature", "n", "mean", "sd", "min", "max"))


def q_register_vectors(spark, sf_dir):
    """Mean function-word vector per register."""
    return _rounded(delta.mean_vector(_vectors(spark, sf_dir), "register"), 9)


def _contracts(features):
    return cut_lineage(contracts.register_contracts(_lang_stats(features)))


def q_register_contracts(spark, sf_dir):
    return _rounded(_contracts(_features(spark, sf_dir, spelled=True)))


def _contract_inputs(spark, sf_dir):
    """Features of all documents, each asked for the next language's register in a third of cases."""
    f = cut_lineage(_features(spark, sf_dir, spelled=True))
    nxt = F.expr("CASE register WHEN 'en' THEN 'de' WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'en' END")
    f = f.withColumn("requested", F.when(F.col("doc_id") % 3 == 0, nxt).otherwise(F.col("register")))
    return f, _contracts(f)


def q_validate_contract(spark, sf_dir):
    f, c = _contract_inputs(spark, sf_dir)
    return contracts.validate_contract(f, c, "doc_id").select("doc_id", "requested", "ok", "nearest", "fit", "violations")


def q_nearest_register(spark, sf_dir):
    f, c = _contract_inputs(spark, sf_dir)
    return contracts.nearest_register(f, c, "doc_id")


def q_marker_leaks(spark, sf_dir):
    f, c = _contract_inputs(spark, sf_dir)
    return contracts.marker_leaks(f, c, "doc_id").select("doc_id", "requested", "feature", F.round("value", 6).alias("value"), "z")


def q_contract_compliance(spark, sf_dir):
    f, c = _contract_inputs(spark, sf_dir)
    v = contracts.validate_contract(f, c, "doc_id").join(f.select("doc_id", F.col("source").alias("arm")), "doc_id")
    return _rounded(contracts.contract_compliance(v.withColumn("retried", F.col("doc_id") % 5 == 0)))


def _bleed(spark, sf_dir):
    f, c = _contract_inputs(spark, sf_dir)
    near = contracts.nearest_register(f, c, "doc_id")
    out = f.select("doc_id", "requested", F.col("register").alias("exemplar")).join(near, "doc_id", "left")
    return f, c, out


def q_bleed_matrix(spark, sf_dir):
    _, _, out = _bleed(spark, sf_dir)
    return _rounded(contracts.bleed_matrix(out))


def q_worst_leaks(spark, sf_dir):
    f, c, _ = _bleed(spark, sf_dir)
    leaks = contracts.marker_leaks(f, c, "doc_id").join(f.select("doc_id", F.col("register").alias("exemplar")), "doc_id")
    return contracts.worst_leaks(leaks, ["requested", "exemplar"])


def q_worst_bleed(spark, sf_dir):
    return _rounded(contracts.worst_bleed(contracts.bleed_matrix(_bleed(spark, sf_dir)[2])))


# ---------------------------------------------------------------- Delta


def _vectors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    v = stylometry.function_word_freqs(docs, "doc_id")
    return v.join(docs.select("doc_id", F.col("lang").alias("register"), "source"), "doc_id")


def q_reference_profile(spark, sf_dir):
    return _rounded(delta.reference_profile(_vectors(spark, sf_dir)).filter("sd > 0"), 9)


def q_burrows_delta(spark, sf_dir):
    """Delta between each document and the next one by id."""
    v = cut_lineage(_vectors(spark, sf_dir))
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("freqs").alias("b_freqs"))
    pairs = v.select("doc_id", F.col("freqs").alias("a_freqs")).join(nxt, "doc_id")
    return _rounded(delta.burrows_delta(pairs, delta.reference_profile(v)).select("doc_id", "delta"))


def q_aggregate_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("register"), F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    chunks = delta.aggregate_chunks(docs, "register", "doc_id", block=64)
    return chunks.groupBy("register", "chunk").agg(F.count("*").alias("documents"), F.sum("words").cast("long").alias("words"))


def _chunks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sized = docs.select(
        "doc_id", F.col("lang").alias("register"), F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.size(tok_alpha(F.col("text"))).alias("tokens")
    )
    numbered = delta.aggregate_chunks(sized, "register", "doc_id")
    counts = stylometry.function_word_counts(docs, "doc_id")
    return cut_lineage(delta.chunk_vectors(numbered, counts, "register", "doc_id"))


def q_within_band(spark, sf_dir):
    return _rounded(delta.within_band(_chunks(spark, sf_dir), "register", "chunk", iterations=BAND_RUNS))


def q_band_table(spark, sf_dir):
    """Bands of all registers from texts that are not held out."""
    from ..operators.split import incremental_split

    docs = documents(spark, sf_dir)
    parts = incremental_split(docs.select(F.col("doc_id").cast("string").alias("doc_key"), F.col("lang").alias("register")))
    free = parts.filter("split <> 'holdout'").select(F.col("doc_key").cast("long").alias("doc_id"))
    v = cut_lineage(_vectors(spark, sf_dir).join(free, "doc_id"))
    return _rounded(delta.within_band(v, "register", "doc_id", iterations=BAND_RUNS))


def q_judge_band(spark, sf_dir):
    """Each source's distance from its register's mean, judged against the register's own band."""
    v = cut_lineage(_vectors(spark, sf_dir))
    bands = delta.within_band(v, "register", "doc_id", iterations=BAND_RUNS)
    prof = delta.reference_profile(v, "register")
    own = delta.mean_vector(v, "register").withColumnRenamed("f", "g")
    per_source = delta.mean_vector(v, "register", "source").join(own, ["register", "pos"]).join(prof, ["register", "pos"])
    observed = per_source.filter("sd <> 0").groupBy("register", "source").agg(F.avg(F.abs(F.col("f") - F.col("g")) / F.col("sd")).alias("observed"))
    judged = observed.join(bands, "register")
    return _rounded(
        judged.select("register", "source", "observed", "high", delta.judge_band(F.col("observed"), F.col("high"), F.col("underpowered")).alias("inside"))
    )


def q_general_imposters(spark, sf_dir):
    """Is the first English chunk nearer to other English chunks than to the other languages'?"""
    c = _chunks(spark, sf_dir)
    candidate = c.filter("register = 'en' AND chunk = 0")
    rest = c.filter("NOT (register = 'en' AND chunk = 0)").select(
        F.when(F.col("register") == "en", "author").otherwise("impostor").alias("side"), "freqs"
    )
    return _rounded(delta.general_imposters(candidate, rest, trials=TRIALS))


def q_register_separation(spark, sf_dir):
    """English to German separation for clean and toxic texts, under one profile."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "model").otherwise("author").alias("side"))
    v = cut_lineage(_vectors(spark, sf_dir).join(labels, "doc_id"))
    return _rounded(delta.register_separation(v, "register", "en", "de", delta.reference_profile(v), "side"))


def q_frozen_gate(spark, sf_dir):
    """Does the digest committed last equal the digest of the bands' inputs now?"""
    from ..operators.eventlog import frozen_gate

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    current = frozen_digest(docs, "doc_id", "lang")
    early = frozen_digest(docs.filter("doc_id % 2 = 0"), "doc_id", "lang")
    log = early.select(F.lit(1).alias("seq"), F.lit("eval_preregistered").alias("type"), F.col("digest")).unionByName(
        current.select(F.lit(2).alias("seq"), F.lit("eval_preregistered").alias("type"), F.col("digest"))
    )
    return frozen_gate(log, current, "eval_preregistered")


# ---------------------------------------------------------------- panel


def _judged(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("register"), F.col("source").alias("author_doc"))
    return read_table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("correct", F.col("quality") == 1)


def q_panel_accuracy(spark, sf_dir):
    return _rounded(panel.panel_accuracy(_judged(spark, sf_dir), "register"))


def q_cluster_bootstrap(spark, sf_dir):
    return _rounded(panel.cluster_bootstrap(_judged(spark, sf_dir), "register"))


def _passages(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("register"), "text").join(labels, "doc_id")
    return d.filter("toxic = 0").drop("toxic"), d.filter("toxic = 1").drop("toxic")


def q_build_pairs(spark, sf_dir):
    author, model = _passages(spark, sf_dir)
    p = panel.build_pairs(author, model)
    return p.select("pair_id", "register", "author_side", F.md5("a").alias("a"), F.md5("b").alias("b"), "author_doc", "model_doc")


def q_passages_by_source(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    gens = documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.col("n_chars"))
    return panel.passages_by_source(gens, labels)


def _votes(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    votes = e.select(
        (F.col("user_id") % 1000).alias("pair_id"),
        F.col("event_id").alias("ord"),
        F.expr("CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'A' ELSE 'none' END").alias("vote"),
        F.floor(F.col("value")).cast("double").alias("confidence"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN concat('tell ', event_id) ELSE '' END").alias("tell"),
    )
    pairs = e.select((F.col("user_id") % 1000).alias("pair_id")).distinct().withColumn(
        "author_side", F.when(F.col("pair_id") % 2 == 0, "A").otherwise("B")
    )
    return votes, pairs


def q_majority_vote(spark, sf_dir):
    m = panel.majority_vote(*_votes(spark, sf_dir))
    return _rounded(m.select("pair_id", "author_side", "a", "votes", "confidence", "tell", "guess", "correct"))


def q_noise_share(spark, sf_dir):
    """Share of the accuracy movement between noisy and plain halves, per register."""
    j = _judged(spark, sf_dir).withColumn("arm", F.when(F.col("toxic") == 1, "with").otherwise("without"))
    acc = panel.panel_accuracy(j, "register", "arm").groupBy("register").agg(
        F.max(F.when(F.col("arm") == "with", F.col("accuracy"))).alias("w"), F.max(F.when(F.col("arm") == "without", F.col("accuracy"))).alias("wo")
    )
    return acc.select("register", F.round(panel.orthography_share(F.col("w"), F.col("wo")), 6).alias("share"))


# ---------------------------------------------------------------- retrieval


def q_exemplars_mmr(spark, sf_dir):
    pool = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("register"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("word_count"), "text")
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    queries = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.get(langs, (F.col("item_id") % 4).cast("int")).alias("register"), F.col("text").alias("seed")
    )
    return retrieval.exemplars_mmr(queries, pool)


def _facts(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "conversations"), "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("fact_id"),
        "text",
        F.expr("CASE conv_id % 3 WHEN 0 THEN 'angle_a' WHEN 1 THEN 'angle_b' END").alias("angle"),
        (F.col("turn") == 0).alias("spine"),
    )


def q_idf(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    tokens = facts.select("fact_id", F.explode(tok_retrieval(F.col("text"))).alias("token"))
    n = facts.count()
    return _rounded(retrieval.idf(tokens, n), 9)


_ANGLED = "CASE event_id % 5 WHEN 0 THEN '{\"angle_used\": \"angle_a\"}' WHEN 1 THEN '{\"angleUsed\": \"angle_b\"}' ELSE props END"


def q_angle_usage(spark, sf_dir):
    return retrieval.angle_usage(read_table(spark, sf_dir, "events").selectExpr(f"{_ANGLED} AS data"))


def q_retrieve_facts(spark, sf_dir):
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("leadership "), "text").alias("prompt"))
    usage = read_table(spark, sf_dir, "labels").groupBy(
        F.expr("CASE quality WHEN 1 THEN 'angle_a' ELSE 'angle_b' END").alias("angle")
    ).agg((F.count("*") % 4).alias("uses"))
    return retrieval.retrieve_facts(queries, _facts(spark, sf_dir), usage)


QUERIES = {
    "sentence_stats": q_sentence_stats,
    "punct_rates": q_punct_rates,
    "function_word_freqs": q_function_word_freqs,
    "mtld": q_mtld,
    "markers": q_markers,
    "features": q_features,
    "scalars": q_scalars,
    "proper_nouns": q_proper_nouns,
    "morph_variants": q_morph_variants,
    "word_frequencies": q_word_frequencies,
    "doc_frequency_vocab": q_doc_frequency_vocab,
    "spell_check": q_spell_check,
    "correction_for": q_correction_for,
    "error_table": q_error_table,
    "inject_errors": q_inject_errors,
    "register_stats": q_register_stats,
    "register_vectors": q_register_vectors,
    "register_contracts": q_register_contracts,
    "validate_contract": q_validate_contract,
    "nearest_register": q_nearest_register,
    "marker_leaks": q_marker_leaks,
    "contract_compliance": q_contract_compliance,
    "bleed_matrix": q_bleed_matrix,
    "worst_leaks": q_worst_leaks,
    "worst_bleed": q_worst_bleed,
    "reference_profile": q_reference_profile,
    "burrows_delta": q_burrows_delta,
    "aggregate_chunks": q_aggregate_chunks,
    "within_band": q_within_band,
    "band_table": q_band_table,
    "judge_band": q_judge_band,
    "general_imposters": q_general_imposters,
    "register_separation": q_register_separation,
    "frozen_gate": q_frozen_gate,
    "panel_accuracy": q_panel_accuracy,
    "cluster_bootstrap": q_cluster_bootstrap,
    "build_pairs": q_build_pairs,
    "passages_by_source": q_passages_by_source,
    "majority_vote": q_majority_vote,
    "noise_share": q_noise_share,
    "exemplars_mmr": q_exemplars_mmr,
    "idf": q_idf,
    "angle_usage": q_angle_usage,
    "retrieve_facts": q_retrieve_facts,
}
# ---------------------------------------------------------------- DuckDB equivalents

_FW = "fw AS (SELECT unnest(range(0, 150)) AS pos, unnest([" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + "]) AS w)"
_TK = f"tk AS (SELECT doc_id, lang AS register, source, text, {ALPHA.format('text')} AS t FROM documents)"
_WSP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_SENTS = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?])[\"'')\]]?\s+', '\1' || chr(1), 'g'), chr(1)), "
    rf"lambda x: trim(x, {_WSP})), lambda x: length(x) > 0)"
)


def _cnt(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_FEAT = (
    f"""{_TK},
f0 AS (SELECT *, greatest(len(t), 1) AS n, {_SENTS} AS s FROM tk),
f1 AS (SELECT *, list_filter(list_transform(s, lambda x: len(regexp_extract_all(x, '\\S+'))), lambda x: x > 0)::DOUBLE[] AS lens,
   len(list_filter(s, lambda x: regexp_matches(x, '^[a-zA-Z]'))) AS al, len(list_filter(s, lambda x: regexp_matches(x, '^[a-z]'))) AS lo FROM f0),
ft AS (SELECT doc_id, register, source, len(t)::BIGINT AS word_count, len(s)::BIGINT AS sentence_count,
   coalesce(list_avg(lens), 0.0) AS mean_sentence_words, CASE WHEN len(lens) > 1 THEN list_aggregate(lens, 'stddev_samp') ELSE 0.0 END AS sd_sentence_words,
   coalesce(list_aggregate(lens, 'quantile_cont', 0.1), 0.0) AS p10_sentence_words, coalesce(list_aggregate(lens, 'quantile_cont', 0.9), 0.0) AS p90_sentence_words,
   {_cnt(',')}::DOUBLE / n * 100 AS comma_rate, {_cnt(';')}::DOUBLE / n * 100 AS semicolon_rate, {_cnt('—')}::DOUBLE / n * 100 AS em_dash_rate,
   """
    + _cnt(r"\.")
    + f"::DOUBLE / n * 100 AS period_rate, {_cnt(':')}::DOUBLE / n * 100 AS colon_rate, CASE WHEN len(s) > 0 THEN {_cnt(',')}::DOUBLE / len(s) ELSE 0.0 END AS commas_per_sentence,"
    + _cnt(r"\w–\w|\s–\s|–\s")
    + "::DOUBLE / n * 1000 AS en_dash_rate,"
    + _cnt(r"\.\s+\.")
    + "::DOUBLE / n * 1000 AS doubled_period_rate,"
    + _cnt(r"[^\n\r]\*\*[^*\n]+\*\*")
    + "::DOUBLE / n * 1000 AS bold_mid_paragraph_rate, CASE WHEN al > 0 THEN lo::DOUBLE / al ELSE 0.0 END AS lowercase_start_rate,"
    + _cnt(r"(?i)\b\w+''(t|s|re|ve|ll|d|m)\b")
    + "::DOUBLE / n * 100 AS contraction_rate FROM f1)"
)
_LONG_FEATURES = list(stylometry.CONTRACT_FEATURES)
_LONG = (
    "lf AS (SELECT doc_id, register, source, unnest(["
    + ", ".join(f"'{f}'" for f in _LONG_FEATURES)
    + "]) AS feature, unnest(["
    + ", ".join(_LONG_FEATURES)
    + "]) AS value FROM f13)"
)
_STATS = f"""{{FULL}}, {_LONG},
st AS (SELECT register, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS sd, min(value) AS min, max(value) AS max FROM lf GROUP BY 1, 2),
sz AS (SELECT register, count(*) AS documents, sum(word_count)::BIGINT AS words FROM ft GROUP BY 1),
rs AS (SELECT *, (documents < 5 OR words < 3000) AS underpowered FROM sz JOIN st USING (register)),
ct AS (SELECT register AS against, feature, mean, sd, mean - 2.0 * sd AS low, mean + 2.0 * sd AS high FROM rs WHERE NOT underpowered)"""
_Z = f"""{_STATS},
rq AS (SELECT doc_id, register, source, CASE WHEN doc_id % 3 = 0 THEN CASE register WHEN 'en' THEN 'de' WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'en' END ELSE register END AS requested FROM ft),
z AS (SELECT doc_id, against, lf.feature, value, (value - mean) / sd AS z FROM lf JOIN ct USING (feature) WHERE sd <> 0),
fi AS (SELECT doc_id, against, avg(abs(z)) AS fit, count(*) FILTER (abs(z) > 2.0) AS viol FROM z GROUP BY 1, 2),
nr AS (SELECT doc_id, against AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fit, against) AS k FROM fi) WHERE k = 1),
va AS (SELECT rq.doc_id, rq.source, rq.requested, (coalesce(viol, 0) = 0 AND nearest IS NOT DISTINCT FROM rq.requested) AS ok, nearest, round(fit, 3) AS fit, coalesce(viol, 0)::BIGINT AS violations
  FROM rq LEFT JOIN fi ON fi.doc_id = rq.doc_id AND fi.against = rq.requested LEFT JOIN nr ON nr.doc_id = rq.doc_id)"""
_LEAKS = "lk AS (SELECT rq.doc_id, rq.requested, rq.register AS exemplar, z.feature, z.value, round(z.z, 2) AS z FROM rq JOIN z ON z.doc_id = rq.doc_id AND z.against = rq.requested WHERE abs(z.z) > 1.5)"
_BLEED = """bl AS (SELECT requested, register AS exemplar, count(*) AS n, count(*) FILTER (nearest IS NOT DISTINCT FROM requested)::DOUBLE / count(*) AS hold_rate,
  count(*) FILTER (nearest IS DISTINCT FROM requested AND nearest IS NOT DISTINCT FROM register)::DOUBLE / count(*) AS bleed_rate FROM rq LEFT JOIN nr USING (doc_id) GROUP BY 1, 2)"""

_COUNTS = f"{_TK}, {_FW}, tx AS (SELECT doc_id, unnest(t) AS w FROM tk), wc AS (SELECT doc_id, pos, count(*) AS c FROM tx JOIN fw USING (w) GROUP BY 1, 2)"
_VEC = f"{_COUNTS}, ve AS (SELECT tk.doc_id, tk.register, tk.source, fw.pos, coalesce(c, 0)::DOUBLE / greatest(len(t), 1) AS f FROM tk CROSS JOIN fw LEFT JOIN wc ON wc.doc_id = tk.doc_id AND wc.pos = fw.pos)"
_CHUNKS = f"""{_COUNTS},
wd AS (SELECT doc_id, register, len(regexp_extract_all(text, '\\S+')) AS words, len(t) AS tokens, row_number() OVER (PARTITION BY register ORDER BY doc_id) AS k FROM tk),
wk AS (SELECT register, 0::BIGINT AS k, 0::BIGINT AS carry, 0::BIGINT AS chunk, 0::BIGINT AS nxt FROM (SELECT DISTINCT register FROM wd)
  UNION ALL SELECT wk.register, wd.k, CASE WHEN carry + words >= 1000 THEN 0 ELSE carry + words END, nxt, CASE WHEN carry + words >= 1000 THEN nxt + 1 ELSE nxt END
  FROM wk JOIN wd ON wd.register = wk.register AND wd.k = wk.k + 1),
ck AS (SELECT wd.*, least(wk.chunk, greatest(max(wk.nxt) OVER (PARTITION BY wk.register) - 1, 0)) AS chunk FROM wd JOIN wk USING (register, k)),
cs AS (SELECT register, chunk, sum(tokens) AS tokens FROM ck GROUP BY 1, 2),
cc AS (SELECT register, chunk, pos, sum(c) AS c FROM ck JOIN wc USING (doc_id) GROUP BY 1, 2, 3),
cv AS (SELECT cs.register, cs.chunk, fw.pos, coalesce(c, 0)::DOUBLE / greatest(tokens, 1) AS f FROM cs CROSS JOIN fw LEFT JOIN cc ON cc.register = cs.register AND cc.chunk = cs.chunk AND cc.pos = fw.pos)"""


def _band_sql(vectors: str, key: str) -> str:
    return f"""bd AS (SELECT DISTINCT register, {key} AS k FROM {vectors}), bn AS (SELECT register, count(*) AS documents FROM bd GROUP BY 1),
bs AS (SELECT register, pos, stddev_samp(f) AS sd FROM {vectors} GROUP BY 1, 2),
bi AS (SELECT bd.register, k, it, documents, row_number() OVER (PARTITION BY bd.register, it ORDER BY {duck_draw("'1|band|' || it || '|' || k")}, k) AS rk
   FROM bd JOIN bn USING (register) CROSS JOIN (SELECT unnest(range(1, {BAND_RUNS + 1})) AS it) WHERE documents >= 6),
bh AS (SELECT *, CASE WHEN rk <= documents // 2 THEN 0 ELSE 1 END AS half FROM bi),
bc AS (SELECT register, it, half, count(*) AS m FROM bh GROUP BY 1, 2, 3),
bm AS (SELECT bh.register, it, half, pos, sum(f) AS f FROM bh JOIN {vectors} v ON v.register = bh.register AND v.{key} = bh.k WHERE f > 0 GROUP BY 1, 2, 3, 4),
bg AS (SELECT c.register, c.it, p.pos, max(CASE WHEN c.half = 0 THEN coalesce(f, 0) / m END) AS a, max(CASE WHEN c.half = 1 THEN coalesce(f, 0) / m END) AS b
   FROM bc c CROSS JOIN (SELECT DISTINCT pos FROM bs) p LEFT JOIN bm ON bm.register = c.register AND bm.it = c.it AND bm.half = c.half AND bm.pos = p.pos GROUP BY 1, 2, 3),
be AS (SELECT bg.register, it, avg(abs(a - b) / sd) AS d FROM bg JOIN bs USING (register, pos) WHERE sd <> 0 GROUP BY 1, 2),
ba AS (SELECT bn.register, documents, count(d) AS iterations, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, documents < 6 AS underpowered
   FROM bn LEFT JOIN be USING (register) GROUP BY bn.register, documents)"""


_BAND_OUT = "SELECT register, documents, iterations, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, underpowered FROM ba"

_MV_PARTS = []
for _s in spelling.SUFFIXES:
    _st = f"left(word, length(word) - {len(_s)})"
    _ok = f"(ends_with(word, '{_s}') AND length(word) > {len(_s) + 1})"
    _MV_PARTS += [
        f"CASE WHEN {_ok} THEN {_st} END",
        f"CASE WHEN {_ok} THEN {_st} || 'e' END",
        f"CASE WHEN {_ok} AND length({_st}) >= 2 AND right({_st}, 1) = left(right({_st}, 2), 1) THEN left({_st}, length({_st}) - 1) END",
        f"CASE WHEN {_ok} AND ends_with({_st}, 'i') THEN left({_st}, length({_st}) - 1) || 'y' END",
    ]
_MORPH = "SELECT DISTINCT word, v AS variant FROM (SELECT word, unnest([word, " + ", ".join(_MV_PARTS) + "]) AS v FROM {0}) WHERE v IS NOT NULL AND (v = word OR length(v) >= 2)"
_SPELL = f"""{_TK}, tx AS (SELECT doc_id, register, unnest(t) AS raw FROM tk),
di AS (SELECT raw AS word FROM (SELECT DISTINCT doc_id, raw FROM tx) GROUP BY raw HAVING count(*) >= {DICT_DOCS}),
fq AS (SELECT raw AS word, count(*) AS n FROM tx GROUP BY 1),
pt AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*')) AS w FROM documents),
pn AS (SELECT doc_id, lower(w) AS word FROM pt GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (regexp_matches(w, '^[A-Z]'))),
tc AS (SELECT doc_id, register, raw, split_part(raw, '''', 1) AS word, count(*) AS n FROM tx GROUP BY 1, 2, 3),
ca AS (SELECT tc.* FROM tc LEFT JOIN pn ON pn.doc_id = tc.doc_id AND pn.word = tc.raw WHERE pn.word IS NULL AND length(tc.word) >= 3),
cw AS (SELECT DISTINCT word FROM ca),
kn AS (SELECT DISTINCT m.word FROM ({_MORPH.replace('{0}', 'cw')}) m JOIN di ON di.word = m.variant),
un AS (SELECT word FROM cw WHERE word NOT IN (SELECT word FROM kn))"""


def _edits_sql(source: str) -> str:
    abc = "abcdefghijklmnopqrstuvwxyz"
    return f"""ep AS (SELECT word, unnest(range(1, length(word) + 2)) AS i FROM {source}),
el AS (SELECT word, i, unnest(string_split('{abc}', '')) AS c FROM ep),
ed AS (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) AS e FROM ep WHERE i <= length(word)
 UNION SELECT word, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) FROM ep WHERE i < length(word)
 UNION SELECT word, substr(word, 1, i - 1) || c || substr(word, i + 1) FROM el WHERE i <= length(word)
 UNION SELECT word, substr(word, 1, i - 1) || c || substr(word, i) FROM el),
em AS (SELECT DISTINCT ed.word, e AS correct FROM ed JOIN di ON di.word = e WHERE length(e) >= 3 AND e <> ed.word AND NOT contains(e, '''')),
ec AS (SELECT em.word, correct, coalesce(n, 0) AS correct_n, row_number() OVER (PARTITION BY em.word ORDER BY coalesce(n, 0) DESC, length(correct) DESC, correct) AS k FROM em LEFT JOIN fq ON fq.word = correct)"""


_STEP = (
    "CASE WHEN (len(a.ts) + CASE WHEN list_contains(a.ts, x.ts[1]) THEN 0 ELSE 1 END)::DOUBLE / (a.c + 1) <= 0.72 THEN {'f': a.f + 1, 'c': 0, 'ts': []::VARCHAR[]} "
    "ELSE {'f': a.f, 'c': a.c + 1, 'ts': CASE WHEN list_contains(a.ts, x.ts[1]) THEN a.ts ELSE list_concat(a.ts, x.ts) END} END"
)


def _mtld_sql(tokens: str) -> str:
    return f"list_reduce(list_transform({tokens}, lambda w: {{'f': 0, 'c': 0, 'ts': [w]}}), lambda a, x: {_STEP}, {{'f': 0, 'c': 0, 'ts': []::VARCHAR[]}})"


_MTLD = f"""{_TK}, m0 AS (SELECT doc_id, t, {_mtld_sql('t')} AS a, {_mtld_sql('list_reverse(t)')} AS b FROM tk),
m1 AS (SELECT doc_id, len(t) AS n, a.f + CASE WHEN a.c > 0 THEN (1 - len(a.ts)::DOUBLE / a.c) / (1 - 0.72::DOUBLE) ELSE 0 END AS fa, b.f + CASE WHEN b.c > 0 THEN (1 - len(b.ts)::DOUBLE / b.c) / (1 - 0.72::DOUBLE) ELSE 0 END AS fb FROM m0),
mt AS (SELECT doc_id, CASE WHEN n < 10 THEN 0.0 ELSE (CASE WHEN fa > 0 THEN n / fa ELSE n END + CASE WHEN fb > 0 THEN n / fb ELSE n END) / 2 END::DOUBLE AS mtld FROM m1)"""

_PASSAGE = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+.*$', '', 'g'), '(?m)^\s*[-*]\s+', '', 'g'), '\*\*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)
_PAIRS = (
    rf"""p0 AS (SELECT d.doc_id, lang AS register, toxic, trim({_PASSAGE}, {_WSP}) AS b FROM documents d JOIN labels USING (doc_id)),
p1 AS (SELECT *, regexp_extract_all(b, '\S+') AS ws FROM p0), p2 AS (SELECT *, array_to_string(ws[1:400], ' ') AS hd FROM p1),
p3 AS (SELECT *, length(regexp_extract(hd, '(?s)^.*[.!?]')) AS last FROM p2),
p4 AS (SELECT doc_id, register, toxic, CASE WHEN len(ws) <= 400 THEN b WHEN last - 1 > length(hd) * 0.5 THEN substr(hd, 1, last) ELSE hd END AS t FROM p3),
"""
    + f"""po AS (SELECT doc_id, register, t, row_number() OVER (PARTITION BY register ORDER BY {duck_draw("'11|pool|' || doc_id")}, doc_id) AS num, count(*) OVER (PARTITION BY register) AS n FROM p4 WHERE toxic = 0),
pm AS (SELECT p4.*, (floor({duck_draw("'11|pick|' || p4.doc_id")} * z.n) + 1)::BIGINT AS num FROM p4 JOIN (SELECT DISTINCT register, n FROM po) z USING (register) WHERE toxic = 1),
pp AS (SELECT pm.doc_id AS model_doc, pm.register, po.doc_id AS author_doc, po.t AS atext, pm.t AS mtext, CASE WHEN {duck_draw("'11|side|' || pm.doc_id")} < 0.5 THEN 'A' ELSE 'B' END AS author_side
  FROM pm JOIN po ON po.register = pm.register AND po.num = pm.num WHERE len(regexp_extract_all(po.t, '\\S+')) >= 120 AND len(regexp_extract_all(pm.t, '\\S+')) >= 120)"""
)
_JD = "jd AS (SELECT l.doc_id, lang AS register, source AS author_doc, quality = 1 AS correct, toxic FROM labels l JOIN documents USING (doc_id))"
_BOOT = f"""{_JD}, cl AS (SELECT register, author_doc, sum(correct::INT) AS correct, count(*) AS total FROM jd GROUP BY 1, 2),
nu AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY {duck_draw("'3|cluster|' || author_doc")}, author_doc) AS num, count(*) OVER (PARTITION BY register) AS k FROM cl),
ro AS (SELECT register, it, (floor({duck_draw("'3|' || it || '|' || num")} * k) + 1)::BIGINT AS pick FROM nu CROSS JOIN (SELECT unnest(range(1, 2001)) AS it)),
sh AS (SELECT ro.register, it, sum(correct)::DOUBLE / sum(total) AS p FROM ro JOIN nu ON nu.register = ro.register AND nu.num = ro.pick GROUP BY 1, 2),
ci AS (SELECT register, quantile_cont(p, 0.025) AS lo, quantile_cont(p, 0.975) AS hi FROM sh GROUP BY 1),
ac AS (SELECT register, count(*) AS n, avg(correct::INT) AS accuracy, count(DISTINCT author_doc) AS clusters FROM jd GROUP BY 1)"""
_VOTES = """vo AS (SELECT user_id % 1000 AS pair_id, event_id AS ord, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'A' ELSE 'none' END AS vote,
  floor(value)::DOUBLE AS confidence, CASE WHEN event_id % 3 = 0 THEN concat('tell ', event_id) ELSE '' END AS tell FROM events),
pa AS (SELECT DISTINCT user_id % 1000 AS pair_id, CASE WHEN user_id % 1000 % 2 = 0 THEN 'A' ELSE 'B' END AS author_side FROM events),
ta AS (SELECT pair_id, count(*) FILTER (vote = 'A') AS a, count(*) AS votes, avg(coalesce(confidence, 3.0)) AS confidence, min_by(tell, ord) FILTER (tell <> '') AS tell FROM vo WHERE vote IN ('A', 'B') GROUP BY 1)"""
_FACTS = "fa AS (SELECT conv_id * 100 + turn AS fact_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS t, CASE conv_id % 3 WHEN 0 THEN 'angle_a' WHEN 1 THEN 'angle_b' END AS angle, turn = 0 AS spine FROM conversations), fx AS (SELECT fact_id, unnest(t) AS token FROM fa), id AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM fa) + 1) / (count(*) + 0.5)) AS w FROM fx GROUP BY 1)"
_GROUP_SQL = " ".join(
    f"WHEN list_has_any(q, {[k, *v]!r}) AND k = {i} THEN {[k, *v]!r}" for i, (k, v) in enumerate(retrieval.SYNONYMS.items())
)
_RETR = f"""{_FACTS}, q0 AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower('leadership ' || text), '[a-z][a-z''-]{{2,}}')) AS q FROM benchmark),
q1 AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(q) AS token FROM q0 UNION ALL
   SELECT query_id, unnest(CASE {_GROUP_SQL} END) FROM q0 CROSS JOIN (SELECT unnest(range(0, {len(retrieval.SYNONYMS)})) AS k))),
us AS (SELECT CASE quality WHEN 1 THEN 'angle_a' ELSE 'angle_b' END AS angle, count(*) % 4 AS uses FROM labels GROUP BY 1),
sc AS (SELECT query_id, fact_id, sum(round(w * 1e9)::BIGINT) / 1e9 AS s FROM fx JOIN q1 USING (token) JOIN id USING (token) GROUP BY 1, 2),
se AS (SELECT query_id, fa.fact_id, spine, coalesce(s, 0) / sqrt(greatest(len(t), 1)) * CASE WHEN fa.angle IS NOT NULL THEN pow(0.7, coalesce(uses, 0)) ELSE 1.0 END AS score
   FROM (SELECT query_id FROM q0) CROSS JOIN fa LEFT JOIN sc USING (query_id, fact_id) LEFT JOIN us ON us.angle = fa.angle),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS pick FROM se WHERE score > 0 OR spine)"""


_ERRORS = (
    f"{_SPELL}, su AS (SELECT word FROM un WHERE length(word) >= 6), {_edits_sql('su')}, ok AS (SELECT ec.word, correct FROM ec LEFT JOIN fq ON fq.word = ec.word WHERE k = 1 AND coalesce(fq.n, 0) <= correct_n), "
    "et AS MATERIALIZED (SELECT correct, word AS variant, sum(n)::BIGINT AS n, string_agg(DISTINCT register, ',' ORDER BY register) AS registers FROM ca JOIN ok USING (word) GROUP BY 1, 2)"
)
# Attempts one after another, each on the text that the one before has left.
_NOISE = f"""WITH RECURSIVE {_ERRORS},
cum AS MATERIALIZED (SELECT correct, variant, sum(n) OVER (ORDER BY n DESC, correct, variant) AS high, n FROM et),
bud AS MATERIALIZED (SELECT doc_id, text, floor(8.0::DOUBLE / 1000 * len(regexp_extract_all(text, '\\S+')) + 0.5)::INTEGER AS budget FROM documents),
dra AS (SELECT doc_id, k, floor({duck_draw("'13|' || doc_id || '|' || k")} * (SELECT max(high) FROM cum)) AS at FROM (SELECT doc_id, unnest(range(0, 12 * budget)) AS k FROM bud)),
pic AS MATERIALIZED (SELECT doc_id, k, correct, variant FROM dra ASOF JOIN cum ON dra.at < cum.high),
wal(doc_id, k, budget, used, text) AS (SELECT doc_id, 0::BIGINT, budget, []::VARCHAR[], text FROM bud UNION ALL
 SELECT doc_id, k + 1, budget, CASE WHEN m <> '' THEN list_append(used, correct) ELSE used END,
  CASE WHEN m <> '' THEN regexp_replace(text, '(^|[^A-Za-z0-9_])' || m || '($|[^A-Za-z0-9_])', '\\1' || CASE WHEN left(m, 1) = upper(left(m, 1)) THEN upper(left(variant, 1)) || substr(variant, 2) ELSE variant END || '\\2') ELSE text END
 FROM (SELECT wal.*, correct, variant, CASE WHEN list_contains(used, correct) THEN '' ELSE regexp_extract(text, '(?i:(?:^|[^A-Za-z0-9_])(' || correct || ')(?:$|[^A-Za-z0-9_]))', 1) END AS m
  FROM wal JOIN pic ON pic.doc_id = wal.doc_id AND pic.k = wal.k WHERE len(used) < budget))
SELECT b.doc_id, md5(w.text) AS digest, w.text <> b.text AS changed FROM (SELECT doc_id, arg_max(text, k) AS text FROM wal GROUP BY 1) w JOIN bud b USING (doc_id)"""


# The greedy walk: one step per row of a query's ranking, with what it has picked so far.
_EXEMPLARS = """WITH RECURSIVE po AS MATERIALIZED (SELECT doc_id, lang AS register, len(regexp_extract_all(text, '\\S+'))::BIGINT AS wc, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS t,
  regexp_extract_all(lower(text), '[a-z0-9'']+') AS a FROM documents),
qu AS MATERIALIZED (SELECT item_id AS query_id, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS register, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS q FROM benchmark),
ov AS (SELECT query_id, doc_id, count(*) AS o FROM (SELECT query_id, register, unnest(q) AS w FROM qu) JOIN (SELECT doc_id, register, unnest(t) AS w FROM po) USING (register, w) GROUP BY 1, 2),
sc AS (SELECT query_id, po.doc_id, wc, coalesce(o, 0) / sqrt(greatest(len(t), 1)) AS score FROM qu JOIN po USING (register) LEFT JOIN ov USING (query_id, doc_id)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc),
sh AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, len(a) - 3), lambda i: hash(array_to_string(a[i:i + 4], ' ')))) AS s FROM po),
wk(query_id, r, n, words, picked, doc_id) AS (SELECT query_id, 0::BIGINT, 0, 0::BIGINT, []::UBIGINT[][], NULL::BIGINT FROM qu UNION ALL
 SELECT query_id, r, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN words + wc ELSE words END, CASE WHEN ok THEN list_append(picked, s) ELSE picked END, CASE WHEN ok THEN doc END FROM (
  SELECT wk.query_id, rk.r, wk.n, wk.words, wk.picked, rk.wc, rk.doc_id AS doc, sh.s, (wk.n = 0 OR wk.words + rk.wc <= 900) AND len(list_filter(wk.picked,
    lambda p: len(p) > 0 AND len(sh.s) > 0 AND len(list_intersect(p, sh.s))::DOUBLE / (len(p) + len(sh.s) - len(list_intersect(p, sh.s))) > 0.3)) = 0 AS ok
  FROM wk JOIN rk ON rk.query_id = wk.query_id AND rk.r = wk.r + 1 JOIN sh ON sh.doc_id = rk.doc_id WHERE wk.n < 3))
SELECT query_id, doc_id, po.register, po.wc AS word_count, round(score, 4) AS score, n AS pick FROM wk JOIN rk USING (query_id, doc_id) JOIN po USING (doc_id) WHERE doc_id IS NOT NULL"""


# All features of the contracts: those of one text, lexical diversity and the misspelling rate.
_FULL = (
    f"{_FEAT}, {_MTLD.replace(_TK + ', ', '')}, {_SPELL.replace(_TK + ', ', '')}, su AS (SELECT word FROM un WHERE length(word) >= 6), {_edits_sql('su')}, "
    "sp AS (SELECT doc_id, sum(n) AS ms FROM ca JOIN un USING (word) WHERE word IN (SELECT word FROM em) GROUP BY 1), "
    "f13 AS (SELECT ft.*, mtld, coalesce(ms, 0)::DOUBLE / greatest(word_count, 1) * 1000 AS misspelling_rate FROM ft JOIN mt USING (doc_id) LEFT JOIN sp USING (doc_id))"
)


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.replace('{FULL}', _FULL)} {select}"


def _r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols.split())


ORACLES = {
    "sentence_stats": _with(_FEAT, "SELECT doc_id, sentence_count AS sentences, round(mean_sentence_words, 6) AS mean, round(sd_sentence_words, 6) AS sd, round(p10_sentence_words, 6) AS p10, round(p90_sentence_words, 6) AS p90 FROM ft"),
    "punct_rates": _with(_FEAT, f"SELECT doc_id, {_r('comma_rate semicolon_rate em_dash_rate period_rate colon_rate commas_per_sentence')} FROM ft"),
    "function_word_freqs": _with(_VEC, "SELECT doc_id, pos::INTEGER AS pos, round(f, 9) AS f FROM ve"),
    "mtld": _with(_MTLD, "SELECT doc_id, round(mtld, 6) AS mtld FROM mt"),
    "markers": _with(_FEAT, f"SELECT doc_id, {_r('en_dash_rate doubled_period_rate bold_mid_paragraph_rate lowercase_start_rate contraction_rate')} FROM ft"),
    "scalars": _with(_FULL + ", " + _LONG, "SELECT doc_id, feature, round(value, 6) AS value FROM lf"),
    "proper_nouns": _with(_SPELL, "SELECT doc_id, word FROM pn"),
    "morph_variants": _with(f"{_TK}, w AS (SELECT DISTINCT unnest(t) AS word FROM tk)", _MORPH.replace("{0}", "w")),
    "word_frequencies": _with(_SPELL, "SELECT word, n FROM fq"),
    "doc_frequency_vocab": _with(_SPELL, "SELECT word, count(DISTINCT doc_id) AS docs FROM ca JOIN un USING (word) GROUP BY word HAVING count(DISTINCT doc_id) >= 3"),
    "spell_check": _with(
        f"{_SPELL}, vc AS (SELECT word FROM ca JOIN un USING (word) GROUP BY word HAVING count(DISTINCT doc_id) >= 10), su AS (SELECT word FROM un WHERE length(word) >= 6 AND word NOT IN (SELECT word FROM vc)), {_edits_sql('su')}",
        "SELECT doc_id, word, sum(n)::BIGINT AS n, CASE WHEN word IN (SELECT word FROM em) THEN 'misspelling' ELSE 'out_of_vocabulary' END AS verdict FROM ca JOIN un USING (word) GROUP BY 1, 2",
    ),
    "features": _with(
        f"{_FEAT}, {_MTLD.replace(_TK + ', ', '')}, {_SPELL.replace(_TK + ', ', '')}, su AS (SELECT word FROM un WHERE length(word) >= 6), {_edits_sql('su')}, "
        "sp AS (SELECT doc_id, sum(CASE WHEN word IN (SELECT word FROM em) THEN n ELSE 0 END) AS ms, sum(CASE WHEN word IN (SELECT word FROM em) THEN 0 ELSE n END) AS oo FROM ca JOIN un USING (word) GROUP BY 1)",
        "SELECT ft.doc_id, word_count, sentence_count, "
        + _r("mean_sentence_words sd_sentence_words p10_sentence_words p90_sentence_words comma_rate semicolon_rate em_dash_rate period_rate colon_rate commas_per_sentence mtld en_dash_rate doubled_period_rate bold_mid_paragraph_rate lowercase_start_rate contraction_rate")
        + ", round(coalesce(ms, 0)::DOUBLE / greatest(word_count, 1) * 1000, 6) AS misspelling_rate, round(coalesce(oo, 0)::DOUBLE / greatest(word_count, 1) * 1000, 6) AS out_of_vocabulary_rate FROM ft JOIN mt USING (doc_id) LEFT JOIN sp USING (doc_id)",
    ),
    "correction_for": _with(f"{_SPELL}, su AS (SELECT word FROM fq WHERE length(word) >= 6 AND word NOT IN (SELECT word FROM di)), {_edits_sql('su')}", "SELECT word, correct, correct_n FROM ec WHERE k = 1"),
    "error_table": _with(_ERRORS, "SELECT * FROM et"),
    "inject_errors": _NOISE,
    "register_stats": _with(_STATS, f"SELECT register, documents, words, underpowered, feature, n, {_r('mean sd min max')} FROM rs"),
    "register_vectors": _with(_VEC, "SELECT register, pos::INTEGER AS pos, round(avg(f), 9) AS f FROM ve GROUP BY 1, 2"),
    "register_contracts": _with(_STATS, f"SELECT against AS register, feature, {_r('mean sd low high')} FROM ct"),
    "validate_contract": _with(_Z, "SELECT doc_id, requested, ok, nearest, fit, violations FROM va"),
    "nearest_register": _with(_Z, "SELECT doc_id, nearest FROM nr"),
    "marker_leaks": _with(f"{_Z}, {_LEAKS}", "SELECT doc_id, requested, feature, round(value, 6) AS value, z FROM lk"),
    "contract_compliance": _with(_Z, "SELECT source AS arm, count(*) FILTER (ok) AS passed, count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS retried, round(avg(fit), 6) AS mean_fit FROM va GROUP BY 1"),
    "bleed_matrix": _with(f"{_Z}, {_BLEED}", "SELECT requested, exemplar, n, round(hold_rate, 6) AS hold_rate, round(bleed_rate, 6) AS bleed_rate FROM bl"),
    "worst_leaks": _with(f"{_Z}, {_LEAKS}", "SELECT requested, exemplar, feature, z AS worst_z FROM (SELECT *, row_number() OVER (PARTITION BY requested, exemplar, feature ORDER BY abs(z) DESC, z DESC) AS k FROM lk) WHERE k = 1"),
    "worst_bleed": _with(f"{_Z}, {_BLEED}", "SELECT round(max(bleed_rate), 6) AS worst_bleed, max(bleed_rate) <= 0.1 AS passes FROM bl WHERE requested <> exemplar"),
    "reference_profile": _with(_VEC, "SELECT pos::INTEGER AS pos, round(avg(f), 9) AS mean, round(stddev_samp(f), 9) AS sd FROM ve GROUP BY 1 HAVING stddev_samp(f) > 0"),
    "burrows_delta": _with(f"{_VEC}, pf AS (SELECT pos, stddev_samp(f) AS sd FROM ve GROUP BY 1)", "SELECT a.doc_id, round(avg(abs(a.f - b.f) / sd), 6) AS delta FROM ve a JOIN ve b ON b.doc_id = a.doc_id + 1 AND b.pos = a.pos JOIN pf ON pf.pos = a.pos WHERE sd <> 0 GROUP BY 1"),
    "aggregate_chunks": _with(_CHUNKS, "SELECT register, chunk, count(*) AS documents, sum(words)::BIGINT AS words FROM ck GROUP BY 1, 2"),
    "within_band": _with(f"{_CHUNKS}, {_band_sql('cv', 'chunk')}", _BAND_OUT),
    "band_table": _with(
        f"{_VEC}, k0 AS (SELECT doc_id::VARCHAR AS doc_key, lang AS register FROM documents), "
        + corpus_split("sp", "k0")
        + f", vh AS (SELECT ve.* FROM ve JOIN sp ON doc_key = doc_id::VARCHAR WHERE split <> 'holdout'), {_band_sql('vh', 'doc_id')}",
        _BAND_OUT,
    ),
    "judge_band": _with(
        f"{_VEC}, {_band_sql('ve', 'doc_id')}, rm AS (SELECT register, pos, avg(f) AS g, stddev_samp(f) AS sd FROM ve GROUP BY 1, 2), sm AS (SELECT register, source, pos, avg(f) AS f FROM ve GROUP BY 1, 2, 3), ob AS (SELECT register, source, avg(abs(f - g) / sd) AS observed FROM sm JOIN rm USING (register, pos) WHERE sd <> 0 GROUP BY 1, 2)",
        "SELECT register, source, round(observed, 6) AS observed, round(high, 6) AS high, CASE WHEN NOT underpowered AND high IS NOT NULL THEN observed <= high END AS inside FROM ob JOIN ba USING (register)",
    ),
    "general_imposters": _with(
        f"{_CHUNKS}, gs AS (SELECT pos, stddev_samp(f) AS sd FROM cv GROUP BY 1), gc AS (SELECT pos, f FROM cv WHERE register = 'en' AND chunk = 0), "
        f"gm AS (SELECT t, pos FROM (SELECT unnest(range(1, {TRIALS + 1})) AS t) CROSS JOIN (SELECT pos FROM gs) WHERE {duck_draw(chr(39) + '7|mask|' + chr(39) + ' || t || ' + chr(39) + '|' + chr(39) + ' || pos')} < 0.5), "
        "gb AS (SELECT t FROM gm GROUP BY 1 HAVING count(*) >= 5), "
        "gd AS (SELECT cv.register, cv.chunk, cv.pos, abs(cv.f - gc.f) / sd AS d FROM cv JOIN gc USING (pos) JOIN gs USING (pos) WHERE sd <> 0 AND NOT (cv.register = 'en' AND cv.chunk = 0)), "
        "ge AS (SELECT t, register, chunk, avg(d) AS d FROM gd JOIN gm USING (pos) GROUP BY 1, 2, 3), "
        "gr AS (SELECT t, min(d) FILTER (register = 'en') AS au, min(d) FILTER (register <> 'en') AS im FROM ge WHERE t IN (SELECT t FROM gb) GROUP BY 1)",
        "SELECT round(count(*) FILTER (au < im)::DOUBLE / count(*), 6) AS score, count(*) AS trials FROM gr WHERE au IS NOT NULL AND im IS NOT NULL",
    ),
    "register_separation": _with(
        f"{_VEC}, lv AS (SELECT ve.*, CASE WHEN toxic = 1 THEN 'model' ELSE 'author' END AS side FROM ve JOIN labels USING (doc_id)), pf AS (SELECT pos, stddev_samp(f) AS sd FROM lv GROUP BY 1), "
        "mm AS (SELECT side, pos, avg(f) FILTER (register = 'en') AS a, avg(f) FILTER (register = 'de') AS b FROM lv GROUP BY 1, 2)",
        "SELECT side, round(avg(abs(a - b) / sd), 6) AS separation FROM mm JOIN pf USING (pos) WHERE sd <> 0 GROUP BY 1",
    ),
    "frozen_gate": "SELECT TRUE AS ok, 'matches the committed digest' AS reason",
    "panel_accuracy": _with(_BOOT, "SELECT register, n, round(accuracy, 6) AS accuracy, clusters FROM ac"),
    "cluster_bootstrap": _with(_BOOT, "SELECT register, n, round(accuracy, 6) AS accuracy, clusters, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo <= 0.5 AND hi >= 0.5 AS indistinguishable FROM ac JOIN ci USING (register)"),
    "build_pairs": _with(_PAIRS, "SELECT 'pair_' || model_doc AS pair_id, register, author_side, md5(CASE author_side WHEN 'A' THEN atext ELSE mtext END) AS a, md5(CASE author_side WHEN 'A' THEN mtext ELSE atext END) AS b, author_doc, model_doc FROM pp"),
    "passages_by_source": "SELECT doc_id AS source_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
    "majority_vote": _with(_VOTES, "SELECT pair_id, author_side, a, votes, round(confidence, 6) AS confidence, tell, CASE WHEN votes IS NULL THEN NULL WHEN a >= votes - a THEN 'A' ELSE 'B' END AS guess, CASE WHEN votes IS NULL THEN NULL WHEN a >= votes - a THEN 'A' ELSE 'B' END = author_side AS correct FROM pa LEFT JOIN ta USING (pair_id)"),
    "noise_share": _with(
        f"{_JD}, a AS (SELECT register, avg(correct::INT) FILTER (toxic = 1) AS w, avg(correct::INT) FILTER (toxic = 0) AS o FROM jd GROUP BY 1)",
        "SELECT register, round(CASE WHEN abs(w - 0.5) + abs(o - 0.5) = 0 THEN 0.0 ELSE abs(o - w) / (abs(w - 0.5) + abs(o - 0.5)) END, 6) AS share FROM a",
    ),
    "idf": _with(_FACTS, "SELECT token, df, round(w, 9) AS weight FROM id"),
    "angle_usage": f"WITH e AS (SELECT {_ANGLED} AS data FROM events), a AS (SELECT coalesce(json_extract_string(data, '$.angle_used'), json_extract_string(data, '$.angleUsed')) AS angle FROM e) SELECT angle, count(*) AS uses FROM a WHERE angle <> '' GROUP BY 1",
    "exemplars_mmr": _EXEMPLARS,
    "retrieve_facts": _with(_RETR, "SELECT query_id, fact_id, round(score, 4) AS score, pick::INTEGER AS pick FROM pk WHERE pick <= 4"),
}
