"""Corpus queries over ``documents``, ``benchmark`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.text import jaccard, ngram_set, words
from ..operators import contamination, dedup, leak, register, split, triage
from ..plans import corpus_build
from ..session import cut_lineage, read_table, spread
from ..sources import records
from .common import ALNUM, PASTED, documents, duck_draw, duck_grams, pasted

# ---------------------------------------------------------------- cleaning steps


def _step(fn, *, on=pasted):
    def run(spark, sf_dir):
        out = on(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("t"))
        return out.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))

    return run


def _step_sql(ctes: str, table: str) -> str:
    return f"WITH {ctes} SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM {table}"


def _line_filter(source: str, name: str, flag: str, run: int, other: str, first: str) -> str:
    """Gaps-and-islands over lines: long flagged runs collapse to ``first``; other lines via ``other``."""
    return f"""
{name}_l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
             FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM {source})),
{name}_f AS (SELECT *, {flag} AS f FROM {name}_l),
{name}_g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS g FROM {name}_f),
{name}_c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, f, g) AS c, min(i) OVER (PARTITION BY doc_id, f, g) AS lo FROM {name}_g),
{name}_k AS (SELECT doc_id, i, CASE WHEN f AND c >= {run} THEN {first} ELSE {other} END AS line FROM {name}_c),
{name} AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line IS NOT NULL), '') AS t FROM {name}_k GROUP BY doc_id)"""


_RAW = f"raw AS (SELECT doc_id, {PASTED} AS t FROM documents)"
_FENCE = (
    r"fence AS (SELECT doc_id, regexp_replace(regexp_replace(t, "
    r"'(?m)^[ \t]*```[^\n]*\n[\s\S]*?^[ \t]*```[^\n]*$|^[ \t]*~~~[^\n]*\n[\s\S]*?^[ \t]*~~~[^\n]*$', chr(10), 'g'), "
    r"'(?m)^[ \t]*(```|~~~)[^\n]*\n[\s\S]*', chr(10)) AS t FROM {0})"
)
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_OUTPUT_LINE = C.OUTPUT_LINE.replace("'", "''")


def _indent_sql(source):
    return _line_filter(
        source, "ind", r"regexp_matches(line, '^(\s{4,}|\t)\S')", 3, "line", "CASE WHEN i = lo THEN '' END"
    )


def _output_sql(source):
    t = _TRIM.format("line")
    out = f"regexp_matches(line, '{_OUTPUT_LINE}')"
    flag = (
        f"(NOT {out} AND length({t}) > 0 AND NOT regexp_matches({t}, '[.!?:][)\"'']?\\s*$') "
        f"AND NOT regexp_matches({t}, '^[-*>]\\s'))"
    )
    return _line_filter(source, "outp", flag, 4, f"CASE WHEN {out} THEN NULL ELSE line END", "NULL")


_URLS = (
    r"url AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\bhttps?://\S+', '[url]', 'g'), "
    r"'(^|\s)(~|\.{0,2})/[\w.\-/]{4,}', '\1[path]', 'g') AS t FROM SRC)"
)
_REFS = (
    r"ref AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|\s)@[\w.\-/]+[ \t]?', '\1', 'g'), "
    r"'\b[\w\-/]+\.(ts|tsx|js|jsx|py|json|md|sh|css|html):\d+(:\d+)?', '[ref]', 'g') AS t FROM SRC)"
)
_WS = (
    r"ws AS (SELECT doc_id, "
    + _TRIM.format(r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
    + " AS t FROM SRC)"
)
CLEAN_CTES = ",".join(
    [
        _RAW,
        _FENCE.replace("{0}", "raw"),
        _indent_sql("fence"),
        _output_sql("ind"),
        _URLS.replace("SRC", "outp"),
        _REFS.replace("SRC", "url"),
        _WS.replace("SRC", "ref"),
        r"""meas AS (SELECT r.doc_id, w.t AS clean,
   CASE WHEN length(r.t) > 0 THEN 1 - length(w.t)::DOUBLE / length(r.t) ELSE 1.0 END AS stripped_ratio,
   CASE WHEN length(w.t) > 0 THEN length(regexp_replace(w.t, '[^a-zA-Z''\s]+', '', 'g'))::DOUBLE / length(w.t) ELSE 0.0 END AS alpha_ratio,
   len(regexp_extract_all(w.t, '\S+'))::BIGINT AS word_count FROM raw r JOIN ws w USING (doc_id))""",
        """cleaned AS (SELECT *, CASE WHEN stripped_ratio > 0.5 THEN 'mostly-stripped' WHEN word_count < 8 THEN 'too-short'
   WHEN alpha_ratio < 0.7 THEN 'mostly-symbols' END AS rejected FROM meas)""",
    ]
)


def q_clean_text(spark, sf_dir):
    out = C.clean_text(pasted(spark, sf_dir))
    return out.select(
        "doc_id",
        F.md5("clean").alias("digest"),
        F.round("stripped_ratio", 6).alias("stripped_ratio"),
        F.round("alpha_ratio", 6).alias("alpha_ratio"),
        "word_count",
        "rejected",
    )


def q_normalize_doc(spark, sf_dir):
    out = documents(spark, sf_dir).select(
        "doc_id", C.normalize_doc(F.concat(F.regexp_replace("text", "\n", " \r\n\n\n"), F.lit("  \n"))).alias("t")
    )
    return out.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def q_normalize_passage(spark, sf_dir):
    dressed = F.concat(F.lit("# Title\n\n* **"), F.col("text"), F.lit("**"))
    out = documents(spark, sf_dir).select("doc_id", C.normalize_passage(dressed, 400).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def q_defang(spark, sf_dir):
    hostile = F.concat(F.lit("a​b----BEGIN UNTRUSTED "), F.col("html"), F.lit("﻿ ---end untrusted"))
    out = spread(read_table(spark, sf_dir, "pages"), "page_id").select("page_id", C.defang(hostile).alias("t"))
    return out.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def q_excerpt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.excerpt(F.col("text"), 40).alias("excerpt"))


def q_split_sections(spark, sf_dir):
    pages = documents(spark, sf_dir).withColumn("md", F.col("text"))
    md = F.concat(F.lit("# "), F.col("source"), F.lit("\nintro\n## Notes\n"), F.col("text"), F.lit("\n### Facts bank\nend\n# Close\nx\n## Tail\nz"))
    rules = spark.createDataFrame([(0, "facts bank", "facts"), (1, "notes", "notes")], "ord int, pattern string, field string")
    sections = records.split_sections(pages.select("doc_id", md.alias("text")), "doc_id")
    unclaimed = records.unclaimed_headings(sections, rules).select("doc_id", "section", F.lit(True).alias("unclaimed"))
    return sections.join(unclaimed, ["doc_id", "section"], "left").select(
        "doc_id",
        F.col("level").cast("int").alias("level"),
        "heading",
        F.length("body").cast("long").alias("body_chars"),
        F.coalesce("unclaimed", F.lit(False)).alias("unclaimed"),
    )


# ---------------------------------------------------------------- n-grams, contamination, similarity


def q_ngram_set(spark, sf_dir):
    grams = documents(spark, sf_dir).select("doc_id", ngram_set(F.col("text"), 5).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("shingles"), F.get("g", F.lit(0)).alias("first_shingle"))


def q_jaccard(spark, sf_dir):
    """Similarity of each conversation turn to the turn before it."""
    turns = spread(read_table(spark, sf_dir, "conversations"), "conv_id").select(
        "conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w")
    )
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("pw"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("pw")), 6).alias("similarity"))


def q_flag_contaminated(spark, sf_dir):
    found = contamination.contaminations(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("doc_id", "shared_ngram", "contamination_reason")


def _hits(table: str, column: str) -> str:
    return (
        duck_grams("dg", table, "doc_id", column, 8)
        + ", "
        + duck_grams("bg", "benchmark", "item_id", "text", 8)
        + ", hit AS (SELECT doc_id, min_by(g, pos) AS shared_ngram FROM dg WHERE g IN (SELECT g FROM bg) GROUP BY doc_id)"
    )


def q_near_duplicates(spark, sf_dir):
    return dedup.near_duplicates(documents(spark, sf_dir), "doc_id", "text", "doc_id", with_match=True).select(
        "doc_id", "is_duplicate"
    )


# The sequential rule needs recursion over rows in order; pairs come from a plain self-join.
_NEAR = duck_grams("nsg", "{0}", "doc_id", "clean", 5) + """, sx AS (SELECT DISTINCT doc_id, hash(g) AS g FROM nsg),
sh AS (SELECT doc_id, list(g) AS s FROM sx GROUP BY doc_id), sn AS (SELECT doc_id, count(*) AS n FROM sx GROUP BY 1),
ex AS (SELECT sx.doc_id, n, g FROM sx JOIN sn USING (doc_id)),
df AS (SELECT g, count(*) AS f FROM ex GROUP BY g HAVING count(*) > 1),
rk AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), g) AS r FROM ex LEFT JOIN df USING (g)),
pf AS (SELECT doc_id, g FROM rk WHERE r <= n - ((9 * n + 9) // 10) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pf a JOIN pf b ON a.g = b.g AND a.doc_id < b.doc_id),
pr AS (SELECT x, y FROM (SELECT x, y, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb
        FROM cand JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y) WHERE 10 * i >= 9 * (na + nb - i)),
walk AS (SELECT 0 AS step, []::BIGINT[] AS kept, []::BIGINT[] AS lost, (SELECT list(DISTINCT v ORDER BY v) FROM (SELECT x AS v FROM pr UNION SELECT y FROM pr)) AS todo
  UNION ALL
  SELECT step + 1,
    CASE WHEN dup THEN kept ELSE list_append(kept, cur) END, CASE WHEN dup THEN list_append(lost, cur) ELSE lost END, todo
  FROM (SELECT *, todo[step + 1] AS cur, EXISTS (SELECT 1 FROM pr WHERE y = todo[step + 1] AND list_contains(kept, x)) AS dup FROM walk WHERE step < len(todo))),
dropped AS (SELECT unnest(lost) AS doc_id FROM (SELECT lost FROM walk ORDER BY step DESC LIMIT 1))"""


def q_build(spark, sf_dir):
    docs = pasted(spark, sf_dir).select(
        "doc_id", "text", F.lit(False).alias("is_document"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_id")
    )
    return corpus_build.build(docs, read_table(spark, sf_dir, "benchmark"), key="doc_id")


def q_build_report(spark, sf_dir):
    return corpus_build.build_report(q_build(spark, sf_dir))


# ---------------------------------------------------------------- registers


def q_register_signals(spark, sf_dir):
    s = register.register_signals(pasted(spark, sf_dir))
    return s.select(
        "doc_id",
        "sig_words",
        "sig_sentences",
        F.round("sig_mean_sentence", 6).alias("sig_mean_sentence"),
        F.round("sig_lower_starts", 6).alias("sig_lower_starts"),
        F.round("sig_contraction_rate", 6).alias("sig_contraction_rate"),
        "sig_connectives",
        "sig_first_person_past",
        "sig_citation",
        "sig_max_paragraph",
        "sig_imperative",
        "sig_casual",
    )


_IMPER = register.IMPERATIVES
SIGNALS = r"""sg0 AS (SELECT doc_id, t, len(regexp_extract_all(t, '\S+'))::BIGINT AS w,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\n+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: TRIMX), lambda x: length(x) > 0) AS s,
  len(regexp_extract_all(t, '(?i)\b\w+''(t|s|re|ve|ll|d|m)\b')) AS con,
  (CONN)::BIGINT AS sig_connectives,
  len(regexp_extract_all(t, '(?i)\b(i|we)\s+(PAST)\b'))::BIGINT AS sig_first_person_past,
  regexp_matches(t, 'CITE') AS sig_citation,
  list_max(list_transform(string_split_regex(t, '\n{2,}'), lambda p: len(regexp_extract_all(p, '\S+'))))::BIGINT AS sig_max_paragraph,
  regexp_matches(t, '(?i)^\s*(IMPER)\b') AS sig_imperative,
  len(regexp_extract_all(t, '(?i)\b(CASUAL)\b'))::BIGINT AS sig_casual
  FROM SRC),
sg1 AS (SELECT *, len(s)::BIGINT AS sig_sentences, len(list_filter(s, lambda x: regexp_matches(x, '^[a-zA-Z]'))) AS al, len(list_filter(s, lambda x: regexp_matches(x, '^[a-z]'))) AS lo FROM sg0),
sg AS (SELECT *, w AS sig_words, CASE WHEN sig_sentences > 0 THEN w::DOUBLE / sig_sentences ELSE w::DOUBLE END AS ms,
  CASE WHEN al > 0 THEN lo::DOUBLE / al ELSE 0.0 END AS ls, CASE WHEN w > 0 THEN con::DOUBLE / w * 100 ELSE 0.0 END AS cr FROM sg1)""".replace(
    "TRIMX", _TRIM.format("x")
).replace("CONN", " + ".join(f"(CASE WHEN contains(lower(t), '{c}') THEN 1 ELSE 0 END)" for c in register.CONNECTIVES)).replace(
    "PAST", register.PAST_VERBS
).replace("CITE", register.CITATION).replace("IMPER", _IMPER).replace("CASUAL", register.CASUAL)


def _tag_sql(doc: str) -> str:
    return f"""sc AS (SELECT *, CASE WHEN al0 < 0.1 THEN 0.4 ELSE 0 END + CASE WHEN sig_max_paragraph > 80 THEN 0.3 ELSE 0 END
   + CASE WHEN sig_citation THEN 0.3 ELSE 0 END + CASE WHEN ms >= 15 THEN 0.2 ELSE 0 END AS formal
  FROM (SELECT *, ls AS al0, ({doc}) AS isdoc FROM sg)),
sr AS (SELECT doc_id, unnest([
  {{'r': 'directive', 'o': 0, 's': CASE WHEN isdoc THEN 0 ELSE CASE WHEN w < 20 THEN 0.5 ELSE 0 END + CASE WHEN w < 40 THEN 0.2 ELSE 0 END + CASE WHEN sig_imperative THEN 0.4 ELSE 0 END + CASE WHEN sig_sentences <= 2 THEN 0.2 ELSE 0 END END::DOUBLE}},
  {{'r': 'raw', 'o': 1, 's': (CASE WHEN w BETWEEN 20 AND 400 THEN 0.35 ELSE 0 END + CASE WHEN ls >= 0.6 THEN 0.4 ELSE 0 END + CASE WHEN cr > 1 THEN 0.2 ELSE 0 END + CASE WHEN sig_casual > 0 THEN 0.25 ELSE 0 END + CASE WHEN NOT sig_imperative AND w >= 20 THEN 0.1 ELSE 0 END)::DOUBLE}},
  {{'r': 'narrative', 'o': 2, 's': (CASE WHEN sig_first_person_past >= 2 THEN 0.5 ELSE 0 END + CASE WHEN sig_first_person_past >= 1 AND sig_connectives <= 1 THEN 0.25 ELSE 0 END + CASE WHEN ms >= 12 AND ls < 0.3 THEN 0.2 ELSE 0 END)::DOUBLE}},
  {{'r': 'academic', 'o': 3, 's': CASE WHEN isdoc THEN formal ELSE 0 END::DOUBLE}},
  {{'r': 'persuasive', 'o': 4, 's': CASE WHEN isdoc THEN formal + least(sig_connectives, 4) * 0.15 ELSE 0 END::DOUBLE}}]) AS e FROM sc),
so AS (SELECT doc_id, e.r AS r, round(e.s, 9) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY round(e.s, 9) DESC, e.o) AS k FROM sr),
tagged AS (SELECT a.doc_id, a.r AS register, round(a.s - b.s, 3) AS register_confidence FROM so a JOIN so b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2)"""


def q_tag_register(spark, sf_dir):
    docs = pasted(spark, sf_dir).withColumn("is_document", F.col("doc_id") % 2 == 0)
    t = register.tag_register(docs, F.col("is_document"))
    return t.select(
        "doc_id",
        "register",
        "register_confidence",
        register.needs_triage(F.col("is_document"), F.lit(None).cast("string"), F.col("register_confidence")).alias("needs_triage"),
    )


# ---------------------------------------------------------------- records, gates, splits


def _turns(spark, sf_dir):
    conv = spread(read_table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return conv.select(
        F.concat_ws("#", "conv_id", "turn").alias("source_id"),
        F.col("role").alias("type"),
        F.expr("CASE turn % 7 WHEN 4 THEN concat('<tool>', text) WHEN 6 THEN concat('  [Tool output] ', text) ELSE text END").alias("content"),
    )


_TURNS = """tn AS (SELECT concat_ws('#', conv_id, turn) AS source_id, role AS type,
  CASE turn % 7 WHEN 4 THEN concat('<tool>', text) WHEN 6 THEN concat('  [Tool output] ', text) ELSE text END AS content FROM conversations)"""
_NOT_NOISE = (
    "NOT (trim(content, ' ' || chr(9) || chr(10) || chr(13)) = '' OR regexp_matches(content, '^\\s*(<|/|!|\\[Request interrupted|\\[Tool )'))"
)


def _author_turns(spark, sf_dir):
    null = F.lit(None).cast("string")
    return _turns(spark, sf_dir).filter(
        records.is_author_turn(F.col("type"), F.lit(False), null, F.col("content")) & ~records.is_noise(F.col("content"))
    )


def q_read_turns(spark, sf_dir):
    kept = _author_turns(spark, sf_dir).select("source_id", F.col("content").alias("text"), F.lit(None).cast("timestamp").alias("timestamp"))
    return records.turn_records(kept).select("id", "source_id", "word_count", "verified_by")


def q_is_author_turn(spark, sf_dir):
    null = F.lit(None).cast("string")
    t = _turns(spark, sf_dir)
    return t.select("source_id", records.is_author_turn(F.col("type"), F.lit(False), null, F.col("content")).alias("author_turn"))


def q_is_noise(spark, sf_dir):
    return _turns(spark, sf_dir).select("source_id", records.is_noise(F.col("content")).alias("noise"))


AUTHORSHIP = "CASE doc_id % 4 WHEN 0 THEN 'author_wrote_it' WHEN 1 THEN 'unverified' WHEN 2 THEN 'unverified' ELSE 'llm_assisted' END"


def _manifest(spark, sf_dir):
    """Manifest over all documents; texts of one source are not on disk."""
    docs = documents(spark, sf_dir)
    manifest = docs.select(F.col("doc_id").alias("file_id"), F.expr(AUTHORSHIP).alias("authorship"))
    texts = docs.filter("source <> 'src1'").select(F.col("doc_id").alias("file_id"), "text")
    return manifest, texts


def q_read_documents(spark, sf_dir):
    manifest, texts = _manifest(spark, sf_dir)
    recs, missing = records.read_documents(manifest, texts)
    gone = missing.select(F.col("file_id").cast("string").alias("source_id"), F.lit("missing").alias("state"))
    found = recs.select(
        "source_id", F.coalesce("quarantine_reason", F.lit("verified")).alias("state"), "word_count", F.col("id").alias("record_id")
    )
    return found.unionByName(gone, allowMissingColumns=True)


def q_verified_gate(spark, sf_dir):
    recs, _ = records.read_documents(*_manifest(spark, sf_dir))
    recs = recs.withColumn("doc_key", F.col("source_id"))
    parts = split.incremental_split(recs.select("doc_key", F.lit("academic").alias("register")))
    return register.verified_gate(split.apply_split(recs, parts), "exemplar").select("source_id", "word_count", "split")


def q_union_sources(spark, sf_dir):
    recs, _ = records.read_documents(*_manifest(spark, sf_dir))
    turns = records.turn_records(
        _author_turns(spark, sf_dir).select("source_id", F.col("content").alias("text"), F.lit(None).cast("timestamp").alias("timestamp"))
    )
    both = records.union_sources(turns, recs.filter("verified_by IS NOT NULL"))
    return both.groupBy("source").agg(F.count("*").alias("records"), F.sum("word_count").alias("words"))


def q_triage_pending(spark, sf_dir):
    manifest, texts = _manifest(spark, sf_dir)
    recs, _ = records.read_documents(manifest, texts)
    return triage.triage_pending(manifest, recs.withColumn("source_id", F.col("source_id").cast("long")))


def _resolutions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("seq"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'author_wrote_it' WHEN 1 THEN 'llm_assisted' WHEN 2 THEN 'not_mine' ELSE 'unsure' END").alias("resolution"),
    )


def q_triage_apply(spark, sf_dir):
    manifest, _ = _manifest(spark, sf_dir)
    updated, events = triage.triage_apply(manifest, _resolutions(spark, sf_dir))
    return updated.join(events.select("file_id", F.col("type").alias("event")), "file_id", "left").select("file_id", "authorship", "event")


def _edits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("source_id"),
        F.col("lang").alias("register"),
        F.col("text").alias("before"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '  ' ELSE concat(text, ' again') END").alias("after"),
        F.lit("2026-01-01").alias("edited_at"),
    )


def _holdout(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("source_id"))


def q_append_edit(spark, sf_dir):
    return triage.route_edits(_edits(spark, sf_dir), _holdout(spark, sf_dir)).select(
        "source_id", "register", "held_out", words(F.col("before")).alias("before_words"), words(F.col("after")).alias("after_words")
    )


def q_ingest_edits(spark, sf_dir):
    return triage.ingest_edits(_edits(spark, sf_dir), _holdout(spark, sf_dir)).select("id", "register", "word_count", "split", "verified_by")


def _lang_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("lang").alias("register"))


def _two_step(spark, sf_dir):
    keys = _lang_keys(spark, sf_dir)
    labelled = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_key"))
    prior = split.incremental_split(keys.join(labelled, "doc_key", "left_semi"))
    return prior, split.incremental_split(keys, prior)


def q_incremental_split(spark, sf_dir):
    return _two_step(spark, sf_dir)[1]


def _split_sql(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT *, count(*) OVER (PARTITION BY register) AS n,
   row_number() OVER (PARTITION BY register ORDER BY {duck_draw("'20260910|split|' || doc_key")}, doc_key) AS rk FROM {source}),
{name}_h AS (SELECT *, greatest(CASE WHEN n >= 4 THEN 1 ELSE 0 END, CAST(floor(n * hr + 0.5) AS BIGINT)) AS nh, greatest(CASE WHEN n >= 4 THEN 1 ELSE 0 END, CAST(floor(n * 0.25 + 0.5) AS BIGINT)) AS ne
   FROM (SELECT *, CASE register WHEN 'academic' THEN 0.25 WHEN 'persuasive' THEN 0.25 WHEN 'narrative' THEN 0.2 ELSE 0.15 END AS hr FROM {name}_r)),
{name} AS (SELECT doc_key, CASE WHEN rk <= nh THEN 'holdout' WHEN rk <= nh + ne THEN 'exemplar' ELSE 'train' END AS split FROM {name}_h)"""


_TWO_STEP = (
    "k0 AS (SELECT doc_id::VARCHAR AS doc_key, lang AS register FROM documents), kp AS (SELECT * FROM k0 WHERE doc_key IN (SELECT doc_id::VARCHAR FROM labels)), "
    + _split_sql("prior", "kp")
    + ", kn AS (SELECT * FROM k0 WHERE doc_key NOT IN (SELECT doc_key FROM prior)), "
    + _split_sql("fresh", "kn")
    + ", now AS (SELECT * FROM prior UNION ALL SELECT * FROM fresh)"
)


def q_apply_split(spark, sf_dir):
    prior, _ = _two_step(spark, sf_dir)
    return split.apply_split(_lang_keys(spark, sf_dir), prior).select("doc_key", "split")


def q_split_counts(spark, sf_dir):
    return split.split_counts(_lang_keys(spark, sf_dir), _two_step(spark, sf_dir)[1])


def q_moved_documents(spark, sf_dir):
    """Documents a from-scratch split would have moved."""
    prior, _ = _two_step(spark, sf_dir)
    return split.moved_documents(prior, split.incremental_split(_lang_keys(spark, sf_dir)))


def q_frozen_digest(spark, sf_dir):
    return split.frozen_digest(_two_step(spark, sf_dir)[1], "doc_key", "split")


def q_leak_guard(spark, sf_dir):
    prior, now = _two_step(spark, sf_dir)
    scratch = split.incremental_split(_lang_keys(spark, sf_dir))
    return split.leak_guard(now.filter("split = 'holdout'"), scratch.filter("split = 'exemplar'")).select("doc_key")


def q_select_seeds(spark, sf_dir):
    tagged = register.tag_register(documents(spark, sf_dir), F.lit(True)).withColumn("word_count", F.col("sig_words")).withColumn("split", F.lit("holdout"))
    return register.select_seeds(tagged, "holdout").select("doc_id", "register", "word_count")


# ---------------------------------------------------------------- leak checks


def q_rare_words(spark, sf_dir):
    return leak.rare_words(documents(spark, sf_dir)).select("word", "n")


def _leak_pairs(spark, sf_dir):
    """Each document against a brief cut from its own opening words, in four shapes."""
    head = lambda n: F.array_join(F.slice(F.split(F.col("text"), " "), 1, n), " ")
    word3 = F.get(F.split(F.lower("text"), " "), F.lit(2))
    kind = F.col("doc_id") % 4
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"),
        F.col("text").alias("piece"),
        F.when(kind == 0, head(90)).when(kind == 1, head(5)).otherwise(F.lit("say what changed")).alias("assignment_prompt"),
        F.when(kind == 3, F.array_join(F.reverse(F.slice(F.split(F.col("text"), " "), 1, 6)), " ")).otherwise(F.lit("a view")).alias("thesis_abstract"),
        F.array(F.lit("open plainly")).alias("moves"),
        F.when(kind == 2, word3).otherwise(F.lit("x")).alias("anchor_label"),
    )


def q_assert_no_leak(spark, sf_dir):
    rare = leak.rare_words(documents(spark, sf_dir))
    return leak.assert_no_leak(_leak_pairs(spark, sf_dir), rare)


def q_write_stage(spark, sf_dir):
    """A stage written and read back."""
    from ..session import scratch_dir
    from ..sinks.publish import write_stage

    path = scratch_dir(spark, "stage-clean")
    write_stage(C.clean_text(pasted(spark, sf_dir)).filter("rejected IS NULL").select("doc_id", "word_count"), path)
    return spark.read.parquet(path)


QUERIES = {
    "strip_fenced_code": _step(C.strip_fenced_code),
    "strip_indented_blocks": _step(C.strip_indented_blocks),
    "strip_pasted_output": _step(C.strip_pasted_output),
    "mask_urls_paths": _step(C.mask_urls_paths),
    "mask_file_refs": _step(C.mask_file_refs),
    "collapse_ws": _step(C.collapse_ws),
    "clean_text": q_clean_text,
    "normalize_doc": q_normalize_doc,
    "normalize_passage": q_normalize_passage,
    "defang": q_defang,
    "excerpt": q_excerpt,
    "split_sections": q_split_sections,
    "ngram_set": q_ngram_set,
    "jaccard": q_jaccard,
    "flag_contaminated": q_flag_contaminated,
    "near_duplicates": q_near_duplicates,
    "build_report": q_build_report,
    "register_signals": q_register_signals,
    "tag_register": q_tag_register,
    "read_turns": q_read_turns,
    "is_author_turn": q_is_author_turn,
    "is_noise": q_is_noise,
    "read_documents": q_read_documents,
    "verified_gate": q_verified_gate,
    "union_sources": q_union_sources,
    "triage_pending": q_triage_pending,
    "triage_apply": q_triage_apply,
    "append_edit": q_append_edit,
    "ingest_edits": q_ingest_edits,
    "incremental_split": q_incremental_split,
    "apply_split": q_apply_split,
    "split_counts": q_split_counts,
    "moved_documents": q_moved_documents,
    "frozen_digest": q_frozen_digest,
    "leak_guard": q_leak_guard,
    "select_seeds": q_select_seeds,
    "rare_words": q_rare_words,
    "assert_no_leak": q_assert_no_leak,
    "write_stage": q_write_stage,
}

_W = "len(regexp_extract_all({0}, '\\S+'))::BIGINT"
_NORM = _TRIM.format(
    r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)
_FLAT = _TRIM.format(r"regexp_replace({0}, '\s+', ' ', 'g')")
_REC = (
    f"docs AS (SELECT doc_id, source, {AUTHORSHIP} AS authorship, "
    + _NORM.replace("{0}", "text")
    + " AS t FROM documents), rec AS (SELECT *, substr(sha256('document|' || doc_id || '|' || t), 1, 16) AS rid, "
    + _W.format("t")
    + " AS word_count FROM docs WHERE source <> 'src1')"
)
_DEDUP_TAIL = "SELECT d.doc_id, (x.doc_id IS NOT NULL) AS is_duplicate FROM documents d LEFT JOIN dropped x USING (doc_id)"

ORACLES = {
    "strip_fenced_code": _step_sql(_RAW + "," + _FENCE.replace("{0}", "raw"), "fence"),
    "strip_indented_blocks": _step_sql(_RAW + "," + _indent_sql("raw"), "ind"),
    "strip_pasted_output": _step_sql(_RAW + "," + _output_sql("raw"), "outp"),
    "mask_urls_paths": _step_sql(_RAW + "," + _URLS.replace("SRC", "raw"), "url"),
    "mask_file_refs": _step_sql(_RAW + "," + _REFS.replace("SRC", "raw"), "ref"),
    "collapse_ws": _step_sql(_RAW + "," + _WS.replace("SRC", "raw"), "ws"),
    "clean_text": f"WITH {CLEAN_CTES} SELECT doc_id, md5(clean) AS digest, round(stripped_ratio, 6) AS stripped_ratio, round(alpha_ratio, 6) AS alpha_ratio, word_count, rejected FROM cleaned",
    "normalize_doc": "WITH r AS (SELECT doc_id, "
    + _NORM.replace("{0}", "concat(regexp_replace(text, '\\n', ' ' || chr(13) || chr(10) || chr(10) || chr(10), 'g'), '  ' || chr(10))")
    + " AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM r",
    "normalize_passage": r"""WITH a AS (SELECT doc_id, """
    + _TRIM.format(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('# Title', chr(10), chr(10), '* **', text, '**'), '(?m)^#{1,6}\s+.*$', '', 'g'), '(?m)^\s*[-*]\s+', '', 'g'), '\*\*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
    )
    + r""" AS b FROM documents),
w AS (SELECT doc_id, b, regexp_extract_all(b, '\S+') AS ws FROM a), h AS (SELECT *, array_to_string(ws[1:400], ' ') AS hd FROM w),
s AS (SELECT *, length(regexp_extract(hd, '(?s)^.*[.!?]')) AS last FROM h),
r AS (SELECT doc_id, CASE WHEN len(ws) <= 400 THEN b WHEN last - 1 > length(hd) * 0.5 THEN substr(hd, 1, last) ELSE hd END AS t FROM s)
SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM r""",
    "defang": r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(concat('a', chr(8203), 'b----BEGIN UNTRUSTED ', html, chr(65279), ' ---end untrusted'),
 '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]', '', 'g'), '(?i)-{3,}(BEGIN|END) UNTRUSTED', '[fence removed]', 'g') AS t FROM pages)
SELECT page_id, length(t)::BIGINT AS n, md5(t) AS digest FROM r""",
    "excerpt": f"WITH r AS (SELECT doc_id, string_split({_FLAT.replace('{0}', 'text')}, ' ') AS w FROM documents) SELECT doc_id, array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN ' …' ELSE '' END AS excerpt FROM r",
    "ngram_set": "WITH "
    + duck_grams("gr", "documents", "doc_id", "text", 5)
    + ", s AS (SELECT doc_id, count(DISTINCT g) AS shingles, min_by(g, pos) AS first_shingle FROM gr GROUP BY 1) SELECT doc_id, coalesce(shingles, 0) AS shingles, first_shingle FROM documents LEFT JOIN s USING (doc_id)",
    "jaccard": """WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, CASE WHEN na + nb - i = 0 THEN 1.0::DOUBLE ELSE round(i::DOUBLE / (na + nb - i), 6) END AS similarity FROM p""",
    "flag_contaminated": f"WITH {_hits('documents', 'text')} SELECT doc_id, shared_ngram, 'shares an 8-gram with a protected text' AS contamination_reason FROM hit",
    "near_duplicates": f"WITH RECURSIVE cl AS (SELECT doc_id, text AS clean FROM documents), {_NEAR.replace('{0}', 'cl')} {_DEDUP_TAIL}",
    "build_report": f"WITH RECURSIVE {CLEAN_CTES}, ok AS (SELECT * FROM cleaned WHERE rejected IS NULL), {_hits('ok', 'clean')}, "
    + "cl AS (SELECT doc_id, clean FROM ok WHERE doc_id NOT IN (SELECT doc_id FROM hit)), tx AS (SELECT doc_id, clean AS t FROM cl), "
    + SIGNALS.replace("SRC", "tx")
    + ","
    + _tag_sql("FALSE")
    + f", {_NEAR.replace('{0}', 'cl')}, "
    + """outc AS (SELECT c.doc_id, c.word_count, CASE WHEN rejected IS NOT NULL THEN rejected WHEN h.doc_id IS NOT NULL THEN 'quarantined' WHEN x.doc_id IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS outcome, g.register
  FROM cleaned c LEFT JOIN hit h USING (doc_id) LEFT JOIN dropped x ON x.doc_id = c.doc_id LEFT JOIN tagged g ON g.doc_id = c.doc_id)
SELECT outcome, CASE WHEN outcome = 'kept' THEN register END AS register, count(*) AS records, sum(word_count)::BIGINT AS words FROM outc GROUP BY 1, 2""",
    "register_signals": f"WITH {_RAW}, {SIGNALS.replace('SRC', 'raw')} SELECT doc_id, sig_words, sig_sentences, round(ms, 6) AS sig_mean_sentence, round(ls, 6) AS sig_lower_starts, round(cr, 6) AS sig_contraction_rate, sig_connectives, sig_first_person_past, sig_citation, sig_max_paragraph, sig_imperative, sig_casual FROM sg",
    "tag_register": f"WITH {_RAW}, {SIGNALS.replace('SRC', 'raw')}, {_tag_sql('doc_id % 2 = 0')} SELECT doc_id, register, register_confidence, CASE WHEN doc_id % 2 = 0 THEN TRUE ELSE register_confidence < 0.2 END AS needs_triage FROM tagged",
    "read_turns": f"WITH {_TURNS} SELECT substr(sha256('transcript|' || source_id || '|' || content), 1, 16) AS id, source_id, {_W.format('content')} AS word_count, 'heuristic' AS verified_by FROM tn WHERE type = 'user' AND {_NOT_NOISE}",
    "is_author_turn": f"WITH {_TURNS} SELECT source_id, (type = 'user') AS author_turn FROM tn",
    "is_noise": f"WITH {_TURNS} SELECT source_id, NOT ({_NOT_NOISE}) AS noise FROM tn",
    "read_documents": f"WITH {_REC} SELECT doc_id::VARCHAR AS source_id, CASE WHEN authorship = 'author_wrote_it' THEN 'verified' ELSE 'unverified-academic' END AS state, word_count, rid AS record_id FROM rec UNION ALL SELECT doc_id::VARCHAR, 'missing', NULL, NULL FROM documents WHERE source = 'src1'",
    "verified_gate": f"WITH {_REC}, kk AS (SELECT doc_id::VARCHAR AS doc_key, 'academic' AS register FROM rec), {_split_sql('sp', 'kk')} SELECT doc_id::VARCHAR AS source_id, word_count, split FROM rec JOIN sp ON doc_key = doc_id::VARCHAR WHERE authorship = 'author_wrote_it' AND split = 'exemplar'",
    "union_sources": f"WITH {_REC}, {_TURNS} SELECT 'document' AS source, count(*) AS records, sum(word_count)::BIGINT AS words FROM rec WHERE authorship = 'author_wrote_it' UNION ALL SELECT 'transcript', count(*), sum({_W.format('content')})::BIGINT FROM tn WHERE type = 'user' AND {_NOT_NOISE}",
    "triage_pending": f"WITH {_REC}, p AS (SELECT d.doc_id AS file_id, r.word_count, string_split({_FLAT.replace('{0}', 'r.t')}, ' ') AS w, r.doc_id IS NOT NULL AS on_disk FROM docs d LEFT JOIN rec r USING (doc_id) WHERE d.authorship = 'unverified') SELECT file_id, coalesce(word_count, 0) AS word_count, coalesce(array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN ' …' ELSE '' END, '') AS excerpt, on_disk FROM p",
    "triage_apply": f"""WITH m AS (SELECT doc_id AS file_id, {AUTHORSHIP} AS authorship FROM documents),
r AS (SELECT user_id AS file_id, max_by(CASE event_id % 4 WHEN 0 THEN 'author_wrote_it' WHEN 1 THEN 'llm_assisted' WHEN 2 THEN 'not_mine' ELSE 'unsure' END, event_id) AS res FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT file_id, CASE WHEN authorship = 'unverified' AND res IS NOT NULL THEN res ELSE authorship END AS authorship,
 CASE WHEN authorship = 'unverified' AND res = 'author_wrote_it' THEN 'corpus_doc_verified' WHEN authorship = 'unverified' AND res IS NOT NULL THEN 'corpus_doc_rejected' END AS event FROM m LEFT JOIN r USING (file_id)""",
    "append_edit": f"SELECT doc_id AS source_id, lang AS register, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS held_out, {_W.format('text')} AS before_words, {_W.format('text')} + 1 AS after_words FROM documents WHERE doc_id % 5 > 1",
    "ingest_edits": f"SELECT substr(sha256('manual|edit:2026-01-01|' || text || ' again'), 1, 16) AS id, lang AS register, {_W.format('text')} + 1 AS word_count, 'train' AS split, 'author' AS verified_by FROM documents WHERE doc_id % 5 > 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "incremental_split": f"WITH {_TWO_STEP} SELECT doc_key, split FROM now",
    "apply_split": f"WITH {_TWO_STEP} SELECT k0.doc_key, prior.split FROM k0 LEFT JOIN prior USING (doc_key)",
    "split_counts": f"WITH {_TWO_STEP} SELECT register, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'exemplar') AS exemplar, count(*) FILTER (split = 'holdout') AS holdout FROM k0 JOIN now USING (doc_key) GROUP BY register",
    "moved_documents": f"WITH {_TWO_STEP}, {_split_sql('scratch', 'k0')} SELECT p.doc_key, p.split AS was, s.split AS now FROM prior p LEFT JOIN scratch s USING (doc_key) WHERE p.split IS DISTINCT FROM s.split",
    "frozen_digest": f"WITH {_TWO_STEP}, h AS (SELECT sha256(doc_key || chr(9) || split) AS d FROM now), b AS (SELECT ('0x' || substr(d, 1, 8))::BIGINT % 4096 AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM b",
    "leak_guard": f"WITH {_TWO_STEP}, {_split_sql('scratch', 'k0')} SELECT n.doc_key FROM now n JOIN scratch s USING (doc_key) WHERE n.split = 'holdout' AND s.split = 'exemplar'",
    "select_seeds": f"WITH tx AS (SELECT doc_id, text AS t FROM documents), {SIGNALS.replace('SRC', 'tx')}, {_tag_sql('TRUE')} SELECT t.doc_id, register, sig_words AS word_count FROM tagged t JOIN sg USING (doc_id) WHERE register IN ('narrative', 'academic', 'persuasive') AND sig_words >= 150",
    "rare_words": f"WITH w AS (SELECT unnest({ALNUM.format('text')}) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY word HAVING count(*) < 3",
    "write_stage": f"WITH {CLEAN_CTES} SELECT doc_id, word_count FROM cleaned WHERE rejected IS NULL",
    "split_sections": r"""WITH s AS (SELECT doc_id, unnest([{'h': 'Notes', 'l': 2, 'u': FALSE}, {'h': 'Facts bank', 'l': 3, 'u': FALSE}, {'h': 'Tail', 'l': 2, 'u': TRUE}]) AS e, """
    + _TRIM.format("text")
    + """ AS b FROM documents)
SELECT doc_id, e.l::INTEGER AS level, e.h AS heading, CASE e.h WHEN 'Notes' THEN length(b) WHEN 'Tail' THEN 1 ELSE 3 END::BIGINT AS body_chars, e.u AS unclaimed FROM s""",
}
