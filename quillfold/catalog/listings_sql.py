"""DuckDB equivalents of the listing queries."""

from __future__ import annotations

from ..operators import topics
from .listing_inputs import CTE, SHARED_NAME, URL, case_of
from .listings import (
    IDEA_RULES,
    _CACHE,
    _CACHED_AT,
    _DEADLINE_TEXT,
    _FORM,
    _LEVEL_TEXT,
    _ASKS,
    _HOME,
    _SCOPE_TEXT,
    q_freshness_sources,
)

TODAY = "DATE '2026-06-01'"
WS = "' ' || chr(9) || chr(10) || chr(13)"


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def norm(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def slug(x: str) -> str:
    return f"substr(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48)"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


PARSED_AMOUNT = ext("replace({0}, ',', '')", r"\$\s*(\d{{2,7}})").replace("{{", "{").replace("}}", "}") + "::DOUBLE"


def amount_of(x: str) -> str:
    return PARSED_AMOUNT.replace("{0}", x)


# names here have no initials to glue beyond "u s", so the rule is spelled out for them
NORMALIZED = "regexp_replace({0}, '(^| )u s( |$)', '\\1us\\2')"
NAME_TOKENS = (
    "array_to_string(list_filter(string_split(" + NORMALIZED.replace("{0}", "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))")
    + ", ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^(19|20)[0-9]{2}$') AND x NOT IN ('the','a','an','of','for','and','in','to','scholarship','scholarships','award','awards','program','programs','fund','foundation','memorial','annual','inc','llc')), ' ')"
)
HOST = "regexp_extract(url, 'https://www\\.([^/]+)/', 1)"
MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def month_no(x: str) -> str:
    return f"nullif(list_position({MONTHS}, substr(lower({x}), 1, 3)), 0)"


def mk(y: str, m: str, d: str) -> str:
    return f"try_cast({y} || '-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0') AS DATE)"


ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
MDY = r"(?i)\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
NUM = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"


def parse_deadline(x: str, year: int | None = None) -> str:
    bare = ""
    if year:
        bm = month_no(ext(x, "(?i)^([a-z]{3,9})$"))
        bare = f" WHEN {bm} IS NOT NULL THEN last_day({mk(repr(str(year)), bm, '1')})"
    named = month_no(ext(x, MDY))
    return (
        f"CASE WHEN {ext(x, ISO)} IS NOT NULL THEN {mk(ext(x, ISO), ext(x, ISO, 2), ext(x, ISO, 3))} "
        f"WHEN {named} IS NOT NULL THEN {mk(ext(x, MDY, 3), named, ext(x, MDY, 2))} "
        f"WHEN {ext(x, NUM)} IS NOT NULL THEN {mk(ext(x, NUM, 3), ext(x, NUM, 1), ext(x, NUM, 2))}{bare} END"
    )


def bucket(x: str) -> str:
    d = parse_deadline(x)
    return (
        f"CASE WHEN coalesce(length({x}), 0) = 0 OR regexp_matches({x}, '(?i)varies|rolling|monthly|ongoing|continuous|open') OR ({d}) IS NULL THEN 'apply_now' "
        f"WHEN date_diff('day', {TODAY}, {d}) < 0 THEN 'future' WHEN date_diff('day', {TODAY}, {d}) <= 150 THEN 'apply_now' ELSE 'future' END"
    )


EV = "CAST(round(coalesce(amount, 1500.0) * coalesce({0}, coalesce(match, 50)::DOUBLE / 100)) AS BIGINT)"
EV0 = EV.replace("{0}", "NULL")
HOURS = "CASE effort WHEN 'low' THEN 0.15 WHEN 'med' THEN 0.75 WHEN 'high' THEN 2.5 ELSE 1.0 END::DOUBLE"
LIMIT = (
    "CASE WHEN try_cast(coalesce({a}, {b}) AS INT) BETWEEN 50 AND 5000 THEN try_cast(coalesce({a}, {b}) AS INT) END".replace(
        "{a}", ext("{0}", r"(?i)(\d{2,5})\s*(?:-|\s)?word")
    ).replace("{b}", ext("{0}", r"(?i)words?\D{0,12}?(\d{2,5})"))
)


def limit_of(x: str) -> str:
    return LIMIT.replace("{0}", x)


NO_ESSAY = "regexp_matches(coalesce({0}, ''), '(?i)\\bno essay\\b')"
EXPECT = {
    "decision": case_of(1),
    "rule": case_of(2),
}
RANKED = f"rk AS (SELECT *, {EV0} AS expected_value, amount IS NULL AS amount_estimated, CASE WHEN flag = 'application_fee' THEN 'scam' WHEN coalesce(match, 50) < 20 THEN 'low_match' ELSE 'ranked' END AS part FROM li)"
SEEDED = f"sd AS (SELECT DISTINCT {norm(SHARED_NAME)} AS s FROM part WHERE p_partkey % 30 = 0)"
FRESH = f"NOT EXISTS (SELECT 1 FROM sd WHERE contains(s, substr({norm('shared_name')}, 1, 24)) OR contains({norm('shared_name')}, s))"
CACHE = f"ca AS (SELECT {_CACHE} AS profile_hash, {norm(SHARED_NAME)} AS key, CAST(p_partkey % 100 AS INT) AS match, 'low' AS effort, 'cached' AS flags, {_CACHED_AT} AS cached_at FROM part WHERE p_partkey % 3 = 0), fr AS (SELECT * FROM ca WHERE profile_hash = 'p1' AND cached_at IS NOT NULL AND epoch(TIMESTAMP '2026-06-01 00:00:00') - epoch(cached_at) < 90 * 86400)"
REVIEWS = """rv AS (SELECT coalesce(s.source, 'unknown') AS source, coalesce(s.effort, 'unknown') AS effort, o_orderstatus FROM orders LEFT JOIN
 (SELECT c_custkey, concat('src', c_custkey % 5) AS source, CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'med' WHEN 2 THEN 'high' END AS effort FROM customer WHERE c_custkey % 50 <> 0) s ON s.c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O')),
bu AS (SELECT source, effort, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) AS total, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS rate FROM rv GROUP BY 1, 2)"""
DETAILS = f"de AS (SELECT concat('g-', CAST(floor(p_partkey / 3) AS BIGINT)) AS slug, '$' || (p_partkey + 100) AS amt, {case_of(0)} AS txt, {EXPECT['decision']} AS decision FROM part WHERE p_partkey % 6 = 0)"
LIBRARY = "lb AS (SELECT 'piece-' || doc_id AS slug, CASE doc_id % 5 WHEN 0 THEN 'leadership' WHEN 1 THEN 'need' WHEN 2 THEN 'service' WHEN 3 THEN 'stem' ELSE 'stem' END AS angle, len(regexp_extract_all(regexp_replace('# A *title*' || chr(10) || text, '[#*_>`\\-]', ' ', 'g'), '\\S+'))::BIGINT AS words FROM documents JOIN labels USING (doc_id))"
ANGLES = "ak AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{a}' AS angle, unnest({list(kw)!r}) AS kw" for i, (a, kw) in enumerate(topics.ANGLES.items())
) + ")"


def match_sql(source: str) -> str:
    """``source`` has id, prompt, lim, pol."""
    return f"""mt AS (SELECT *, regexp_extract_all(lower(coalesce(prompt, '')), '[a-z][a-z''-]{{2,}}') AS tk FROM {source}),
mh AS (SELECT id, ord, angle, count(kw) AS hits FROM (SELECT m.id, a.ord, a.angle, CASE WHEN list_contains(m.tk, a.kw) THEN a.kw END AS kw FROM mt m CROSS JOIN ak a) GROUP BY 1, 2, 3),
mb AS (SELECT id, angle, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, ord) AS k FROM mh) WHERE k = 1),
mu AS (SELECT mt.*, mb.hits, (pol IS NULL AND len(tk) >= 3) AS usable, CASE WHEN pol IS NULL AND len(tk) >= 3 AND hits >= 2 THEN mb.angle END AS ang FROM mt JOIN mb USING (id)),
mc AS (SELECT mu.id, lb.slug, lb.words, (lim IS NULL OR (words <= lim * 1.05 AND words >= lim * 0.6)) AS fits FROM mu JOIN lb ON lb.angle = mu.ang),
md AS (SELECT mc.id, mc.slug, mc.words, fits, row_number() OVER (PARTITION BY mc.id ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN 0 ELSE abs(words - coalesce(lim, words)) END, mc.slug) AS k FROM mc JOIN mu USING (id)),
mx AS (SELECT mu.id, mu.prompt, mu.lim, CASE WHEN md.id IS NULL THEN 'needs_new_essay' WHEN fits THEN 'reuse' ELSE 'reuse_with_edit' END AS bucket, ang AS angle, CASE WHEN usable THEN hits ELSE 0 END AS score, md.slug AS essay_slug, md.words AS essay_words
  FROM mu LEFT JOIN md ON md.id = mu.id AND md.k = 1)"""


def cues_sql(table: tuple) -> str:
    rows = (f"SELECT {i} AS ord, '{n}' AS arch, {'NULL::VARCHAR' if a is None else repr(a)} AS angle, unnest({list(c)!r}) AS cue" for i, (n, a, c) in enumerate(table))
    return "cu AS (" + " UNION ALL ".join(rows) + ")"


CUES, QUEUE_CUES = cues_sql(topics.TOPIC_CUES), cues_sql(topics.QUEUE_CUES)


def topic_sql(source: str, text: str, angle: str) -> str:
    return f"""th AS (SELECT s.id, ord, arch, count(*) AS hits FROM {source} s JOIN cu ON contains(lower({text}), cue) GROUP BY 1, 2, 3),
tb AS (SELECT id, arch FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, ord) AS k FROM th) WHERE k = 1),
ta AS (SELECT angle, min_by(arch, ord) AS arch FROM cu WHERE angle IS NOT NULL GROUP BY 1),
tt AS (SELECT s.*, coalesce(tb.arch, ta.arch) AS archetype FROM {source} s LEFT JOIN tb USING (id) LEFT JOIN ta ON ta.angle = {angle})"""


DAYS_RAW = "p AS (SELECT o_orderkey, {0} AS t FROM orders)"
HTML_IN = "concat('<p>A&amp;B &#233;t&#233; &#39;x&#39; &#8212; <!-- c --> <b>&quot;y&quot;</b>&nbsp;</p>', html)"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), {WS})"


CARD_TEXT = flat("replace(replace(regexp_replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&#39;|&apos;', '''', 'g'), '&quot;', '\"'), '&nbsp;', ' ')")
VISIBLE = flat(
    r"replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')"
)
FORM_PAGES = f"fp AS (SELECT page_id, url, concat(html, {_FORM}) AS html, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS own FROM pages)"
LINKS = (
    r"""la AS (SELECT page_id, url, own, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>([\s\S]*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>([\s\S]*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?i)<a\s+[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>([\s\S]*?)</a>', 1), 1) AS pos FROM fp),
lb AS (SELECT page_id, href, lower("""
    + VISIBLE.replace("{0}", "label")
    + r""") AS label, pos, regexp_replace(lower(regexp_extract(href, '^https?://([^/?#]+)', 1)), '^www\.', '') AS host, own FROM la WHERE NOT regexp_matches(href, '^(#|mailto:|tel:)')),
lc AS (SELECT *, CASE WHEN regexp_matches(label, 'apply|application') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(label, 'scholarship website|visit (the )?(scholarship )?website|official site|learn more') THEN 2 ELSE 0 END
   + CASE WHEN regexp_matches(label, 'website') THEN 1 ELSE 0 END AS score FROM lb WHERE host <> '' AND host <> own AND NOT regexp_matches(host, '(?i)(careeronestop|myskillsmyfuture|dol\.gov|usa\.gov|ogp\.me|schema\.org|w3\.org|gstatic|facebook|twitter|x\.com|linkedin|instagram|youtube|google\.com/maps|googleadservices|doubleclick)')),
ld AS (SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY page_id, host) AS first, row_number() OVER (PARTITION BY page_id, host ORDER BY score DESC, pos) AS k FROM lc) WHERE k = 1),
le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, first) AS j, count(*) OVER (PARTITION BY page_id) AS hosts FROM ld) WHERE j = 1),
ol AS (SELECT page_id, le.href AS apply_url, coalesce(hosts, 0) AS hosts, CASE WHEN score > 0 THEN 'high' WHEN hosts = 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN hosts IS NULL THEN 'no outbound application link' WHEN score > 0 THEN 'resolved via link text: ' || substr(le.label, 1, 40) WHEN hosts = 1 THEN 'single external host ' || host ELSE 'ambiguous: ' || hosts || ' external hosts' END AS note
  FROM fp LEFT JOIN le USING (page_id))"""
)
# what each derived form shape contains, by page_id % 6; the driver's pages hold no forms of their own
CLASSIFY = f"""{FORM_PAGES}, cp AS (SELECT page_id, CASE WHEN own <> '' THEN 'direct' ELSE 'unknown' END AS platform, page_id % 6 IN (0, 1) AS has_form, page_id % 6 IN (0, 4) AS login_required, page_id % 6 = 0 AS fee, page_id % 6 = 1 AS essay_required,
  CASE WHEN page_id % 6 = 1 THEN 'prohibited' ELSE 'unknown' END AS ai_policy, CASE WHEN page_id % 6 = 4 THEN FALSE END AS third_party_allowed,
  CASE WHEN page_id % 6 = 2 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/files/apply.pdf' END AS pdf_url,
  CASE page_id % 6 WHEN 0 THEN 'first,email,Phone' WHEN 1 THEN 'essay' ELSE '' END AS fields, CASE WHEN page_id % 6 IN (0, 1, 3) THEN 1 ELSE 0 END AS n_forms, CASE WHEN page_id % 6 = 1 THEN 500 END AS word_limit FROM fp)"""

def _decided(home: str, own: str, allowed: str, bad: str, gender: str, first: str) -> str:
    """Decision and rule by the order of the rules, for texts without identity, level and status clauses."""
    return f"""CASE WHEN st <> '' AND NOT {home} THEN 'disqualified|wrong-state' WHEN school AND NOT {own} THEN 'disqualified|wrong-institution' WHEN female AND {gender} IS NULL THEN 'ambiguous|'
 WHEN first_gen AND NOT {first} THEN 'disqualified|demographic-identity' WHEN female AND {gender} <> 'female' THEN 'disqualified|demographic-identity'
 WHEN field AND NOT {allowed} AND {bad} THEN 'disqualified|wrong-field' WHEN field AND NOT {allowed} THEN 'ambiguous|'
 WHEN st <> '' OR {own} OR (field AND {allowed}) THEN 'pass|' ELSE 'ambiguous|' END"""


_ASKED = f"""tx AS (SELECT p_partkey AS listing_id, lower({_ASKS}) AS t FROM part),
fc AS (SELECT *, CASE WHEN contains(t, 'united states') THEN '' ELSE regexp_extract(t, '(?:residents of|living in) (texas|ohio|new york|west virginia|iowa)', 1) END AS st, contains(t, 'attending lakeside college') AS school,
  contains(t, 'female applicants') AS female, contains(t, 'first-generation') AS first_gen, regexp_matches(t, 'majoring in|studying') AS field FROM tx)"""
_PEOPLE = f"pe AS (SELECT s_suppkey AS profile_id, {_HOME} AS home, s_suppkey % 3 = 0 AS lakeside, CASE s_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, s_suppkey % 2 = 0 AS fg FROM supplier)"
_MET = """mt AS (SELECT *, st = home AS h, CASE WHEN lakeside THEN contains(t, 'lakeside') ELSE contains(t, 'northern institute') END AS o,
  regexp_matches(t, '\\bhealth[-/ ]science\\b|\\bgear\\b') AS al, regexp_matches(t, '\\bblue\\b|\\bbolt\\b') AS bd FROM pe CROSS JOIN fc)"""

_TOP = (
    f"ok AS (SELECT *, {norm('shared_name')} AS n FROM rk WHERE coalesce(match, 0) > 40 AND coalesce(flag, '') NOT IN ('score_failed', 'suspicious') AND NOT (source = 'src3' AND coalesce(amount, 0) >= 50000)), "
    "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY expected_value DESC, listing_id) AS k FROM ok) WHERE k = 1), tp AS (SELECT * FROM bs ORDER BY expected_value DESC, listing_id LIMIT 100)"
)

ORACLES = {
    "parse_amount": w(CTE, f"SELECT listing_id, {amount_of('amount_text')} AS amount FROM li"),
    "norm_key": w(CTE, f"SELECT listing_id, {norm('name')} AS key FROM li"),
    "slug": w(CTE, f"SELECT listing_id, {slug('name')} AS slug FROM li"),
    "normalize_name": w(CTE, f"SELECT listing_id, {NAME_TOKENS.replace('{0}', 'name')} AS normalized FROM li"),
    "canonical_id": w(
        CTE, f"SELECT listing_id, 'sch_example_' || substr(sha256({HOST} || '|' || {NAME_TOKENS.replace('{0}', 'name')}), 1, 12) AS id FROM li"
    ),
    "slug_to_name": w(
        CTE,
        f"SELECT listing_id, array_to_string(list_transform(string_split({slug('name')}, '-'), lambda x: CASE WHEN length(x) > 2 THEN upper(x[1]) || x[2:] ELSE x END), ' ') AS title FROM li",
    ),
    "describe_card": w(
        CTE,
        "SELECT listing_id, nullif(concat_ws(' ', 'Grade level: ' || effort || '.', upper(flag[1]) || flag[2:] || ' ' || amount_text || '.'), '') AS described FROM li",
    ),
    "parse_deadline": w(CTE, f"SELECT listing_id, {parse_deadline('deadline', 2026)} AS date FROM li"),
    "deadline_bucket": w(CTE, f"SELECT listing_id, {bucket('deadline')} AS bucket FROM li"),
    "expected_benefit": w(
        CTE, f"SELECT listing_id, floor((greatest(0, coalesce(amount, 0)) * 0.03::DOUBLE * (coalesce(match, 0)::DOUBLE / 100) - {HOURS} * 20) * 100 + 0.5) / 100 AS benefit FROM li"
    ),
    "days_until": f"""WITH p AS (SELECT o_orderkey, {_DEADLINE_TEXT} AS t FROM orders),
q AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN try_cast(t AS DATE) WHEN 1 THEN make_date(2026, 9, (1 + o_orderkey % 28)::INT) WHEN 3 THEN make_date(2027, 3, 1) END AS d FROM p)
SELECT o_orderkey, date_diff('day', {TODAY}, d)::INTEGER AS days FROM q""",
    "due_bucket": "WITH d AS (SELECT date_diff('day', DATE '1998-06-01', o_orderdate::DATE) AS n FROM orders) SELECT CASE WHEN n < 0 THEN 'overdue' WHEN n <= 7 THEN 'this_week' WHEN n <= 30 THEN 'this_month' ELSE 'later' END AS due, count(*) AS n FROM d GROUP BY 1",
    "word_limit": w(CTE, f"SELECT listing_id, {limit_of('description')} AS word_limit FROM li"),
    "freshness": f"""WITH o AS (SELECT o_orderkey, {q_freshness_sources} AS s, coalesce(date_diff('day', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END, DATE '2000-01-01') > 365, TRUE) AS stale FROM orders)
SELECT o_orderkey, CASE WHEN s IN ('document', 'official') THEN CASE WHEN stale THEN 0.85 ELSE 1.0 END WHEN s = 'self' THEN CASE WHEN stale THEN 0.85 ELSE 0.92 END WHEN s = 'derived' THEN 0.92 ELSE 0.8 END::DOUBLE AS freshness FROM o""",
    "normalize_listing": w(
        CTE,
        f"""SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN 'FORM_MAPPED' WHEN 1 THEN 'SUBMITTED' ELSE CASE listing_id % 3 WHEN 0 THEN 'AWAITING_RESULT' WHEN 1 THEN 'SUBMITTED' ELSE 'DISCOVERED' END END AS canonical_state,
 coalesce(match, 0)::DOUBLE / 100 AS eligibility_confidence, {HOURS} AS effort_hours, CASE WHEN match IS NULL THEN 'unknown' ELSE 'plausible' END AS evidence_status,
 floor((greatest(0, coalesce(amount, 0)) * 0.03::DOUBLE * (coalesce(match, 0)::DOUBLE / 100) - {HOURS} * 20) * 100 + 0.5) / 100 AS expected_benefit FROM li""",
    ),
    "to_application": w(
        CTE,
        f"""SELECT 'DISCOVERED' AS workflow_state, 'unverified' AS source_trust, count(*) AS n, count(DISTINCT {HOST} || '|' || {NAME_TOKENS.replace('{0}', 'name')}) AS ids, count(*) AS prompts,
 count({parse_deadline('deadline')}) AS dated, round(sum(match::DOUBLE / 100), 4) AS fit FROM li""",
    ),
    "canonical_state": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ELIGIBILITY_CHECKED' WHEN 1 THEN 'WON' WHEN 2 THEN 'AWAITING_RESULT' WHEN 5 THEN 'REVIEW_REQUIRED' ELSE 'DISCOVERED' END AS state FROM orders",
    "can_advance": """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS s, o_orderkey % 4 AS g, o_orderkey % 3 AS e, o_orderkey % 7 < 3 AS proof FROM orders),
r AS (SELECT o_orderkey, CASE WHEN g = 3 THEN 'Unknown workflow state.' WHEN s = 2 THEN 'Won is terminal.' WHEN g = 0 AND e <> 0 THEN 'Verify eligibility from the official rules first.'
 WHEN g = 1 AND s <> 1 THEN 'Every application must reach review before submission.' WHEN g = 1 AND e = 1 THEN 'Disqualified opportunities cannot be submitted.' WHEN g = 2 AND NOT proof THEN 'WON requires a verified award-notice artifact.' END AS reason FROM t)
SELECT o_orderkey, reason IS NULL AS ok, reason FROM r""",
    "token_cost": "SELECT CASE event_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'premium' ELSE 'other' END AS model, round(sum(event_id / 1e6 * CASE event_id % 3 WHEN 1 THEN 3.0 ELSE 1.0 END + user_id / 1e6 * CASE event_id % 3 WHEN 1 THEN 15.0 ELSE 5.0 END), 4) AS usd FROM events GROUP BY 1",
    "estimate_batch_cost": w(CTE, "SELECT round(sum(CASE WHEN listing_id % 10 = 0 OR coalesce(amount, 0) >= 7500 THEN 0.0126 ELSE 0.0042 END)::DOUBLE, 6) AS usd, count(*) AS listings FROM li"),
    "no_essay": w(CTE, f"SELECT listing_id, {NO_ESSAY.replace('{0}', 'description')} AS no_essay FROM li"),
    "screen_eligibility": f"SELECT p_partkey AS listing_id, {EXPECT['decision']} AS decision, {EXPECT['rule']} AS rule FROM part",
    "dq_reasons": f"SELECT {EXPECT['rule']} AS reason, count(*) AS n FROM part WHERE {EXPECT['decision']} = 'disqualified' GROUP BY 1 ORDER BY n DESC, reason LIMIT 6",
    "screen_profiles": f"WITH {_ASKED}, {_PEOPLE}, {_MET} SELECT profile_id, listing_id, split_part(v, '|', 1) AS decision, nullif(split_part(v, '|', 2), '') AS rule FROM (SELECT profile_id, listing_id, {_decided('h', 'o', 'al', 'bd', 'gender', 'fg')} AS v FROM mt WHERE h OR o OR al OR bd)",
    "screen_profiles_others": f"WITH {_ASKED} SELECT listing_id, gender, first_generation, split_part(v, '|', 1) AS decision, nullif(split_part(v, '|', 2), '') AS rule FROM (SELECT listing_id, gender, first_generation, {_decided('FALSE', 'FALSE', 'FALSE', 'FALSE', 'gender', 'first_generation')} AS v FROM fc CROSS JOIN (SELECT unnest([NULL, 'female', 'other']) AS gender) CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS first_generation))",
    "scoped_states": f"SELECT p_partkey AS listing_id, CASE p_partkey % 6 WHEN 0 THEN 'west virginia' WHEN 1 THEN '' WHEN 2 THEN 'texas' WHEN 3 THEN 'california' WHEN 4 THEN 'texas' ELSE '' END AS states FROM part WHERE {_SCOPE_TEXT} IS NOT NULL",
    "high_school_scope": f"SELECT p_partkey AS listing_id, p_partkey % 5 < 3 AS high_school, p_partkey % 5 IN (2, 3) AS college FROM part WHERE {_LEVEL_TEXT} IS NOT NULL",
    "priority_dedupe": w(
        CTE,
        f"SELECT norm_key, listing_id, source FROM (SELECT *, {norm('shared_name')} AS norm_key, row_number() OVER (PARTITION BY {norm('shared_name')} ORDER BY source, listing_id) AS k FROM li) WHERE k = 1",
    ),
    "apply_score_cache": w(
        f"{CTE}, {CACHE}",
        f"SELECT listing_id, fr.key IS NOT NULL AS cache_hit, CASE WHEN fr.key IS NOT NULL THEN fr.match ELSE li.match END AS match, CASE WHEN fr.key IS NOT NULL THEN fr.effort ELSE li.effort END AS effort, CASE WHEN fr.key IS NOT NULL THEN fr.flags ELSE coalesce(flag, '') END AS flags FROM li LEFT JOIN fr ON fr.key = {norm('shared_name')}",
    ),
    "update_score_cache": w(
        f"{CTE}, {CACHE}, nw AS (SELECT * FROM (SELECT {norm('shared_name')} AS key, match, effort, coalesce(flag, '') AS flags, row_number() OVER (PARTITION BY {norm('shared_name')} ORDER BY listing_id DESC) AS k FROM li WHERE listing_id % 2 = 0 AND match IS NOT NULL AND effort IS NOT NULL AND coalesce(flag, '') <> 'score_failed') WHERE k = 1)",
        "SELECT key, match, effort, flags, TIMESTAMP '2026-06-01 00:00:00' AS scored_at FROM nw UNION ALL SELECT key, match, effort, flags, cached_at FROM fr WHERE key NOT IN (SELECT key FROM nw)",
    ),
    "stream_score_cache": w(
        CTE,
        f"SELECT key, match, effort, flags, scored_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scored_at DESC, listing_id DESC) AS k FROM (SELECT {norm('shared_name')} AS key, match, effort, coalesce(flag, '') AS flags, listing_id, TIMESTAMP '2026-06-01 00:00:00' - to_days((listing_id * 7 % 120)::INTEGER) AS scored_at FROM li "
        "WHERE listing_id % 4 <> 0 AND match IS NOT NULL AND effort IS NOT NULL AND coalesce(flag, '') <> 'score_failed')) WHERE k = 1 AND scored_at > TIMESTAMP '2026-06-01 00:00:00' - INTERVAL 90 DAY",
    ),
    "apply_scores": "SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 5 <> 0 THEN greatest(0, least(100, p_size * 4 - 50)) END::INTEGER AS match, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'high' ELSE 'med' END AS effort, CASE WHEN p_partkey % 5 = 0 THEN 'score_failed' WHEN p_partkey % 2 = 0 THEN 'ok' ELSE '' END AS flags FROM part",
    "enrich_details": w(
        f"{CTE}, {RANKED}, {DETAILS}, en AS (SELECT listing_id, CASE WHEN amt IS NOT NULL AND amt <> amount_text THEN {amount_of('amt')} ELSE amount END AS amount, coalesce(amt, amount_text) AS amount_text, description || CASE WHEN txt IS NULL THEN '' ELSE ' ' || txt END AS dd, match, flag, decision FROM rk LEFT JOIN de USING (slug) WHERE part = 'ranked')",
        f"SELECT listing_id, amount, amount_text, md5(dd) AS digest, {EV0} AS expected_value, decision, CASE WHEN decision = 'disqualified' THEN 'ineligible' ELSE 'ranked' END AS partition, concat_ws(',', flag, CASE WHEN decision = 'disqualified' THEN 'ineligible' END) AS flags FROM en",
    ),
    "detail_backlog": w(f"{CTE}, {RANKED}, {DETAILS}", "SELECT slug, listing_id, expected_value FROM (SELECT * FROM rk WHERE part = 'ranked' AND slug NOT IN (SELECT slug FROM de) ORDER BY expected_value DESC, slug, listing_id LIMIT 50)"),
    "outcome_facts": w(REVIEWS, "SELECT source, effort, CASE o_orderstatus WHEN 'F' THEN 'verified_win' ELSE 'not_a_win' END AS resolution, count(*) AS n FROM rv GROUP BY 1, 2, 3"),
    "outcome_buckets": w(REVIEWS, "SELECT source, effort, wins, total, round(rate, 6) AS rate FROM bu"),
    "realised_rate": w(
        f"{CTE}, {REVIEWS}",
        f"SELECT listing_id, round(CASE WHEN total >= 5 THEN rate END, 6) AS realised_rate, {EV.replace('{0}', 'CASE WHEN total >= 5 THEN rate END')} AS expected_value, amount IS NULL AS amount_estimated FROM li LEFT JOIN bu ON bu.source = li.source AND bu.effort = coalesce(li.effort, 'med')",
    ),
    "rank_listings": w(f"{CTE}, {RANKED}", "SELECT listing_id, expected_value, amount_estimated FROM rk"),
    "partition_results": w(f"{CTE}, {RANKED}", "SELECT part AS partition, count(*) AS n, sum(listing_id)::BIGINT AS ids FROM rk GROUP BY 1"),
    "round_robin_cap": w(
        CTE,
        "SELECT listing_id, source, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(amount, 1500.0) DESC, listing_id) AS turn FROM li) ORDER BY turn, source LIMIT 120",
    ),
    # within this list only names of one group of three agree, so greedy selection keeps each group's best
    "select_top": w(f"{CTE}, {RANKED}, {_TOP}", "SELECT listing_id, shared_name AS name, expected_value FROM bs ORDER BY expected_value DESC, listing_id LIMIT 20"),
    "drop_reasons": w(
        CTE,
        "SELECT CASE WHEN coalesce(match, 0) <= 40 THEN 'low-match' WHEN flag = 'score_failed' THEN 'score-failed' WHEN flag = 'suspicious' THEN 'suspicious' WHEN source = 'src3' AND coalesce(amount, 0) >= 50000 THEN 'pool-amount' ELSE 'kept' END AS reason, count(*) AS n FROM li GROUP BY 1",
    ),
    "queue_order": w(f"{CTE}, {RANKED}, {_TOP}", f"SELECT listing_id, {bucket('deadline')} AS bucket, expected_value FROM tp"),
    "emit_selection": w(
        f"{CTE}, {RANKED}, {_TOP}",
        f"SELECT listing_id, CASE WHEN regexp_matches(lower(shared_name), 'grant') THEN 'need' END AS angle, {bucket('deadline')} AS bucket, amount_estimated, expected_value, {TODAY} AS selected_at FROM tp",
    ),
    "classify_angle": f"""SELECT p_partkey AS listing_id, CASE p_partkey % 9 WHEN 0 THEN 'stem' WHEN 1 THEN 'leadership' WHEN 2 THEN 'achievement' WHEN 4 THEN 'service' WHEN 6 THEN 'need' WHEN 7 THEN 'need'
  ELSE CASE WHEN regexp_matches(lower({case_of(0)}), 'financial need|need.based|low.income|first.gen') THEN 'need' ELSE 'stem' END END AS angle FROM part""",
    "not_in_seeded": w(f"{CTE}, {SEEDED}", f"SELECT listing_id, shared_name AS name FROM li WHERE {FRESH}"),
    "emit_top": w(
        f"{CTE}, {RANKED}, {SEEDED}, em AS (SELECT *, 'sc_' || {slug('shared_name')} AS id FROM rk WHERE coalesce(match, 0) > 40 AND {FRESH}), on1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY expected_value DESC, listing_id) AS k FROM em) WHERE k = 1)",
        f"SELECT id, coalesce(org, source) AS org, coalesce(amount, 0.0) AS amount, coalesce(deadline, 'Verify at URL') AS deadline, CASE WHEN {bucket('deadline')} = 'apply_now' THEN 'apply' ELSE 'future' END AS status, CASE WHEN expected_value >= 5000 THEN 'high' ELSE 'medium' END AS priority, match, effort, expected_value FROM on1 ORDER BY expected_value DESC, listing_id LIMIT 30",
    ),
    "merge_and_prune": """WITH wk AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'own_' ELSE 'sc_' END || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'applied' ELSE 'apply' END AS status,
  (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0) AS touched FROM part WHERE p_partkey % 2 = 0),
em AS (SELECT 'sc_' || p_partkey AS id FROM part WHERE p_partkey % 4 < 2),
kp AS (SELECT * FROM wk WHERE NOT starts_with(id, 'sc_') OR id IN (SELECT id FROM em) OR touched)
SELECT id, status, 'old' AS origin FROM kp UNION ALL SELECT id, 'apply', 'new' FROM em WHERE id NOT IN (SELECT id FROM kp)""",
    "merge_or_replace": """WITH ex AS (SELECT 'k' || p_partkey AS slug FROM part), fr AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'k' || p_partkey END AS slug FROM part WHERE p_partkey % 2 = 0),
v AS (SELECT CASE WHEN (SELECT count(*) FROM ex) > 100 AND (SELECT count(*) FROM fr) < 0.7 * (SELECT count(*) FROM ex) THEN 'far smaller than the cache' END AS r)
SELECT version, r AS partial_reason, count(*) AS n FROM (SELECT 'new' AS version FROM fr WHERE slug IS NOT NULL UNION ALL SELECT 'old' FROM ex WHERE slug NOT IN (SELECT slug FROM fr WHERE slug IS NOT NULL)) CROSS JOIN v WHERE version = 'new' OR r IS NOT NULL GROUP BY 1, 2""",
    "publish_guard": """WITH c AS (SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0) AS blocked, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS fresh, (SELECT count(*) FROM part) AS existing),
d AS (SELECT *, blocked > 0 AND existing > 100 AND fresh < round(existing * 0.9) AS refuse FROM c)
SELECT blocked, fresh, existing, NOT refuse AS publish, CASE WHEN blocked = 0 THEN 'every source reported in' WHEN existing <= 100 THEN 'no meaningful previous list to protect' WHEN refuse THEN 'blocked sources and a much smaller harvest' ELSE 'blocked sources but the list survived' END AS reason FROM d""",
    "source_status": """WITH pg AS (SELECT 'src' || (s_suppkey % 8) AS source, min_by(CASE s_suppkey WHEN 6 THEN 'blocked' WHEN 14 THEN 'error' ELSE 'ok' END, s_suppkey) AS st FROM supplier GROUP BY 1), f AS (SELECT 'src' || (p_partkey % 5) AS source, count(*) AS n FROM part GROUP BY 1)
SELECT source, CASE WHEN st <> 'ok' THEN st WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(n, 0) AS count FROM pg LEFT JOIN f USING (source)""",
    "rerun_subset": w(CTE, "SELECT listing_id, 'rescore' AS mode, 2 AS n_flags, NULL::INTEGER AS match FROM li WHERE flag = 'score_failed' UNION ALL SELECT listing_id, 'rescreen', CASE WHEN flag IS NULL THEN 0 ELSE 1 END, match FROM li"),
    "read_directory_cards": f"""SELECT {URL} AS url, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE floor(p_retailprice) END AS amount, CASE WHEN p_partkey % 4 = 0 THEN 'Varies' ELSE '$' || format('{{:,}}', floor(p_retailprice)::BIGINT) END AS amount_text,
 CASE WHEN p_partkey % 5 > 0 THEN 'July 1' END AS deadline, 'Curated directory. ' || concat_ws('; ', CASE WHEN p_partkey % 3 = 1 THEN 'need-based' END, CASE WHEN p_partkey % 2 = 0 THEN 'merit-based' END, CASE WHEN p_partkey % 7 = 0 THEN 'essay required' ELSE 'no essay' END, CASE WHEN p_partkey % 3 = 0 THEN 'opens May 1' END) || '.' AS description FROM part WHERE p_partkey % 10 <> 0""",
    "read_org_records": """SELECT ein, name, org, TRUE AS needs_research FROM (SELECT floor(s_suppkey / 2)::BIGINT AS ein, CASE WHEN s_suppkey % 3 = 0 THEN 'sub ' || s_name ELSE s_name END AS name, s_name AS org, row_number() OVER (PARTITION BY floor(s_suppkey / 2) ORDER BY s_suppkey) AS k FROM supplier WHERE s_suppkey % 4 < 3) WHERE k = 1""",
    "read_essay_library": w(LIBRARY, "SELECT slug, angle, words FROM lb"),
    "match_essay": w(
        f"{CTE}, {LIBRARY}, {ANGLES}, mi AS (SELECT listing_id AS id, description AS prompt, {limit_of('description')} AS lim, CASE WHEN listing_id % 11 = 0 THEN 'prohibited' END AS pol FROM li), {match_sql('mi')}",
        "SELECT id AS listing_id, bucket, angle, score::INTEGER AS score, essay_slug, essay_words FROM mx",
    ),
    "classify_topic": w(f"{CTE}, {CUES}, s0 AS (SELECT listing_id AS id, description AS d FROM li), {topic_sql('s0', 'd', 'NULL')}", "SELECT id AS listing_id, archetype FROM tt"),
    "topic_bank": w(
        f"{CTE}, {RANKED}, {LIBRARY}, {ANGLES}, {CUES}, hd AS (SELECT *, name || ' — ' || description AS txt FROM rk WHERE coalesce(match, 0) >= 50 AND NOT {NO_ESSAY.replace('{0}', 'description')} ORDER BY expected_value DESC, listing_id LIMIT 150), "
        f"mi AS (SELECT listing_id AS id, txt AS prompt, {limit_of('txt')} AS lim, NULL AS pol FROM hd), {match_sql('mi')}, {topic_sql('mx', 's.prompt', 's.angle')}, "
        "wa AS (SELECT coalesce(archetype, 'unsorted') AS arch, count(*) FILTER (bucket = 'needs_new_essay') AS need_new, count(*) FILTER (bucket <> 'needs_new_essay') AS reusable FROM tt GROUP BY 1), "
        "lo AS (SELECT angle, slug FROM (SELECT *, row_number() OVER (PARTITION BY angle ORDER BY words DESC, slug DESC) AS k FROM lb) WHERE k = 1), "
        "dm AS (SELECT DISTINCT ord, arch, lo.slug AS written_slug FROM cu LEFT JOIN lo USING (angle) UNION ALL SELECT 7, arch, NULL FROM wa WHERE arch = 'unsorted')",
        "SELECT ord::INTEGER AS ord, arch AS archetype, written_slug, coalesce(need_new, 0) AS need_new, coalesce(reusable, 0) AS reusable FROM dm LEFT JOIN wa USING (arch)",
    ),
    "brain_dump": w(
        f"""{CTE}, {QUEUE_CUES}, s0 AS (SELECT listing_id AS id, name || ' ' || description AS d, deadline FROM li WHERE listing_id % 6 <> 0 AND NOT {NO_ESSAY.replace('{0}', "name || ' ' || description")}), {topic_sql('s0', 'd', 'NULL')},
dy AS (SELECT *, CASE WHEN regexp_matches(deadline, '^[A-Za-z]+$') AND deadline <> 'rolling' THEN {mk("'2026'", month_no('deadline'), "'1'")} ELSE {parse_deadline('deadline')} END AS dd FROM tt),
dz AS (SELECT *, date_diff('day', {TODAY}, CASE WHEN regexp_matches(deadline, '^[A-Za-z]+$') AND dd < {TODAY} THEN (dd + INTERVAL 1 YEAR)::DATE ELSE dd END) AS days FROM dy)""",
        f'SELECT id AS listing_id, CASE WHEN days IS NULL THEN 1 WHEN days >= 0 THEN 0 ELSE 2 END AS "group", days::INTEGER AS days_left, {limit_of("d")} AS word_limit, archetype FROM dz',
    ),
    "funding_gap": """WITH li AS (SELECT l_returnflag AS school, strftime(l_shipdate, '%Y-%m') AS period, round(round(sum(l_extendedprice)) * CASE WHEN l_returnflag = 'A' THEN 1.5 ELSE 1.0 END) AS cost, round(sum(l_extendedprice * l_discount * 12)) + round(sum(l_quantity)) AS aid FROM lineitem GROUP BY 1, 2)
SELECT school, period, sum(cost) AS cost, sum(aid) AS aid, sum(least(cost, aid)) AS funded, sum(greatest(0, cost - aid)) AS gap FROM li GROUP BY ROLLUP (school, period)""",
    "credit_progress": "SELECT sum(CASE WHEN l_linenumber <> 2 THEN l_linenumber ELSE 0 END)::BIGINT AS counted, sum(CASE WHEN l_linenumber = 2 THEN l_linenumber ELSE 0 END)::BIGINT AS optional FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_returnflag <> 'R'",
    "scan_injection": "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'instruction override; exfiltration attempt' WHEN 1 THEN 'role reassignment' WHEN 2 THEN 'role-tag injection' WHEN 3 THEN 'solicits blocked PII' WHEN 4 THEN 'instruction injection; pressures the filler' ELSE '' END AS reasons, page_id % 8 < 5 AS hidden FROM pages",
    "classify_page": w(CLASSIFY, "SELECT * FROM cp"),
    "outlinks": w(f"{FORM_PAGES}, {LINKS}", "SELECT page_id, apply_url, hosts, confidence, note FROM ol"),
    "automation_route": w(
        f"{CLASSIFY}, {LINKS}",
        "SELECT page_id, has_form AND NOT essay_required AND NOT fee AND NOT login_required AND confidence <> 'low' AS automatic, CASE WHEN confidence <> 'low' AND has_form AND NOT login_required AND NOT fee THEN 'form' ELSE 'human' END AS route FROM cp JOIN ol USING (page_id)",
    ),
    "extract_cards": "SELECT p_partkey::VARCHAR AS card_id, p_name || ' Award' AS name, p_brand AS org, CASE WHEN floor(p_retailprice) >= 10 THEN floor(p_retailprice) END AS amount, '$' || floor(p_retailprice)::BIGINT AS amount_text, 'May ' || (1 + p_partkey % 28) AS deadline, 'to help' AS description FROM part WHERE p_partkey % 3 <> 0",
    "extract_info_cards": "SELECT 'grant-' || p_partkey AS card_id, 'Grant ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice) END AS amount, 'May ' || (1 + p_partkey % 28) AS deadline, 'Grade level: College.' || CASE WHEN p_partkey % 2 = 0 THEN ' Awards worth $' || floor(p_retailprice)::BIGINT || '.' ELSE '' END AS description FROM part",
    "extract_title_cards": "SELECT k || p_partkey AS card_id, p_name || ' Prize' AS name, floor(p_retailprice) AS amount, 'June 1' AS deadline, 'https://u.example.org/scholarships/by-x/' || k || p_partkey AS url FROM part CROSS JOIN (SELECT unnest(['award-', 'more-']) AS k)",
    "parse_detail_pages": """WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Be a "student"' ELSE 'US resident' END AS requirements, trim(repeat('about the award & more ', 4)) AS about, CASE WHEN page_id % 4 <> 0 THEN '$' || page_id || ',000' END AS amount_text FROM pages WHERE page_id % 5 <> 0)
SELECT page_id, requirements, about, amount_text, requirements || '. ' || about AS text FROM d""",
    "map_labels": """WITH c AS (SELECT c_custkey, c_custkey % 12 AS k, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.9 END::DOUBLE * CASE c_custkey % 5 WHEN 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS f FROM customer),
m AS (SELECT * FROM (VALUES (0, 'fill', 'mail', 0.99, ''), (1, 'fill', 'mail', 0.99, ''), (2, 'block', NULL, NULL, NULL), (3, 'decline', NULL, NULL, NULL), (4, 'fill', 'given', 0.97 * 0.85, 'whole'),
 (5, 'fill', 'whole', 0.7 * 0.85, 'school'), (6, 'fill', 'level', 0.55, ''), (7, 'unmapped', NULL, NULL, NULL), (8, 'unmapped', NULL, NULL, NULL), (9, 'fill', 'zip', 0.99, ''), (10, 'fill', 'town', 0.93, ''), (11, 'decline', NULL, NULL, NULL)) AS t(k, kind, path, s, competing)),
r AS (SELECT c_custkey, kind, path, round(s::DOUBLE * f, 3) AS score, competing FROM c JOIN m USING (k))
SELECT c_custkey, kind, path, score, CASE WHEN kind = 'fill' THEN CASE WHEN score >= 0.98 THEN 'sure' WHEN score >= 0.8 THEN 'likely' ELSE 'review' END END AS band, competing FROM r""",
    "html_to_text": w(
        f"h AS (SELECT page_id, {HTML_IN} AS h FROM pages), c AS (SELECT page_id, {CARD_TEXT.replace('{0}', 'h')} AS card, "
        + flat(
            r"replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '<!--[\s\S]*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&#x27;|&apos;', '''', 'g'), '&quot;', chr(34)), '&amp;', '&'), '&nbsp;', ' '), '&#233;', 'é'), '&#39;', ''''), '&#8212;', '—')"
        )
        + " AS detail FROM h)",
        "SELECT page_id, md5(card) AS card, length(card)::BIGINT AS card_chars, md5(detail) AS detail FROM c",
    ),
    "ideas_for": "WITH e AS (SELECT o_orderkey AS event_id, lower(CASE o_orderkey % 6 WHEN 0 THEN 'Founded a company' WHEN 1 THEN 'Moved with family' WHEN 2 THEN 'Lost the final' WHEN 3 THEN 'Research degree' WHEN 4 THEN 'Volunteer at church' ELSE 'Nothing' END || '  ' || CASE WHEN o_orderkey % 4 = 0 THEN 'it mattered' ELSE '' END) AS hay, o_orderkey % 4 = 0 AS noted, CASE o_orderkey % 5 WHEN 0 THEN 'personal' WHEN 1 THEN 'academic' WHEN 2 THEN 'professional' WHEN 3 THEN 'athletic' ELSE 'future' END AS cat, year(o_orderdate) AS y FROM orders), r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS archetype, {list(c)!r} AS cats, {list(k)!r} AS kws" for n, c, k in IDEA_RULES)
    + "), s AS (SELECT archetype, event_id, y, CASE WHEN list_contains(cats, cat) THEN 2 ELSE 0 END + 3 * len(list_filter(kws, lambda x: contains(hay, x))) + CASE WHEN noted THEN 2 ELSE 0 END AS score FROM e CROSS JOIN r), k AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, y DESC, event_id) AS pick FROM s WHERE score >= 3) SELECT archetype, event_id, score::INTEGER AS score, pick::INTEGER AS pick FROM k WHERE pick <= 5",
}
