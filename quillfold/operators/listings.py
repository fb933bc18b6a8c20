"""Listings: readers, dedupe, scores, caps, ranking, publishing and the working list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import (
    FALLBACK_AMOUNT,
    deadline_bucket,
    effort_hours,
    expected_benefit,
    expected_value,
    norm_key,
    parse_amount,
    slug,
)
from ..session import cut_lineage
from .containment import contained
from .eligibility import Profile, screen_eligibility
from .machine import canonical_state_of

# Fixed values
HARD_FLAGS = ("application_fee", "paid_service")
LOW_MATCH = 20
MIN_MATCH = 40
EMIT_MAX = 30
HIGH_PRIORITY_EV = 5000
CACHE_DAYS = 90
EFFORTS = ("low", "med", "high")
NOMINATION_GATED = r"(?i)goldwater|astronaut scholarship|truman scholarship|rhodes|marshall scholarship"
POOL_AMOUNT = 50_000
NAME_PREFIX = 24
NO_FLAGS = "array<string>"


def flags_of(c: str = "flags") -> Column:
    return F.coalesce(F.col(c), F.array().cast(NO_FLAGS))


# ---------------------------------------------------------------- readers


def read_directory_cards(cards: DataFrame, source: str = "directory") -> DataFrame:
    """Curated cards (name, url, amount, amount_varies, opens, closes, merit, need, essay) as listings."""
    ok = cards.filter((F.length("name") > 0) & (F.length("url") > 0))
    varies = F.coalesce("amount_varies", F.lit(False))
    facts = F.concat_ws(
        "; ",
        F.when(F.col("need"), "need-based"),
        F.when(F.col("merit"), "merit-based"),
        F.when(F.col("essay"), "essay required").otherwise("no essay"),
        F.when(F.length("opens") > 0, F.concat(F.lit("opens "), F.col("opens"))),
    )
    return ok.select(
        "name",
        F.lit(None).cast("string").alias("org"),
        F.when(~varies, F.col("amount")).alias("amount"),
        F.when(varies, "Varies").otherwise(F.concat(F.lit("$"), F.format_number("amount", 0))).alias("amount_text"),
        F.col("closes").alias("deadline"),
        "url",
        F.concat(F.lit("Curated directory. "), facts, F.lit(".")).alias("description"),
        F.lit(source).alias("source"),
    )


NTEE_PREFIX = "B82"


def read_org_records(organizations: DataFrame, source: str = "nonprofits") -> DataFrame:
    """Research leads from nonprofit records: scholarship code or none, first per EIN, never an amount."""
    kept = organizations.filter(F.col("ntee_code").isNull() | (F.col("ntee_code") == "") | F.col("ntee_code").startswith(NTEE_PREFIX))
    first = kept.withColumn("_rn", F.row_number().over(W.partitionBy("ein").orderBy("ord"))).filter("_rn = 1")
    filled = lambda c: F.when(F.length(c) > 0, F.col(c))
    return first.select(
        "ein",
        F.coalesce(filled("sub_name"), F.col("name")).alias("name"),
        F.col("name").alias("org"),
        F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("deadline"),
        filled("url").alias("url"),
        F.concat(F.lit("research lead, EIN "), F.col("ein").cast("string")).alias("description"),
        F.lit(source).alias("source"),
        F.lit(True).alias("needs_research"),
    )


def source_status(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Status per source: the first page's failure, else ok or empty by count."""
    failed = pages.groupBy("source").agg(F.min_by("status", "page").alias("first_status"))
    counts = found.groupBy("source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return failed.join(counts, "source", "left").select(
        "source",
        F.when(F.col("first_status") != "ok", F.col("first_status")).when(n > 0, "ok").otherwise("empty").alias("status"),
        n.alias("count"),
    )


# ---------------------------------------------------------------- identity and scores


def priority_dedupe(listings: DataFrame, name: str = "name", priority: str = "priority", order: str = "ord") -> DataFrame:
    """First listing per name key, by source priority and then input order."""
    keyed = listings.withColumn("norm_key", norm_key(F.col(name)))
    first = W.partitionBy("norm_key").orderBy(priority, order)
    # rank 1 is cut per task before the exchange, so one name shared by many rows stays cheap
    return keyed.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def profile_hash(profile_json: Column) -> Column:
    return F.substring(F.sha2(profile_json, 256), 1, 16)


def fresh_scores(cache: DataFrame, profile: str, now: Column, max_days: int = CACHE_DAYS) -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400
    return cache.filter((F.col("profile_hash") == profile) & F.col("at").isNotNull() & (age < max_days))


def apply_score_cache(listings: DataFrame, cache: DataFrame, profile: str, now: Column, max_days: int = CACHE_DAYS) -> DataFrame:
    """Fill match, effort and flags from fresh cache entries of the same profile; add ``cache_hit``."""
    usable = fresh_scores(cache, profile, now, max_days).select(
        F.col("key").alias("norm_key"), F.col("match").alias("_m"), F.col("effort").alias("_e"), F.col("flags").alias("_f"), F.lit(True).alias("_hit")
    )
    joined = listings.join(usable, "norm_key", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return (
        joined.withColumn("match", F.when(hit, F.col("_m")).otherwise(F.col("match")))
        .withColumn("effort", F.when(hit, F.col("_e")).otherwise(F.col("effort")))
        .withColumn("flags", F.when(hit, F.col("_f")).otherwise(F.col("flags")))
        .withColumn("cache_hit", hit)
        .drop("_m", "_e", "_f", "_hit")
    )


def is_cacheable(match: Column, effort: Column, flags: Column) -> Column:
    finite = match.isNotNull() & ~F.isnan(match.cast("double"))
    return finite & F.coalesce(effort.isin(*EFFORTS), F.lit(False)) & ~F.array_contains(flags, "score_failed")


def update_score_cache(cache: DataFrame, scored: DataFrame, profile: str, now: Column, max_days: int = CACHE_DAYS) -> DataFrame:
    """Fresh entries of the profile carried over, cacheable new scores on top, the rest gone."""
    new = (
        scored.withColumn("key", norm_key(F.col("name")))
        .filter((F.col("key") != "") & is_cacheable(F.col("match"), F.col("effort"), flags_of()))
        .withColumn("_rn", F.row_number().over(W.partitionBy("key").orderBy(F.desc("ord"))))
        .filter("_rn = 1")
        .select(F.lit(profile).alias("profile_hash"), "key", "match", "effort", flags_of().alias("flags"), now.alias("at"))
    )
    carried = fresh_scores(cache, profile, now, max_days).select("profile_hash", "key", "match", "effort", "flags", "at")
    return new.unionByName(carried.join(new.select("key"), "key", "left_anti"))


def apply_scores(listings: DataFrame, scores: DataFrame, key: str = "listing_id") -> DataFrame:
    """Scorer rows joined on: match clamped to 0..100, unknown effort med, missing rows flagged.

    A listing without a score keeps a NULL match; it is never given an invented one.
    """
    s = scores.select(key, F.col("match").alias("_m"), F.col("effort").alias("_e"), F.col("flags").alias("_f"), F.lit(True).alias("_hit"))
    got = F.coalesce("_hit", F.lit(False))
    match = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("_m", F.lit(0))))
    return (
        listings.drop("match", "effort", "flags")
        .join(s, key, "left")
        .withColumn("match", F.when(got, match))
        .withColumn("effort", F.when(got & F.col("_e").isin(*EFFORTS), F.col("_e")).otherwise("med"))
        .withColumn("flags", F.when(got, flags_of("_f")).otherwise(F.array(F.lit("score_failed"))))
        .drop("_m", "_e", "_f", "_hit")
    )


def enrich_details(ranked: DataFrame, details: DataFrame, key: str = "slug") -> DataFrame:
    """Detail pages joined on: their amount overrides, their text is appended and kept for a second screen."""
    d = details.select(key, F.col("amount_text").alias("_amount_text"), F.col("detail_text").alias("detail_text"))
    joined = ranked.join(d, key, "left")
    changed = F.col("_amount_text").isNotNull() & ~F.col("_amount_text").eqNullSafe(F.col("amount_text"))
    return (
        joined.withColumn("amount", F.when(changed, parse_amount(F.col("_amount_text"))).otherwise(F.col("amount")))
        .withColumn("amount_text", F.when(changed, F.col("_amount_text")).otherwise(F.col("amount_text")))
        .withColumn("description", F.concat_ws(" ", F.col("description"), F.when(F.length("detail_text") > 0, F.col("detail_text"))))
        .drop("_amount_text")
    )


def screen_details(enriched: DataFrame, profile: Profile, text: str = "detail_text") -> DataFrame:
    """The second screen, on what detail pages ask for: every row with ``partition`` (ranked or ineligible), ``decision`` and
    ``ineligible_reason``. A disqualified row is flagged and leaves the ranking; the others are valued anew, since a detail
    page may have changed the amount. Rows without a page stay as they are, undecided."""
    judged = screen_eligibility(rank_listings(enriched), profile, text)
    read = F.col(text).isNotNull()
    late = read & (F.col("decision") == "disqualified")
    return (
        judged.withColumn("flags", F.when(late, F.array_append(flags_of(), F.lit("ineligible"))).otherwise(flags_of()))
        .withColumn("ineligible_reason", F.when(late, F.col("reason")))
        .withColumn("partition", F.when(late, "ineligible").otherwise("ranked"))
        .withColumn("decision", F.when(read, F.col("decision")))
        .drop("rule", "reason")
    )


def detail_backlog(ranked: DataFrame, details: DataFrame, top: int, key: str = "slug") -> DataFrame:
    """The best ranked listings whose detail page is still to be fetched."""
    missing = ranked.filter(F.col(key).isNotNull()).join(details.select(key), key, "left_anti")
    return missing.orderBy(F.desc("expected_value"), key).limit(top)


# ---------------------------------------------------------------- caps, ranking, partitions


def round_robin_cap(listings: DataFrame, limit: int, key: str = "listing_id") -> DataFrame:
    """Fair budget: each source's best by amount, one source after the other, up to ``limit`` rows.

    Ranks beyond ``limit`` within a source can never be reached, so every task keeps at most that
    many rows per source before the exchange.
    """
    by_amount = W.partitionBy("source").orderBy(F.desc(F.coalesce("amount", F.lit(float(FALLBACK_AMOUNT)))), key)
    turns = listings.withColumn("turn", F.row_number().over(by_amount)).filter(F.col("turn") <= limit)
    return turns.orderBy("turn", "source").limit(limit)


def rank_listings(listings: DataFrame) -> DataFrame:
    """Add ``expected_value`` and ``amount_estimated``."""
    realised = F.col("realised_rate") if "realised_rate" in listings.columns else F.lit(None).cast("double")
    return listings.withColumn("expected_value", expected_value(F.col("amount"), F.col("match"), realised)).withColumn(
        "amount_estimated", F.col("amount").isNull()
    )


def partition_results(listings: DataFrame) -> DataFrame:
    """Add ``partition``: scam, low_match or ranked, in that priority."""
    scam = F.arrays_overlap(flags_of(), F.array(*[F.lit(f) for f in HARD_FLAGS]))
    low = F.coalesce("match", F.lit(50)) < LOW_MATCH
    return listings.withColumn("partition", F.when(scam, "scam").when(low, "low_match").otherwise("ranked"))


def drop_reason() -> Column:
    """Why a listing may not be selected, or NULL."""
    flags = flags_of()
    return (
        F.when(F.coalesce("match", F.lit(0)) <= MIN_MATCH, "low-match")
        .when(F.array_contains(flags, "score_failed"), "score-failed")
        .when(F.array_contains(flags, "suspicious"), "suspicious")
        .when(F.col("name").rlike(NOMINATION_GATED), "nomination-gated")
        .when(F.col("pool_source") & (F.coalesce("amount", F.lit(0.0)) >= POOL_AMOUNT), "pool-amount")
    )


def select_top(ranked: DataFrame, top: int, key: str = "listing_id", head: int | None = None) -> DataFrame:
    """Greedy top ``top`` by expected value, skipping near-duplicate names of earlier picks.

    Equal names are one class, of which only the best listing can be picked. The walk follows the ranking, so it looks at
    the best classes only: those from a value on that about ``head`` of them reach. If they yield fewer than ``top`` picks
    the value is lowered to four times as many, until the picks suffice or the list ends. Only the picks are numbered
    (``ev_rank``).
    """
    ok = ranked.withColumn("drop_reason", drop_reason()).filter("drop_reason IS NULL")
    named = ok.withColumn("norm_name", norm_key(F.col("name")))
    order = F.struct((-F.coalesce("expected_value", F.lit(float("-inf")))).alias("loss"), F.col(key).alias("id"))
    classes = cut_lineage(named.groupBy("norm_name").agg(F.min(order).alias("ord")))
    total, head = classes.count(), head or max(4 * top, 64)
    while True:
        part = classes
        if head < total:
            last = classes.select(F.expr(f"approx_percentile(ord.loss, {head / total}, 10000)")).first()[0]
            part = cut_lineage(classes.filter(F.col("ord.loss") <= last))
        picked = _greedy_names(part)
        chosen = cut_lineage(picked.orderBy("ord").limit(top))
        if chosen.count() >= top or head >= total:
            place = F.row_number().over(W.orderBy("ord"))  # of the picks, `top` rows
            return named.join(chosen.select(F.col("ord.id").alias(key), place.alias("ev_rank")), key)
        head *= 4


def _greedy_names(classes: DataFrame) -> DataFrame:
    """The classes (norm_name, ord) that no earlier kept class duplicates: neither name holds the other's first letters.

    A class meets others through the beginnings that its name holds, not pair by pair: the earliest class with such a
    beginning, and the earliest that holds its own, tell whether it is the first of all it could duplicate. Rounds keep the
    first ones and drop what they rule out.
    """
    begun = classes.withColumn("head", F.substring("norm_name", 1, NAME_PREFIX))
    held = contained(begun.select(F.col("norm_name").alias("hay")), begun.select(F.col("head").alias("needle")))
    holds = cut_lineage(held.select(F.col("hay").alias("norm_name"), F.col("needle").alias("q")))
    undecided, kept_all = cut_lineage(begun), None
    while not undecided.isEmpty():
        mine = holds.join(undecided, "norm_name")
        beginning = undecided.groupBy(F.col("head").alias("q")).agg(F.min("ord").alias("begins"))
        holding = mine.groupBy("q").agg(F.min("ord").alias("holder"))
        around = mine.join(beginning, "q", "left").groupBy("norm_name", "head", "ord").agg(F.min("begins").alias("begins"))
        around = around.join(holding.withColumnRenamed("q", "head"), "head")
        first = F.least(F.coalesce("begins", F.col("ord")), "holder") == F.col("ord")
        kept = cut_lineage(around.filter(first).select("norm_name", "ord", "head"))
        ruled = kept.select(F.col("head").alias("q")).distinct()
        lost = holds.join(ruled, "q", "left_semi").select("norm_name")
        kept_holds = holds.join(kept.select("norm_name"), "norm_name", "left_semi").select(F.col("q").alias("head")).distinct()
        left = undecided.join(lost.distinct(), "norm_name", "left_anti").join(kept_holds, "head", "left_anti")
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        undecided = cut_lineage(left.select("norm_name", "ord", "head"))
    return classes.limit(0) if kept_all is None else kept_all.select("norm_name", "ord")


def queue_order(selected: DataFrame, today: Column, key: str = "listing_id") -> DataFrame:
    """Apply-now listings before future ones, best first inside each."""
    bucketed = selected.withColumn("bucket", deadline_bucket(F.col("deadline"), today))
    return bucketed.orderBy(F.when(F.col("bucket") == "apply_now", 0).otherwise(1), F.desc("expected_value"), key)


# Name cues per angle, first match wins; the description only speaks for need.
ANGLE_CUES = (
    (r"cyber", "stem"),
    (r"leader|president|student government|civic", "leadership"),
    (r"athlet|sport|wrestl|martial|varsity|foot locker|scout", "achievement"),
    (r"service|volunteer|community|christian|faith|church|worship", "service"),
    (r"(?<![A-Za-z0-9_])need(?![A-Za-z0-9_])|need.based|low.income|pell|grant(?![A-Za-z0-9_])|tuition|opportunity|access|first.gen", "need"),
)
NEED_DESCRIBED = r"financial need|need.based|low.income|first.gen"


def classify_angle(name: Column, description: Column) -> Column:
    t = F.regexp_replace(F.lower(name), "community college", "cc")
    out = F.when(F.lower(F.coalesce(description, F.lit(""))).rlike(NEED_DESCRIBED), "need").otherwise("stem")
    for pattern, angle in reversed(ANGLE_CUES):
        out = F.when(t.rlike(pattern), angle).otherwise(out)
    return out


def emit_selection(selected: DataFrame, today: Column) -> DataFrame:
    return selected.select(
        "listing_id",
        "name",
        "org",
        "amount",
        F.coalesce("amount_estimated", F.col("amount").isNull()).alias("amount_estimated"),
        "deadline",
        "match",
        "effort",
        "expected_value",
        classify_angle(F.col("name"), F.col("description")).alias("angle"),
        deadline_bucket(F.col("deadline"), today).alias("bucket"),
        "source",
        today.alias("selected_at"),
    )


# ---------------------------------------------------------------- publishing and the working list


def not_in_seeded(listings: DataFrame, seeded: DataFrame, name: str = "name") -> DataFrame:
    """Drop listings whose name fuzzily equals a hand-made one (containment either way).

    Distinct names meet through pieces of a few letters (:func:`containment.contained`); the listings follow by name.
    """
    keyed = listings.withColumn("_n", norm_key(F.col(name)))
    names = keyed.select("_n").filter("_n IS NOT NULL").distinct().withColumn("_head", F.substring("_n", 1, NAME_PREFIX))
    made = seeded.select(norm_key(F.col("name")).alias("_s")).filter("_s <> ''").distinct()
    longer = contained(names.select(F.col("_n").alias("hay")), made.select(F.col("_s").alias("needle"))).select(F.col("hay").alias("_n"))
    heads = contained(made.select(F.col("_s").alias("hay")), names.select(F.col("_head").alias("needle"))).select(F.col("needle").alias("_head")).distinct()
    known = longer.union(names.join(heads, "_head").select("_n")).distinct()
    return keyed.join(known, "_n", "left_anti").drop("_n")


def emit_top(ranked: DataFrame, seeded: DataFrame, today: Column, top: int = EMIT_MAX, key: str = "listing_id") -> DataFrame:
    """The publishable head: good matches, not hand-made already, first per slug."""
    good = not_in_seeded(ranked.filter(F.coalesce("match", F.lit(0)) > MIN_MATCH), seeded)
    ident = good.withColumn("id", F.concat(F.lit("sc_"), slug(F.col("name"))))
    first = W.partitionBy("id").orderBy(F.desc("expected_value"), key)
    once = ident.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    return (
        once.orderBy(F.desc("expected_value"), key)
        .limit(top)
        .select(
            "id",
            "name",
            F.coalesce("org", "source").alias("org"),
            F.coalesce("amount", F.lit(0.0)).alias("amount"),
            F.coalesce("deadline", F.lit("Verify at URL")).alias("deadline"),
            F.when(deadline_bucket(F.col("deadline"), today) == "apply_now", "apply").otherwise("future").alias("status"),
            F.when(F.coalesce("expected_value", F.lit(0)) >= HIGH_PRIORITY_EV, "high").otherwise("medium").alias("priority"),
            "match",
            "effort",
            "expected_value",
        )
    )


def normalize_listing(df: DataFrame) -> DataFrame:
    """Working-list defaults: canonical state, clamped confidences, effort hours, expected benefit."""
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("eligibility_confidence", F.col("match") / 100, F.lit(0.0))))
    win = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("realistic_win_rate", F.lit(0.03))))
    evidence = F.coalesce(F.when(F.length("evidence_status") > 0, F.col("evidence_status")), F.when(F.col("match").isNotNull(), "plausible").otherwise("unknown"))
    return (
        df.withColumn("canonical_state", canonical_state_of(F.col("canonical_state"), F.col("workflow_state"), F.col("status")))
        .withColumn("eligibility_confidence", confidence)
        .withColumn("realistic_win_rate", win)
        .withColumn("effort_hours", F.coalesce("effort_hours", effort_hours(F.col("effort"))))
        .withColumn("evidence_status", evidence)
        .withColumn("source_trust", F.coalesce("source_trust", F.when(F.col("source") == "directory", "curated").otherwise("unverified")))
        .withColumn("expected_benefit", expected_benefit(F.col("amount"), F.col("realistic_win_rate"), F.col("eligibility_confidence"), F.col("effort_hours")))
    )


PLACEHOLDER_PROMPT = r"(?i)^\(detected essay field"


def to_application(raw: DataFrame) -> DataFrame:
    """Older shapes to one nested record with defaults; placeholder prompts are left out."""
    from ..functions.scalars import canonical_id, parse_deadline

    prompts = F.filter(
        F.coalesce("essay_prompts", F.array().cast("array<struct<prompt:string,word_limit:int>>")),
        lambda p: (F.length(p["prompt"]) > 0) & ~p["prompt"].rlike(PLACEHOLDER_PROMPT),
    )
    given = F.when(F.col("id").startswith("sch_"), F.col("id"))
    fit = F.when(F.col("match").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("match") / 100)))
    return raw.select(
        F.coalesce(given, canonical_id(F.col("name"), F.col("url"))).alias("id"),
        F.coalesce("slug", slug(F.col("name"))).alias("slug"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("url", F.lit("")).alias("url"),
        "amount",
        F.coalesce("deadline", F.lit("")).alias("deadline_text"),
        parse_deadline(F.col("deadline")).alias("deadline_iso"),
        F.struct(F.coalesce("decision", F.lit("unscreened")).alias("decision"), fit.alias("fit")).alias("eligibility"),
        F.struct(prompts.alias("essay_prompts"), F.coalesce("ai_policy", F.lit("unknown")).alias("ai_policy")).alias("requirements"),
        F.when(F.col("source") == "directory", "curated").otherwise("unverified").alias("source_trust"),
        F.coalesce("workflow_state", F.lit("DISCOVERED")).alias("workflow_state"),
        "source",
        "effort",
    )


def is_touched() -> Column:
    """Whether a working-list row carries somebody's work."""
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return (
        (filled("status") & ~F.col("status").isin("apply", "research", "future"))
        | (filled("workflow_state") & (F.col("workflow_state") != "discovered"))
        | (F.coalesce("awarded_amount", F.lit(0.0)) > 0)
        | (filled("notes") & ~F.col("notes").startswith("Imported ("))
        | F.coalesce("pinned", F.lit(False))
    )


def merge_and_prune(working: DataFrame, emitted: DataFrame, prefix: str = "sc_") -> DataFrame:
    """Re-merge an import: untouched imported rows no longer emitted go, new ids come, nothing is overwritten."""
    imported = F.col("id").startswith(prefix)
    now = emitted.select("id").distinct()
    current = working.join(now.withColumn("_now", F.lit(True)), "id", "left")
    touched = F.coalesce(is_touched(), F.lit(False))
    kept = current.filter(~imported | F.col("_now").isNotNull() | touched).drop("_now")
    fresh = emitted.join(kept.select("id"), "id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


# ---------------------------------------------------------------- re-runs over a stored result


def rescreen_input(stored: DataFrame) -> DataFrame:
    """All stored rows with old eligibility verdicts cleared."""
    return stored.withColumn("flags", F.array_remove(flags_of(), "ineligible")).withColumn("ineligible_reason", F.lit(None).cast("string"))


def rescore_input(stored: DataFrame) -> DataFrame:
    """Only rows whose scoring failed, with the match cleared."""
    return stored.filter(F.array_contains(flags_of(), "score_failed")).withColumn("match", F.lit(None).cast("int"))
