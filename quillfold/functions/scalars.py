"""Scalar functions over listing fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, ascii_edges, let, trim_all

# Fixed values
FALLBACK_AMOUNT = 1500
HOURLY_EFFORT = 20
EFFORT_HOURS = {"low": 0.15, "med": 0.75, "high": 2.5}
NAME_STOPWORDS = (
    "the", "a", "an", "of", "for", "and", "in", "to", "scholarship", "scholarships", "award", "awards", "program",
    "programs", "fund", "foundation", "memorial", "annual", "inc", "llc",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ROLLING = r"(?i)varies|rolling|monthly|ongoing|continuous|open"
APPLY_WINDOW_DAYS = 150


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, or NULL (Spark gives '' for both no match and an empty group)."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.length(found) > 0, found)


def parse_amount(text: Column) -> Column:
    return _extract(F.replace(text, F.lit(",")), r"\$\s*(\d{2,7})").cast("double")


def norm_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]", "")


def slug(name: Column, size: int = 48) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-|-\z", ""), 1, size)


def normalize_name(name: Column) -> Column:
    """Name without case, punctuation, years and boilerplate; initials are glued (U. S. -> us)."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[‘’“”]", "")
    plain = F.regexp_replace(plain, r"[^a-z0-9]+", " ")
    plain = F.regexp_replace(plain, NOT_AFTER_WORD + r"(19|20)\d{2}" + NOT_BEFORE_WORD, " ")
    tokens = F.filter(F.split(plain, " "), lambda w: F.length(w) > 0)

    def glue(acc: Column, w: Column) -> Column:
        prev = F.try_element_at(acc, F.lit(-1))
        joins = w.rlike(r"^[a-z]\z") & prev.rlike(r"^[a-z]{1,2}\z")
        return F.when(
            F.coalesce(joins, F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(prev, w))),
        ).otherwise(F.concat(acc, F.array(w)))

    glued = F.aggregate(tokens, F.array().cast("array<string>"), glue)
    return F.array_join(F.filter(glued, lambda w: ~w.isin(*NAME_STOPWORDS)), " ")


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``; '' when there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def canonical_id(name: Column, url: Column) -> Column:
    """Stable identity of a listing from its host and normalised name."""

    def build(pair: Column) -> Column:
        host, n = pair["h"], pair["n"]
        labels = F.split(host, r"\.")
        tag = F.coalesce(F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))), labels[0])
        tag = F.when(host == "", "nohost").otherwise(F.substring(F.regexp_replace(tag, "[^a-z0-9]", ""), 1, 16))
        digest = F.substring(F.sha2(F.concat_ws("|", host, n), 256), 1, 12)
        unknown = F.substring(F.sha2(F.coalesce(F.when(F.length(name) > 0, name), url, F.lit("")), 256), 1, 12)
        return F.when((host == "") & (n == ""), F.concat(F.lit("sch_unknown_"), unknown)).otherwise(
            F.concat(F.lit("sch_"), tag, F.lit("_"), digest)
        )

    return let(F.struct(host_of(url).alias("h"), normalize_name(name).alias("n")), build)


def slug_to_name(s: Column) -> Column:
    cap = lambda w: F.when(F.length(w) > 2, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    return F.array_join(F.transform(F.split(s, "-"), cap), " ")


def describe_card(grade: Column, key: Column, amount_text: Column) -> Column:
    """Short description of a card, or NULL when nothing is known."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    grade_part = F.concat(F.lit("Grade level: "), filled(grade), F.lit("."))
    title = F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, F.lit(2), F.length(key)))
    amount_part = F.concat(filled(title), F.lit(" "), filled(amount_text), F.lit("."))
    return filled(F.concat_ws(" ", grade_part, amount_part))


def _month(name: Column) -> Column:
    """1..12 from a month name's first three letters, else NULL."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(name), 1, 3))
    return F.when(at > 0, at)


def _date(y: Column, m: Column, d: Column) -> Column:
    """A DATE, or NULL for impossible days."""
    return F.try_to_date(
        F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")),
        "yyyy-MM-dd",
    )


def parse_deadline(text: Column, reference_year: int | None = None) -> Column:
    """ISO, then 'Mon D, YYYY', then M/D/YYYY, then a bare month (its last day). Never guesses."""
    t = trim_all(F.coalesce(text, F.lit("")))
    iso = ascii_edges(r"\b(\d{4})-(\d{2})-(\d{2})\b")
    mdy = ascii_edges(r"(?i)\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b")
    num = ascii_edges(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b")
    bare = _month(_extract(t, r"(?i)^([a-z]{3,9})\z"))
    part = lambda p, i: _extract(t, p, i)
    named = _month(part(mdy, 1))
    out = (
        F.when(part(iso, 1).isNotNull(), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(named.isNotNull(), _date(part(mdy, 3), named, part(mdy, 2)))
        .when(part(num, 1).isNotNull(), _date(part(num, 3), part(num, 1), part(num, 2)))
    )
    if reference_year is None:
        return out
    return out.when(bare.isNotNull(), F.last_day(_date(F.lit(str(reference_year)), bare, F.lit("1"))))


MONTH_RE = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def days_until(deadline: Column, today: Column) -> Column:
    """Days to a deadline that looks like a date; without a year it is the next occurrence."""
    raw = trim_all(F.coalesce(deadline, F.lit("")))
    pieces = F.size(F.split(raw, r"\s+"))
    has_month = raw.rlike(MONTH_RE)
    looks = raw.rlike(r"^\d{1,4}[-/]\d{1,2}([-/]\d{1,4})?\z") | (has_month & raw.rlike(r"\d") & (pieces <= 3)) | (has_month & (pieces == 1))
    year = _extract(raw, ascii_edges(r"\b((?:19|20)\d{2})\b"))
    y = F.coalesce(year, F.year(today).cast("string"))
    month = _month(_extract(raw, r"(?i)([a-z]{3,9})"))
    day = F.coalesce(_extract(raw, ascii_edges(r"\b(\d{1,2})(?:st|nd|rd|th)?\b")), F.lit("1"))
    d = F.coalesce(
        F.when(raw.rlike(r"^\d{4}-"), _date(_extract(raw, r"^(\d{4})-"), _extract(raw, r"^\d{4}-(\d{1,2})"), F.coalesce(_extract(raw, r"^\d{4}-\d{1,2}-(\d{1,2})"), F.lit("1")))),
        F.when(raw.rlike(r"^\d{1,2}[-/]"), _date(y, _extract(raw, r"^(\d{1,2})[-/]"), _extract(raw, r"^\d{1,2}[-/](\d{1,2})"))),
        F.when(month.isNotNull(), _date(y, month, day)),
    )
    rolled = F.when(year.isNull() & (d < today), F.add_months(d, 12)).otherwise(d)
    return F.when(looks, F.datediff(rolled, today))


def deadline_bucket(deadline: Column, today: Column) -> Column:
    d = parse_deadline(deadline)
    days = F.datediff(d, today)
    rolling = F.coalesce(deadline.rlike(ROLLING), F.lit(False))
    return (
        F.when(F.coalesce(F.length(deadline), F.lit(0)) == 0, "apply_now")
        .when(rolling | d.isNull(), "apply_now")
        .when(days < 0, "future")
        .when(days <= APPLY_WINDOW_DAYS, "apply_now")
        .otherwise("future")
    )


def word_limit(text: Column) -> Column:
    n = F.coalesce(_extract(text, r"(?i)(\d{2,5})\s*(?:-|\s)?word"), _extract(text, r"(?i)words?\D{0,12}?(\d{2,5})")).cast("int")
    return F.when(n.between(50, 5000), n)


def freshness(source: Column, last_verified: Column, now: Column) -> Column:
    stale = F.coalesce(F.datediff(now, last_verified) > 365, F.lit(True))
    return (
        F.when(source.isin("document", "official"), F.when(stale, 0.85).otherwise(1.0))
        .when(source == "self", F.when(stale, 0.85).otherwise(0.92))
        .when(source == "derived", 0.92)
        .otherwise(0.8)
    )


def expected_value(amount: Column, match: Column, realised: Column) -> Column:
    chance = F.coalesce(realised, F.coalesce(match, F.lit(50)) / 100)
    return F.round(F.coalesce(amount, F.lit(float(FALLBACK_AMOUNT))) * chance).cast("long")


def effort_hours(effort: Column) -> Column:
    out = F.lit(1.0)
    for name, hours in EFFORT_HOURS.items():
        out = F.when(effort == name, F.lit(hours)).otherwise(out)
    return out


def _clamp01(c: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(default))))


def expected_benefit(amount: Column, win_rate: Column, eligibility: Column, hours: Column) -> Column:
    award = F.greatest(F.lit(0.0), F.coalesce(amount, F.lit(0.0)))
    cost = F.greatest(F.lit(0.0), hours) * HOURLY_EFFORT
    value = award * _clamp01(win_rate, 0.0) * _clamp01(eligibility, 0.0) - cost
    return F.floor(value * 100 + 0.5) / 100


def no_essay(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)" + NOT_AFTER_WORD + "no essay" + NOT_BEFORE_WORD)
