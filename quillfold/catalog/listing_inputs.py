"""Listings derived from ``part``: one listing per part, in portable SQL for both engines."""

from __future__ import annotations

MONTHS = "CASE p_partkey % 12 WHEN 0 THEN 'January' WHEN 1 THEN 'Feb' WHEN 2 THEN 'March' WHEN 3 THEN 'apr' WHEN 4 THEN 'May' WHEN 5 THEN 'June' WHEN 6 THEN 'Jul' WHEN 7 THEN 'August' WHEN 8 THEN 'Sept' WHEN 9 THEN 'Oct' WHEN 10 THEN 'november' ELSE 'Dec' END"
GROUP = "CAST(floor(p_partkey / 3) AS BIGINT)"
NAME = f"concat(CASE p_partkey % 3 WHEN 0 THEN 'The U.S. Grant No. ' WHEN 1 THEN 'The us grant no ' ELSE 'THE U S GRANT-NO ' END, {GROUP}, ' ', p_name, ' Fund')"
# names that agree within each group of three
SHARED_NAME = f"concat(CASE p_partkey % 3 WHEN 0 THEN 'U.S. Grant No. ' WHEN 1 THEN 'us grant no ' ELSE 'U S GRANT-NO ' END, {GROUP}, ' Fund')"
SOURCE = "concat('src', p_partkey % 5)"
ORG = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END"
AMOUNT_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'Varies' WHEN 1 THEN concat('Up to $', CAST(floor(p_retailprice) AS BIGINT)) ELSE concat('$ ', CAST(p_partkey % 9 + 1 AS BIGINT), ',', lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING), 3, '0')) END"
AMOUNT = "CASE p_partkey % 4 WHEN 0 THEN NULL ELSE p_retailprice END"
YEAR = "CAST(2026 + p_partkey % 2 AS BIGINT)"
DAY = "CAST(1 + p_partkey % 31 AS BIGINT)"
MONTH_NO = "CAST(1 + p_partkey % 12 AS BIGINT)"
DEADLINE = f"""CASE CAST(floor(p_partkey / 12) AS BIGINT) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'rolling'
 WHEN 2 THEN concat({YEAR}, '-', lpad(CAST({MONTH_NO} AS STRING), 2, '0'), '-', lpad(CAST({DAY} AS STRING), 2, '0'))
 WHEN 3 THEN concat({MONTHS}, ' ', {DAY}, ', ', {YEAR}) WHEN 4 THEN concat({MONTH_NO}, '/', {DAY}, '/', {YEAR}) ELSE {MONTHS} END"""
MATCH = "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size * 2 AS INT) END"
EFFORT = "CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'SMALL' THEN 'med' WHEN 'STANDARD' THEN 'high' WHEN 'MEDIUM' THEN 'low' ELSE NULL END"
FLAG = "CASE p_partkey % 23 WHEN 0 THEN 'application_fee' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'score_failed' ELSE NULL END"
URL = "concat('https://www.', lower(replace(p_brand, '#', '')), '.example.org/scholarships/g-', CAST(floor(p_partkey / 3) AS BIGINT))"
SLUG = "concat('g-', CAST(floor(p_partkey / 3) AS BIGINT))"

# (text, decision, rule) for the example profile of eligibility queries
TEXTS = (
    ("Must be a resident of Ohio and attend a college in Ohio.", "disqualified", "wrong-state"),
    ("Resident of the U.S. Undergraduate studying a health-related field including biology.", "pass", None),
    ("Must be a resident of Texas pursuing a degree in biology.", "pass", None),
    ("Students of Clemson University pursuing a science degree.", "disqualified", "wrong-institution"),
    ("Must be a first-generation college student studying biology.", "disqualified", "demographic-identity"),
    ("Open to female students pursuing STEM degrees.", "ambiguous", None),
    ("Open to graduating high school seniors, and to no one else.", "disqualified", "wrong-grade-level"),
    ("Graduate students only. Must be a doctoral candidate in science.", "disqualified", "wrong-grade-level"),
    ("Majoring in nursing at any level. Write 500 words on leadership you led in a team.", "disqualified", "wrong-field"),
    ("short", "ambiguous", None),
    ("Must have DACA status.", "disqualified", "citizenship"),
    ("need-based; no essay; community service and volunteer leadership that helps others", "ambiguous", None),
    ("Describe a challenge you overcame. 300-word essay on financial need and tuition cost.", "ambiguous", None),
)


def case_of(i: int) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    return "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {lit(row[i])}" for k, row in enumerate(TEXTS)) + " END"


DESCRIPTION = case_of(0)

COLUMNS = {
    "listing_id": "p_partkey",
    "name": NAME,
    "shared_name": SHARED_NAME,
    "source": SOURCE,
    "org": ORG,
    "amount": AMOUNT,
    "amount_text": AMOUNT_TEXT,
    "deadline": DEADLINE,
    "url": URL,
    "slug": SLUG,
    "description": DESCRIPTION,
    "match": MATCH,
    "effort": EFFORT,
    "flag": FLAG,
}
SELECT = ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
CTE = f"li AS (SELECT {SELECT} FROM part)"
