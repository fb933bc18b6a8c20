"""Inputs derived from the driver's tables, shared by the Spark queries and their SQL.

Derivations are portable SQL expressions, so both sides start from the same rows. Every derived
table has one row per row of the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table, spread

# Transcript-like paste clutter around each document, so that every cleaning rule has work to do.
PASTED = """CASE doc_id % 6
 WHEN 1 THEN concat(text, chr(10), '```py', chr(10), 'x = 1', chr(10), '```', chr(10), 'and then it went on as before.')
 WHEN 2 THEN concat(text, chr(10), '    a = 1', chr(10), '    b = 2', chr(10), '    c = 3', chr(10), 'after the block.')
 WHEN 3 THEN concat('Traceback of the run', chr(10), text, chr(10), 'alpha beta', chr(10), 'gamma delta', chr(10), 'one two', chr(10), 'three four', chr(10), 'done.')
 WHEN 4 THEN concat(text, ' see https://example.org/a?b=1 and /usr/local/share or ~/notes/today ok')
 WHEN 5 THEN concat(text, chr(10), '~~~', chr(10), 'open fence @src/app.ts and main.py:33:7 now')
 ELSE concat(text, '  look at @src/app.ts and  main.py:33:7 now. I was here, we found it. lol') END"""

ALNUM = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
ALPHA = "regexp_extract_all(lower({0}), '[a-z'']+')"


def duck_grams(name: str, source: str, key: str, text: str, n: int) -> str:
    """CTEs giving ``name(key, pos, g)``: every run of n tokens, tokens as rows."""
    w = f"OVER (PARTITION BY {key} ORDER BY pos)"
    parts = " || ' ' || ".join(["w"] + [f"lead(w, {i}) {w}" for i in range(1, n)])
    return (
        f"{name}_w AS (SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, {ALNUM.format(text)} AS t FROM {source})), "
        f"{name}_g AS (SELECT {key}, pos, {parts} AS g FROM {name}_w), {name} AS (SELECT * FROM {name}_g WHERE g IS NOT NULL)"
    )


def duck_draw(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr("doc_id", f"{PASTED} AS text")
