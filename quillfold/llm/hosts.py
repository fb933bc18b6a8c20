"""URL verdicts: host and path rules, and for the rest trust and distrust carried over the links between hosts.

Trust starts at hosts whose pages the rules allow and flows along links; distrust starts at hosts whose pages they block
and flows against them (who links to a blocked host is suspect). Both are personalised PageRank, iterated as joins and
sums of Spark tables with one row per host and per pair of hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Share of a score that links carry on, number of rounds, and rounds between two writes of the table.
DAMPING, ROUNDS, CUT = 0.85, 20, 5
#: A host is blocked if its distrust exceeds its trust and reaches this (a host all of whose pages are blocked has 0.15).
THRESHOLD = 0.075

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts: absolute links in the html, counted per pair before the shuffle.

    Links without a host stay on their page's host and so make no edge.
    """
    link = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    targets = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(link), F.lit(1))).alias("to"),
    )
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to"))
    return (
        targets.select("src", host_of(whole).alias("dst"))
        .filter("src != '' AND dst != '' AND src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from `seeds` (host, trusted, blocked: shares from 0 to 1) over `edges` (src, dst, links).

    trust = 0.15 * trusted + 0.85 * sum over links into the host of the source's trust, shared among its links;
    distrust likewise with the links reversed. Hosts that occur in edges only start at 0. No rows give no rows.
    """
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    start = saved(
        hosts.join(seeds, "host", "left").select(
            "host",
            (F.coalesce("trusted", F.lit(0.0)) * (1 - DAMPING)).alias("t0"),
            (F.coalesce("blocked", F.lit(0.0)) * (1 - DAMPING)).alias("d0"),
        )
    )
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("into"))
    shared = edges.join(out, "src").join(into, "dst")
    # one row per edge and direction: score of `a` goes to `b`
    steps = saved(
        shared.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("out")).alias("t"), F.lit(0.0).alias("d")),
                    F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("links") / F.col("into")).alias("d")),
                )
            ).alias("s")
        ).select("s.*")
    )
    scores = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for done in range(1, rounds + 1):
        moved = (
            steps.join(scores, steps["a"] == scores["host"])
            .groupBy("b")
            .agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        )
        scores = start.join(moved, start["host"] == moved["b"], "left").select(
            "host",
            (F.col("t0") + DAMPING * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("d0") + DAMPING * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        if done % CUT == 0 or done == rounds:
            scores = saved(scores)
    return scores


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's where one fits, else the host's: block if distrust is above trust and at least
    `threshold`, else allow; a host without any evidence, and the empty host of a null or malformed url, is allowed.
    Null html has no links. Repeated rows give repeated rows; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", rule)
        .withColumn("ruled", verdict)
    )
    share = lambda says: F.avg(F.coalesce((F.col("ruled") == says).cast("double"), F.lit(0.0)))
    seeds = judged.filter("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = propagate(seeds, saved(host_edges(pages)))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold)
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
