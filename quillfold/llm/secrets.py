"""Secrets in texts: single patterns, and credentials that come in several parts.

Some parts are telling alone (`BASE`). Others (`WEAK`: an identifier, a key, an endpoint) are everyday text alone and
are reported only where a complementary part stands in the same scope: the parts are joined as intervals, by text and
by stretch of the text, the neighbouring stretches included. Everything is a Spark expression or join.

Results depend on the text alone, so they are found once per distinct text, however often it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Kind, pattern, group whose length counts, least length. All matches are found first, leftmost and
#: without overlap, and short ones dropped after. For a run of one class the bound can stand in the pattern.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    ("id", r"""(?i)\b(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:name|[_-]?id)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 1, 3),
    ("key", r"""(?i)\b(?:pwd|pass|auth|credential|[a-z]{1,16}[_-]?key)["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""", 1, 6),
    ("endpoint", r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}""", 0, 7),
)
#: Kinds that complete a weak kind when they stand in its scope.
COMPLEMENTS = {"id": ("assign", "key"), "key": ("access", "id", "endpoint"), "endpoint": ("assign", "key")}
#: Code points between two parts of one credential, at most.
SCOPE = 256
PLACEHOLDER = "[SECRET]"

_KINDS = [kind for kind, *_ in (*BASE, *WEAK)]


def text_key(text: Column) -> Column:
    """Identifies a whole text; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key")


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Per match of one pattern: kind, number, code points since the match before, its own, and its group's."""
    rx = F.lit(pattern)
    between = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group))
    rows = F.transform(
        F.arrays_zip(whole.alias("w"), part.alias("p")),
        lambda m, i: F.struct(
            F.lit(_KINDS.index(kind)).alias("kind"),
            i.alias("number"),
            F.length(F.get(between, i)).alias("gap"),
            F.length(m["w"]).alias("size"),
            F.length(m["p"]).alias("counted"),
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,counted:int>>"))


def spans(docs: DataFrame) -> DataFrame:
    """(text_key, kind, from, till) of every reported span of every distinct text; kind is a number in `_KINDS`.

    Offsets are code points, `till` exclusive. Texts without a candidate have no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*[_matches(text, kind, pattern, group) for kind, pattern, group, _ in (*BASE, *WEAK)])
    matches = (
        docs.select(text_key(F.col("text").cast("string")), F.explode(found).alias("m"))
        .select("text_key", "m.*")
        .groupBy("text_key", "kind", "number")  # copies of a text meet in the map-side aggregate
        .agg(*[F.max(c).alias(c) for c in ("gap", "size", "counted")])
    )
    before = Window.partitionBy("text_key", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    till = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in (*BASE, *WEAK)]), F.col("kind") + 1)
    parts = saved(
        matches.select("text_key", "kind", "size", "counted", till.alias("till"))
        .filter(F.col("counted") >= least)
        .select("text_key", "kind", (F.col("till") - F.col("size")).alias("from"), "till")
    )
    return parts.filter(F.col("kind") < len(BASE)).unionByName(linked(parts))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with a complementary part at most `scope` code points away.

    A part lies in every stretch of `scope` code points that it touches; a weak part also looks into the stretch before
    its first and after its last. So the join is on equal text and stretch, and pairs are only tested, not produced.
    """
    stretch = lambda at: F.floor(at / F.lit(scope))
    lying = parts.select(
        "text_key",
        F.explode(F.sequence(stretch(F.col("from")), stretch(F.col("till") - 1))).alias("stretch"),
        F.col("kind").alias("other"),
        F.col("from").alias("other_from"),
        F.col("till").alias("other_till"),
    )
    looking = parts.filter(F.col("kind") >= len(BASE)).withColumn(
        "stretch", F.explode(F.sequence(stretch(F.col("from")) - 1, stretch(F.col("till") - 1) + 1))
    )
    suits = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        suits = suits | ((F.col("kind") == _KINDS.index(kind)) & F.col("other").isin([_KINDS.index(x) for x in others]))
    near = (F.col("other_from") - F.col("till") <= scope) & (F.col("from") - F.col("other_till") <= scope)
    meets = looking.alias("l").join(
        lying.alias("r"),
        (F.col("l.text_key") == F.col("r.text_key")) & (F.col("l.stretch") == F.col("r.stretch")) & suits & near,
        "left_semi",
    )
    return meets.select("text_key", "kind", "from", "till").distinct()


def _written(items: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in _KINDS])
    said = F.transform(
        items, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["from"].cast("string"), s["till"].cast("string"))
    )
    return F.array_join(said, ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans lists kind:start:end by start, then kind, comma-joined; base_sha256 is the SHA-256 of the base kinds' part of
    it. A null, empty or clean text has counts 0, the digest of the empty string and empty spans. Repeated rows give
    repeated rows; other columns are ignored.
    """
    listed = (
        spans(docs)
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("from", "kind", "till"))).alias("items"))
    )
    base = lambda s: s["kind"] < len(BASE)
    count = lambda k: F.size(F.filter("items", lambda s: s["kind"] == k)).cast("long")
    # written, so that the join below starts from two fresh exchanges and Spark can split a text with very many copies
    results = listed.select(
        "text_key",
        *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)],
        F.sha2(_written(F.filter("items", base)).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("items")).alias("spans"),
        F.size(F.filter("items", lambda s: ~base(s))).cast("long").alias("n_linked"),
    )
    keyed = docs.select("doc_id", text_key(F.col("text").cast("string")))
    return keyed.join(saved(results), "text_key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind, *_ in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every reported span of `text` replaced by `PLACEHOLDER`, overlapping spans by one. All rows stay.

    Rows without a span are unchanged, nulls too; repeated rows stay repeated; no rows give no rows. Other columns are
    kept, whatever their names.
    """
    order = Window.partitionBy("text_key").orderBy("from", "till")
    reached = F.max("till").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans(docs)
        .withColumn("opens", F.coalesce((F.col("from") > reached).cast("int"), F.lit(1)))
        .withColumn("piece", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("text_key", "piece")
        .agg(F.min("from").alias("from"), F.max("till").alias("till"))
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("from", "till"))).alias("__cuts"))
        .withColumnRenamed("text_key", "__text_key")
    )
    left = lambda i: F.coalesce(F.get(F.col("__cuts"), i - 1)["till"], F.lit(0))
    right = lambda i: F.coalesce(F.get(F.col("__cuts"), i)["from"], F.length("text"))
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__cuts")),
        lambda i: F.substring(F.col("text"), (left(i) + 1).cast("int"), (right(i) - left(i)).cast("int")),
    )
    # the row is one column here, so that no name of the caller's can clash
    keyed = docs.select(F.struct("*").alias("__row"), F.col("text"), text_key(F.col("text").cast("string")).alias("__text_key"))
    changed = F.when(F.col("__cuts").isNotNull(), F.array_join(kept, PLACEHOLDER)).otherwise(F.col("text"))
    met = keyed.join(saved(merged), "__text_key", "left")
    return met.select(*[changed.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
