"""Readers that turn transcripts, documents and edits into corpus records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import normalize_doc
from ..functions.text import plain_spaces, words
from ..operators.containment import beginning_with

# Prefixes that mark a turn as tool or harness output.
NOISE = r"^\s*(?:\z|<|/|!|\[Request interrupted|\[Tool )"


def record_id(source: Column, source_id: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("|"), source_id, F.lit("|"), text), 256), 1, 16)


def is_noise(text: Column) -> Column:
    return text.rlike(NOISE)


def is_author_turn(kind: Column, sidechain: Column, tool_result: Column, content: Column) -> Column:
    """A typed message: user turn, main chain, no tool result, and string content."""
    return (
        kind.eqNullSafe(F.lit("user"))
        & ~F.coalesce(sidechain, F.lit(False))
        & tool_result.isNull()
        & content.isNotNull()
    )


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Author turns from a tree of JSONL transcripts; unparseable lines are skipped.

    ``source_id`` is the path below ``folder`` plus ``#line``. Files are read whole to know line
    numbers, so very large transcripts should be rolled into smaller files.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .text(folder, wholetext=True)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    rel = F.substring_index("path", folder.rstrip("/") + "/", -1)
    lines = files.select(rel.alias("rel"), F.posexplode(F.split("value", "\n")).alias("i", "raw")).filter(
        F.length(F.trim("raw")) > 0
    )
    field = lambda p: F.get_json_object("raw", p)
    # a string content keeps its JSON quotes only when read through its parent object
    message = F.from_json(
        "raw",
        T.StructType([T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]),
    )["message"]["content"]
    parsed = lines.select(
        F.concat("rel", F.lit("#"), (F.col("i") + 1).cast("string")).alias("source_id"),
        field("$.type").alias("type"),
        (field("$.isSidechain") == "true").alias("sidechain"),
        # present but null still counts as a result in the source format, absent does not
        F.when(F.col("raw").rlike(r'"toolUseResult"\s*:'), F.lit("x")).alias("tool_result"),
        # a list of typed parts is tool traffic, whatever its parts hold
        F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.message.content", "variant")) == "STRING", message).alias("content"),
        field("$.timestamp").alias("timestamp"),
    )
    kept = parsed.filter(
        is_author_turn(F.col("type"), F.col("sidechain"), F.col("tool_result"), F.col("content"))
        & ~is_noise(F.col("content"))
    )
    return turn_records(kept.select("source_id", F.col("content").alias("text"), F.to_timestamp("timestamp").alias("timestamp")))


def turn_records(turns: DataFrame, source: str = "transcript") -> DataFrame:
    """Records for (source_id, text, timestamp); the first record of an id wins."""
    text = plain_spaces(F.col("text"))
    return turns.select(
        record_id(F.lit(source), F.col("source_id"), F.col("text")).alias("id"),
        text.alias("text"),
        F.lit(source).alias("source"),
        "source_id",
        "timestamp",
        words(text).alias("word_count"),
        F.lit("heuristic").alias("verified_by"),
        F.lit(None).cast("string").alias("quarantine_reason"),
    ).dropDuplicates(["id"])


AUTHOR_WROTE_IT = "author_wrote_it"


def read_documents(manifest: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of manifest documents whose text is present, and the manifest rows without text.

    Only an explicit authorship statement verifies a document; everything else is quarantined.
    """
    text = normalize_doc(plain_spaces(F.col("text")))
    verified = F.col("authorship") == AUTHOR_WROTE_IT
    found = manifest.join(texts.select("file_id", "text"), "file_id").withColumn("text", text)
    records = found.select(
        record_id(F.lit("document"), F.col("file_id"), F.col("text")).alias("id"),
        "text",
        F.lit("document").alias("source"),
        F.col("file_id").cast("string").alias("source_id"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        words(F.col("text")).alias("word_count"),
        F.when(verified, "author").alias("verified_by"),
        F.when(~F.coalesce(verified, F.lit(False)), "unverified-academic").alias("quarantine_reason"),
    )
    missing = manifest.join(texts.select("file_id"), "file_id", "left_anti")
    return records, missing


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Markdown sections ``key, section, level, heading, body``.

    A level-1 heading is no section of its own and closes the previous one.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,6}\s+\S)")
    piece = docs.select(key, F.posexplode(parts).alias("section", "part"))
    head = F.regexp_extract("part", r"\A(#{1,6})\s+([^\n]*)", 1)
    return (
        piece.withColumn("level", F.length(head))
        .filter("level > 1")
        .select(
            key,
            "section",
            "level",
            F.trim(F.regexp_extract("part", r"\A(#{1,6})\s+([^\n]*)", 2)).alias("heading"),
            F.btrim(F.regexp_replace("part", r"\A#{1,6}\s+[^\n]*", ""), F.lit(" \t\r\n")).alias("body"),
        )
    )


def unclaimed_headings(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """Sections whose heading matches no rule (``pattern, field``; matched at the start, any case)."""
    headings = sections.select("heading").distinct()
    claimed = beginning_with(headings, "heading", rules.select("pattern")).select("heading").distinct()
    return sections.join(claimed, "heading", "left_anti").select(*sections.columns)


def assemble_fields(sections: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Body text per document and field; a section goes to the first rule that claims it."""
    headings = sections.select("heading").distinct()
    first = beginning_with(headings, "heading", rules).groupBy("heading").agg(F.min_by("field", "ord").alias("field"))
    claimed = sections.join(first, "heading").select(key, "section", "body", "field")
    return claimed.groupBy(key, "field").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: s["body"]), "\n\n"
        ).alias("body")
    )
