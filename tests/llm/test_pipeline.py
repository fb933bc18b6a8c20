from __future__ import annotations

import os

from llm_helpers import ODD, SCHEMA, prose
from pyspark.sql import functions as F
from test_neardup import plain_classes

import corpus_pipeline
from quillfold.llm import secrets


def write(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("gromp" in (t or ""))) for i, t, *_ in docs if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(9001, 25)), (2, prose(9002, 25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_and_run(spark, tmp_path):
    texts = {i: prose(i, 80) for i in range(240)}
    for i in range(0, 240, 4):
        texts[i] += " gromp " + prose(-i, 20)  # toxic
    for i in range(1, 240, 24):
        texts[1000 + i] = texts[i] + " more"  # near copies
        texts[2000 + i] = texts[i + 1] + " " + prose(9001 + i % 2, 25)  # benchmark
        texts[3000 + i] = prose(7000 + i, 50) + " token = abcdefghijklmnop " + prose(i, 9)
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    write(spark, str(tmp_path), docs)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/out/{name}")
        frame = spark.read.parquet(f"{tmp_path}/out/{name}")
        left[name] = frame
        assert name == "packing" or frame.columns == names
    ids = {name: {r.doc_id for r in f.select("doc_id").collect()} for name, f in left.items()}
    clean = {i for i, t in texts.items() if "gromp" not in t}
    assert ids["toxicity"] == clean
    rest = [(i, texts[i]) for i in sorted(clean)]
    firsts = {rest[c][0] for c in plain_classes(rest)}
    assert ids["near-duplicates"] == firsts and len(firsts) < len(clean)
    assert ids["decontamination"] == {i for i in firsts if not 2000 <= i < 3000}
    assert ids["secrets"] == ids["decontamination"] == ids["packing"]
    blotted = left["secrets"].filter("doc_id >= 3000").collect()
    assert blotted and all("abcdefghijklmnop" not in r.text and secrets.PLACEHOLDER in r.text and r.n_chars == len(r.text) for r in blotted)
    run = corpus_pipeline.run(spark, str(tmp_path))
    sums = lambda f: f.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert sorted(sums(run)) == sorted(sums(left["packing"])) and all(r.n == r.d for r in sums(run))


def test_odd_and_no_rows(spark, tmp_path):
    for name, docs in (("odd", ODD), ("none", [])):
        os.makedirs(folder := str(tmp_path / name))
        write(spark, folder, docs)
        found = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
        assert found == ({None, 1, 3, 4, 5, 7, 8, 9} if docs else set())


def test_names_that_the_stages_use_inside(spark):
    """Columns of the caller keep their values, and n_chars may be missing."""
    from quillfold.llm import decontaminate, neardup

    rows = [(1, "token = abcdefghijklmnop and so on", "a", "b", "c", "d"), (2, prose(1, 30), "a", "b", "c", "d"), (3, None, "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text_key string, __doc_id string, __cuts string, __row string")
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    same = lambda f: f.columns == docs.columns and all(tuple(r)[2:] == ("a", "b", "c", "d") for r in f.collect())
    for f in (secrets.redact(docs), neardup.keep_first(docs), decontaminate.without_contaminated(docs, items), corpus_pipeline.blot_secrets(spark, docs, "")):
        assert same(f)
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()} == {1, 3}
    held = docs.select("*", F.lit(34).cast("long").alias("n_chars"), F.lit("x").alias("__held"))
    got = {r.doc_id: r for r in corpus_pipeline.blot_secrets(spark, held, "").collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].n_chars == 34 and {r["__held"] for r in got.values()} == {"x"}
