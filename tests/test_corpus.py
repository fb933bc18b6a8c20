import pytest
from pyspark.sql import functions as F

from quillfold.operators import contamination, leak, register, split
from quillfold.sources import records


def test_contamination_reports_first_by_position(spark):
    docs = spark.createDataFrame(
        [(1, "x one two three four five six seven eight nine y", "s/1"), (2, "nothing shared here at all today my friend ok", "s/2"), (3, "clean", "vault/3")],
        "id int, text string, src string",
    )
    guard = spark.createDataFrame([("one two three four five six seven eight nine",)], "text string")
    out = contamination.flag_contaminated(docs, guard, "id", source_id="src", blocked_paths=("vault/",))
    got = {r["id"]: (r["contaminated"], r["shared_ngram"], r["contamination_reason"]) for r in out.collect()}
    assert got[1] == (True, "one two three four five six seven eight", "shares an 8-gram with a protected text")
    assert got[2][0] is False
    assert got[3] == (True, None, "source under vault/")
    with pytest.raises(contamination.ContaminatedRecords):
        contamination.assert_not_contaminated(out)


def test_registers(spark):
    rows = [
        (1, "fix the failing test and push", False),
        (2, "yeah i dunno, it's kinda weird. we'll see what's up tomorrow. i guess it's fine, can't complain about it much anyway lol", False),
        (3, "I was twelve when we found the river behind the old mill and everything we built there changed how I saw the town. I remember the cold water, and I felt older when we went home.", False),
        (4, "However, the claim fails (Smith, 1999). " + "It follows that the argument cannot rest on this premise alone because the evidence remains thin and contested. " * 6, True),
    ]
    df = spark.createDataFrame(rows, "i int, text string, doc boolean")
    got = {r["i"]: r["register"] for r in register.tag_register(df, F.col("doc")).collect()}
    assert got == {1: "directive", 2: "raw", 3: "narrative", 4: "persuasive"}


def test_split_is_stable_under_new_data(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("doc_key"), F.lit("raw").alias("register"))
    first = split.incremental_split(keys.filter("cast(doc_key as int) < 120"))
    both = split.incremental_split(keys, first)
    assert split.moved_documents(first, both).count() == 0
    counts = {r["split"]: r["n"] for r in first.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"holdout": 18, "exemplar": 30, "train": 72}
    repartitioned = split.incremental_split(keys.repartition(7), first)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, repartitioned.collect()))
    same = split.frozen_digest(both, "doc_key", "split").first()[0]
    assert same == split.frozen_digest(repartitioned.repartition(3), "doc_key", "split").first()[0]


def test_small_registers_hold_out_one(spark):
    keys = spark.createDataFrame([(str(i), "narrative") for i in range(4)] + [(f"x{i}", "raw") for i in range(3)], "doc_key string, register string")
    rows = split.incremental_split(keys).join(keys, "doc_key").groupBy("register").agg(F.count_if(F.col("split") == "holdout").alias("h")).collect()
    assert {r["register"]: r["h"] for r in rows} == {"narrative": 1, "raw": 0}


def test_leaks(spark):
    piece = " ".join(f"alpha{i} beta{i} gamma{i} walked quietly over the long bridge." for i in range(20))
    base = dict(piece=piece, assignment_prompt="describe a crossing", thesis_abstract="crossings change people", moves=["open calm"], anchor_label="a structure")
    rows = [
        {"pair_id": 1, **base},
        {"pair_id": 2, **base, "thesis_abstract": "it walked quietly over the plain"},
        {"pair_id": 3, **base, "anchor_label": "an obelisk"},
        {"pair_id": 4, **base, "assignment_prompt": "long " * 60},
        {"pair_id": 5, **base, "assignment_prompt": "bridge long the over quietly walked"},
    ]
    df = spark.createDataFrame(rows, "pair_id int, piece string, assignment_prompt string, thesis_abstract string, moves array<string>, anchor_label string")
    rare = spark.createDataFrame([("obelisk",)], "word string")
    got = {r["pair_id"]: (r["violation"] or "").split(":")[0] for r in leak.assert_no_leak(df, rare).collect()}
    assert got == {1: "", 2: "shared-phrase", 3: "names-anchor", 4: "too-long", 5: "close-sentence"}


def test_read_turns(spark, tmp_path):
    import json

    lines = [
        {"type": "user", "message": {"content": "hello there"}},
        {"type": "user", "message": {"content": [{"text": "array"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "nested"}]}},
        {"type": "assistant", "message": {"content": "no"}},
        {"type": "user", "isSidechain": True, "message": {"content": "side"}},
        {"type": "user", "toolUseResult": {"x": 1}, "message": {"content": "tool"}},
        {"type": "user", "message": {"content": "<command>"}},
    ]
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "t.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n{"broken')
    rows = records.read_turns(spark, str(tmp_path)).collect()
    assert [(r["text"], r["source_id"]) for r in rows] == [("hello there", "a/t.jsonl#1")]


def test_sections(spark):
    md = "# Title\nintro\n## Facts bank\n- one\n### Deep\nx\n# New part\nlost\n## Other\ny"
    docs = spark.createDataFrame([(1, md)], "k int, text string")
    s = records.split_sections(docs, "k")
    assert [(r["level"], r["heading"], r["body"]) for r in s.orderBy("section").collect()] == [(2, "Facts bank", "- one"), (3, "Deep", "x"), (2, "Other", "y")]
    rules = spark.createDataFrame([(0, "facts", "facts")], "ord int, pattern string, field string")
    assert sorted(r["heading"] for r in records.unclaimed_headings(s, rules).collect()) == ["Deep", "Other"]
    assert [(r["field"], r["body"]) for r in records.assemble_fields(s, rules, "k").collect()] == [("facts", "- one")]
