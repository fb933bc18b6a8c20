import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillfold.operators import eventlog
from quillfold.plans import log_rebuild
from quillfold.streaming import keyed_state, log_stream

SCHEMA = log_stream.LOG_SCHEMA
EVENTS = [
    ("discovered", "sch_a", {"name": "A", "url": "https://a.org", "amount": 10}),
    ("state_changed", "sch_a", {"to": "eligible"}),
    ("checkpoint_raised", "sch_a", {"id": "cp1", "type": "CAPTCHA_REQUIRED", "blocking": True}),
    ("checkpoint_raised", "sch_a", {"id": "cp1", "type": "CAPTCHA_REQUIRED", "blocking": True}),
    ("checkpoint_resolved", "sch_a", {"id": "cp1", "resolution": "solved", "resolvedBy": "p"}),
    ("checkpoint_resolved", "sch_a", {"id": "cp1", "resolution": "abandoned", "resolvedBy": "p"}),
    ("checkpoint_raised", "sch_a", {"id": "cp1", "type": "CAPTCHA_REQUIRED"}),
    ("operation_completed", "sch_b", {"id": "op9", "ok": True}),
    ("operation_started", "sch_b", {"id": "op1", "kind": "submit_application"}),
    ("operation_completed", "sch_b", {"id": "op1", "ok": False}),
    ("form_mapped", "sch_b", {"essayPrompts": ["p1"], "platform": "direct"}),
    ("form_mapped", "sch_b", {"essayPrompts": []}),
    ("artifact_added", "sch_b", {"kind": "award-notice", "verified": True}),
    ("discovered", "sch_b", {"name": "B"}),
    ("attestation_recorded", "sch_b", {"affirmed": True}),
    ("submitted", "sch_b", {}),
]


def rows_of(events):
    import datetime

    t0 = datetime.datetime(2026, 1, 1)
    return [(i + 1, t0 + datetime.timedelta(hours=i), t, a, "agent", json.dumps(d)) for i, (t, a, d) in enumerate(events)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(rows_of(EVENTS), SCHEMA)


def test_folds(log):
    apps = {r["application_id"]: r for r in eventlog.fold_applications(log).collect()}
    assert apps["sch_a"]["workflow_state"] == "ELIGIBILITY_CHECKED" and apps["sch_a"]["amount"] == 10.0
    b = apps["sch_b"]
    assert b["name"] == "B" and b["essay_prompts"] is None and b["platform"] is None  # the discovery reset them
    assert b["last_mapped_at"] is not None and b["submitted_at"] is not None and b["decision"] == "unscreened"
    assert [(r["application_id"], r["kind"]) for r in eventlog.application_artifacts(log).collect()] == [("sch_b", "attestation_recorded")]
    assert [(r["checkpoint_id"], r["raised_seq"]) for r in eventlog.open_checkpoints(log).collect()] == [("cp1", 7)]
    assert [(r["seq"], r["resolution"]) for r in eventlog.resolved_checkpoints(log).collect()] == [(5, "solved")]
    assert [(r["operation_id"], r["status"]) for r in eventlog.operation_states(log).collect()] == [("op1", "failed")]


def test_empty_prompts_do_not_erase(spark):
    rows = rows_of([e for e in EVENTS if e[1] == "sch_b"][:5])
    r = eventlog.fold_applications(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["essay_prompts"] == '["p1"]' and r["platform"] == "direct"


def test_chain(log):
    sealed = eventlog.seal_log(log, block=5)
    assert eventlog.verify_chain(sealed, block=5).first()["ok"]
    changed = sealed.withColumn("data", F.when(F.col("seq") == 7, F.lit('{"x":1}')).otherwise(F.col("data")))
    v = eventlog.verify_chain(changed, block=5).first()
    assert (v["ok"], v["broken_at"]) == (False, 8)
    last_of_block = sealed.withColumn("data", F.when(F.col("seq") == 10, F.lit('{"x":1}')).otherwise(F.col("data")))
    assert eventlog.verify_chain(last_of_block, block=5).first()["broken_at"] == 11
    assert eventlog.verify_chain(sealed.union(sealed.filter("seq = 3")), block=5).first()["ok"] is False
    with pytest.raises(log_rebuild.BrokenChain):
        log_rebuild.rebuild(changed, block=5)
    assert log_rebuild.rebuild(sealed, block=5)["applications"].count() == 2


def test_a_forged_and_resealed_history_changes_the_last_link(log):
    links = lambda x: [r["prev_hash"] for r in eventlog.seal_log(x, block=3).orderBy("seq").collect()]
    forged = log.withColumn("data", F.when(F.col("seq") == 2, F.lit('{"x":1}')).otherwise(F.col("data")))
    one, other = links(log), links(forged)
    assert one[:2] == other[:2] and all(a != b for a, b in zip(one[2:], other[2:], strict=True)) and len(one) > 9


def test_streams_equal_batch(spark, log, tmp_path):
    path = str(tmp_path / "log")
    for lo, hi in ((1, 4), (5, 6), (7, 12), (13, 16)):
        log_stream.write_log(log.filter(F.col("seq").between(lo, hi)).coalesce(1), path)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    stream = lambda: log_stream.stream_log(spark, path, files_per_trigger=1)
    assert same(eventlog.fold_applications(log), log_stream.stream_fold_applications(stream()))
    assert same(eventlog.open_checkpoints(log), log_stream.stream_open_checkpoints(stream()))
    assert same(eventlog.operation_states(log), log_stream.stream_operation_states(stream()))
    raised = log_stream.stream_accepted_raises(stream())
    assert sorted(r["seq"] for r in raised.collect()) == [3, 7]
    assert sorted(r["seq"] for r in log_stream.accepted_raises(log).collect()) == [3, 7]


def checkpoint_log(spark, seed, events):
    """Random raises and resolutions of a few checkpoints, a second apart."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, events + 1):
        data = {"id": f"c{rnd.randrange(5)}", "type": "CAPTCHA_REQUIRED"}
        if rnd.random() < 0.4:
            data = {"id": data["id"], "resolution": rnd.choice(["done", "skipped"]), "resolvedBy": "u"}
        rows.append((seq, seq, "checkpoint_raised" if "type" in data else "checkpoint_resolved", f"app{seq % 3}", "agent", json.dumps(data)))
    log = spark.createDataFrame(rows, "seq long, s long, type string, application_id string, actor string, data string")
    at = F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")
    return log.select("seq", at.alias("at"), "type", "application_id", "actor", "data")


def in_files(log, path, files):
    """One file per list of sequence numbers, in that order of time."""
    for k, seqs in enumerate(files):
        log_stream.write_log(log.filter(F.col("seq").isin(list(seqs))).coalesce(1), path)
        time.sleep(0.05)


@pytest.mark.parametrize("seed", [1, 2])
def test_raises_and_resolutions_in_any_order(spark, tmp_path, monkeypatch, seed):
    """One file per micro-batch, events of all times in each, some told twice; folders merged on the way."""
    monkeypatch.setattr(log_stream, "MERGE_EVERY", 3)
    log = checkpoint_log(spark, seed, 60)
    seqs = list(range(1, 61))
    random.Random(seed).shuffle(seqs)
    path = str(tmp_path / "log")
    in_files(log, path, [seqs[i : i + 10] for i in range(0, 60, 10)] + [seqs[5:9]])
    stream = lambda: log_stream.stream_log(spark, path, files_per_trigger=1)
    rows = lambda df: sorted(map(str, df.collect()))
    batch = log_stream.accepted_raises(log)
    assert rows(log_stream.stream_accepted_raises(stream()).select(*batch.columns)) == rows(batch)
    batch = eventlog.resolved_checkpoints(log)
    assert rows(log_stream.stream_resolved(stream()).select(*batch.columns)) == rows(batch)


def test_state_behind_the_watermark_is_settled(spark, tmp_path):
    """Files a little out of order and lateness enough: the same result, though settled events have left the state."""
    log = checkpoint_log(spark, 3, 60)
    path = str(tmp_path / "log")
    blocks = [list(range(i, i + 6)) for i in range(1, 61, 6)]
    for i in range(0, 10, 2):
        blocks[i], blocks[i + 1] = blocks[i + 1], blocks[i]
    in_files(log, path, blocks)
    got = log_stream.stream_accepted_raises(log_stream.stream_log(spark, path, files_per_trigger=1), lateness="20 seconds")
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in log_stream.accepted_raises(log).collect())


def test_scores_upserted_and_expired(spark, tmp_path):
    rows = [("p", "A Fund", 10, "low", [], "2026-01-01", 1), ("p", "a fund", 20, "med", ["x"], "2026-01-05", 2), ("p", "B", 30, "low", [], "2026-03-30", 3),
            ("p", "C", 40, "huge", [], "2026-03-30", 4), ("p", "D", 50, "low", ["score_failed"], "2026-03-30", 5), ("q", "E", 60, "low", [], "2026-03-30", 6),
            ("p", "F", None, "low", [], "2026-03-30", 7), ("p", "b", 31, "low", None, "2026-03-29", 8), ("p", "G", 70, "high", [], "2026-04-20", 9)]
    frame = spark.createDataFrame(rows, "profile_hash string, name string, match int, effort string, flags array<string>, at string, ord long").withColumn("at", F.col("at").cast("timestamp"))
    path = str(tmp_path / "scores")
    for order in ([1], [8, 5], [2, 6], [3, 4], [7, 9], [1, 8]):  # the last file is a replay
        frame.filter(F.col("ord").isin(order)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = lambda: spark.readStream.schema(log_stream.SCORE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    at = lambda day: F.lit(day).cast("timestamp")
    got = lambda day, **k: sorted((r.key, r.match, r.effort, list(r["flags"])) for r in log_stream.stream_score_cache(stream(), "p", at(day), **k).collect())
    assert got("2026-04-01") == [("afund", 20, "med", ["x"]), ("b", 30, "low", []), ("g", 70, "high", [])]
    assert got("2026-04-20") == [("b", 30, "low", []), ("g", 70, "high", [])]
    usable = stream().withColumn("value", F.lit("v")).withColumn("key", F.col("name"))
    told = log_stream._changelog(spark, keyed_state.upserted(usable.select("key", "at", "ord", "value"), 90, "0 seconds"), "key", "told")
    assert {r.key for r in told.filter("expired").collect()} >= {"A Fund", "a fund"}  # 110 days behind the newest


def test_two_level_lag(spark):
    from quillfold.operators.ranking import previous_in_group

    df = spark.range(50).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("g"))
    got = previous_in_group(df, "g", "seq", F.col("seq"), width=7).collect()
    assert all(r["prev"] == (r["seq"] - 3 if r["seq"] >= 3 else None) for r in got)


def test_secrets(spark):
    data = '{"a":{"Password":"x","ok":1},"l":[{"api-key":"y"}],"token":[1]}'
    df = spark.createDataFrame([(data,), ("not json",)], "d string")
    got = [r[0] for r in df.select(eventlog.scrub_secrets(F.col("d"))).collect()]
    assert json.loads(got[0]) == {"a": {"Password": "[redacted]", "ok": 1}, "l": [{"api-key": "[redacted]"}], "token": "[redacted]"} and got[1] == "not json"
