"""Event-log queries over ``events``: one log event per row, with payloads derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkpoints, eligibility, eventlog, outcomes
from ..session import cut_lineage, read_table, scratch_dir, spread
from ..streaming import log_stream

# portable derivation of the log
TYPE = """CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'click' THEN 'checkpoint_raised' WHEN 'purchase' THEN 'checkpoint_resolved'
 WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'state_changed' WHEN 1 THEN 'eligibility_screened' WHEN 2 THEN 'form_mapped' WHEN 3 THEN 'artifact_added' ELSE 'submitted' END
 ELSE CASE event_id % 3 WHEN 0 THEN 'operation_started' WHEN 1 THEN 'operation_completed' ELSE 'form_filled' END END"""
APP = "concat('app', user_id)"
CHECKPOINT = "concat('cp', user_id, '-', CAST(floor(value) AS BIGINT) % 2)"
OPERATION = "concat('op', user_id, '-', event_id % 4)"
STATE = "CASE event_id % 4 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'submitted' WHEN 2 THEN 'nonsense' ELSE 'LOST' END"
DUE = "concat('2024-0', 1 + event_id % 9, '-15')"
RESOLUTION = "CASE event_id % 3 WHEN 0 THEN 'verified_win' WHEN 1 THEN 'not_a_win' ELSE 'scam_suspected' END"
CP_TYPE = "CASE user_id % 3 WHEN 0 THEN 'AWARD_NOTICE_REVIEW' WHEN 1 THEN 'CAPTCHA_REQUIRED' ELSE 'SCORING_FAILED' END"
BLOCKING = "CASE user_id % 3 WHEN 2 THEN 'false' ELSE 'true' END"
DATA = f"""CASE {TYPE}
 WHEN 'discovered' THEN concat('{{"name":"n', user_id, '","url":"https://x', user_id, '.example.org","source":"src', user_id % 5, '","effort":"', CASE user_id % 2 WHEN 0 THEN 'low' ELSE 'high' END, '","amount":', CAST(floor(value) AS BIGINT), ',"deadlineISO":"', {DUE}, '"}}')
 WHEN 'state_changed' THEN concat('{{"to":"', {STATE}, '"}}')
 WHEN 'eligibility_screened' THEN concat('{{"decision":"', CASE event_id % 2 WHEN 0 THEN 'pass' ELSE 'disqualified' END, '"', CASE event_id % 2 WHEN 0 THEN '' ELSE ',"hardDqRule":"wrong-state"' END, '}}')
 WHEN 'form_mapped' THEN concat('{{"essayPrompts":', CASE event_id % 4 WHEN 0 THEN '[]' ELSE concat('["p', event_id, '"]') END, CASE event_id % 3 WHEN 0 THEN ',"platform":"direct"' ELSE '' END, '}}')
 WHEN 'artifact_added' THEN concat('{{"kind":"award-notice","verified":', CASE event_id % 2 WHEN 0 THEN 'true' ELSE 'false' END, '}}')
 WHEN 'checkpoint_raised' THEN concat('{{"id":"', {CHECKPOINT}, '","type":"', {CP_TYPE}, '","blocking":', {BLOCKING}, ',"context":{{"name":"n', user_id, '","hidden":"h"}}}}')
 WHEN 'checkpoint_resolved' THEN concat('{{"id":"', {CHECKPOINT}, '","resolution":"', {RESOLUTION}, '","resolvedBy":"u', user_id, '"}}')
 WHEN 'operation_started' THEN concat('{{"id":"', {OPERATION}, '","kind":"submit_application"}}')
 WHEN 'operation_completed' THEN concat('{{"id":"', {OPERATION}, '","ok":', CASE event_id % 2 WHEN 0 THEN 'true' ELSE 'false' END, '}}')
 ELSE '{{}}' END"""
EXPRS = (
    "event_id + 1 AS seq",
    "ts AS at",
    f"{TYPE} AS type",
    f"{APP} AS application_id",
    "CASE event_id % 3 WHEN 0 THEN 'human' ELSE 'agent' END AS actor",
    f"{DATA} AS data",
)
CTE = f"lg AS (SELECT event_id + 1 AS seq, ts, {TYPE} AS type, {APP} AS app, {CHECKPOINT} AS cp, {OPERATION} AS op, {STATE} AS st, {RESOLUTION} AS res, {CP_TYPE} AS cpt, {DUE} AS due, user_id, event_id, value FROM events)"


def _log(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value"), "event_id").selectExpr(*EXPRS)


def _apps(df):
    return df.select(
        "application_id", "name", "source", "effort", "amount", "deadline_iso", "discovered_at", "decision", "hard_dq_rule", "workflow_state", "essay_prompts", "platform", "last_mapped_at", "last_run_at", "submitted_at", "last_seq"
    )


def q_fold_applications(spark, sf_dir):
    return _apps(eventlog.fold_applications(_log(spark, sf_dir)))


def q_application_artifacts(spark, sf_dir):
    a = eventlog.application_artifacts(_log(spark, sf_dir))
    return a.groupBy("application_id").agg(F.count("*").alias("artifacts"), F.count_if("verified").alias("verified"))


def q_open_checkpoints(spark, sf_dir):
    return eventlog.open_checkpoints(_log(spark, sf_dir)).select("checkpoint_id", "checkpoint_type", "application_id", "blocking", "raised_seq", "created_at")


def q_resolved_checkpoints(spark, sf_dir):
    return eventlog.resolved_checkpoints(_log(spark, sf_dir)).select("checkpoint_id", "seq", "checkpoint_type", "resolution", "resolved_by", "created_at")


def q_operation_states(spark, sf_dir):
    return eventlog.operation_states(_log(spark, sf_dir)).select("operation_id", "kind", "application_id", "status", "started_at", "completed_at")


def q_disposition(spark, sf_dir):
    states = eventlog.operation_states(_log(spark, sf_dir))
    wanted = read_table(spark, sf_dir, "events").selectExpr("user_id").distinct().select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("op"), F.col("user_id").cast("string"), F.lit("-"), i.cast("string")))).alias("operation_id")
    )
    return eventlog.disposition(wanted, states).select("operation_id", "disposition", "retry")


def q_operation_id(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    salient = F.create_map(F.lit("z"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return e.select("event_id", eventlog.operation_id(F.lit("submit_application"), F.expr(APP), salient).alias("operation_id"))


def _sealed(spark, sf_dir):
    return eventlog.seal_log(_log(spark, sf_dir), block=500)


def q_seal_log(spark, sf_dir):
    return _sealed(spark, sf_dir).select("seq", "prev_hash")


def q_verify_chain(spark, sf_dir):
    """A sound chain, the same with one payload changed, and with one event missing."""
    sealed = cut_lineage(_sealed(spark, sf_dir))
    tampered = sealed.withColumn("data", F.when(F.col("seq") == 1234, F.lit('{"to":"WON"}')).otherwise(F.col("data")))
    verdicts = [
        eventlog.verify_chain(t, block=500).withColumn("log", F.lit(n))
        for n, t in (("sound", sealed), ("tampered", tampered), ("gap", sealed.filter("seq <> 777")))
    ]
    return verdicts[0].unionByName(verdicts[1]).unionByName(verdicts[2])


def q_latest_frozen(spark, sf_dir):
    return eventlog.latest_frozen(_log(spark, sf_dir), "submitted").select("seq", "application_id", "actor")


def q_scrub_secrets(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.expr("concat('{\"user\":\"u', user_id, '\",\"password\":\"p', event_id, '\",\"list\":[{\"API_key\":{\"x\":1}},{\"ok\":', user_id, '}]}')").alias("data")
    )
    return e.select("event_id", eventlog.scrub_secrets(F.col("data")).alias("data"))


def _proposed(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'ELIGIBILITY_AMBIGUOUS' WHEN 1 THEN 'CAPTCHA_REQUIRED' WHEN 2 THEN 'MADE_UP' ELSE 'SUBMIT_APPROVAL' END").alias("checkpoint_type"),
        F.expr(APP).alias("application_id"),
        F.expr("CAST(event_id % 2 AS STRING)").alias("discriminator"),
        F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("rules_url"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")).alias("evidence"),
    )


def _open_some(spark, sf_dir):
    p = _proposed(spark, sf_dir).filter("checkpoint_type = 'CAPTCHA_REQUIRED' AND ord % 8 = 1")
    return p.select(checkpoints.checkpoint_id(F.col("checkpoint_type"), F.col("application_id"), F.col("discriminator")).alias("checkpoint_id")).distinct()


def q_raise_checkpoints(spark, sf_dir):
    r = checkpoints.raise_checkpoints(_proposed(spark, sf_dir), checkpoints.registry(spark), _open_some(spark, sf_dir))
    return r.select("checkpoint_id", "checkpoint_type", "application_id", "outcome", F.array_join("missing_evidence", ",").alias("missing"))


def q_resolve_checkpoints(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    opened = e.select("user_id").distinct().selectExpr(
        "concat('c', user_id) AS checkpoint_id",
        "CASE user_id % 4 WHEN 0 THEN 'AWARD_NOTICE_REVIEW' WHEN 1 THEN 'ELIGIBILITY_AMBIGUOUS' WHEN 2 THEN 'ACCOUNT_REQUIRED' ELSE 'SIGNATURE_REQUIRED' END AS checkpoint_type",
        f"{APP} AS application_id",
        "map('notice_source', 'mail') AS evidence",
    )
    said = e.select(
        "event_id",
        F.expr("concat('c', user_id + CASE WHEN event_id % 10 = 9 THEN 100000 ELSE 0 END)").alias("checkpoint_id"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 'verified_win' WHEN 1 THEN 'eligible' WHEN 2 THEN 'authenticated' WHEN 3 THEN 'signed' ELSE 'scam_suspected' END").alias("resolution"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'pat' END").alias("resolved_by"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'agent' END").alias("role"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("notice_ref"), F.lit("r"), F.lit("rules_url"), F.lit("u"))).alias("evidence"),
    )
    r = checkpoints.resolve_checkpoints(said, opened, checkpoints.registry(spark))
    return r.groupBy("checkpoint_type", "resolution", "outcome", "emits", "effect").agg(F.count("*").alias("n"))


def q_open_queue(spark, sf_dir):
    q = checkpoints.open_queue(eventlog.open_checkpoints(_log(spark, sf_dir)))
    return q.select("checkpoint_id", "blocking", "created_at", F.to_json("context").alias("context"))


def q_deadline_digest(spark, sf_dir):
    apps = eventlog.fold_applications(_log(spark, sf_dir))
    return outcomes.deadline_digest(apps, F.lit("2024-04-01").cast("date"), 60).select("application_id", "days_remaining", "due", "workflow_state")


def q_log_outcomes(spark, sf_dir):
    """Win rates straight from the log: resolved reviews joined to folded applications."""
    log = _log(spark, sf_dir)
    facts = outcomes.outcome_facts(eventlog.resolved_checkpoints(log), eventlog.fold_applications(log))
    b = outcomes.outcome_buckets(facts)
    return b.select("source", "effort", "wins", "total", F.round("rate", 6).alias("rate"))


def q_adjudicate(spark, sf_dir):
    from ..plans.log_rebuild import adjudicate

    apps = eventlog.fold_applications(_log(spark, sf_dir)).select("application_id", "decision", "url")
    texts = read_table(spark, sf_dir, "customer").select(
        F.expr("concat('app', c_custkey)").alias("application_id"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Must be a resident of Ohio to apply here.' WHEN 1 THEN 'Open to undergraduates studying biology.' ELSE 'Something else entirely here.' END").alias("text"),
    )
    judged = adjudicate(apps, texts, eligibility.Profile(state_names=("texas",), allowed_fields=("biology",)))
    return judged.select("application_id", "outcome", "rule", "new_state", F.col("checkpoint_id").isNotNull().alias("raises"))


def _written_log(spark, sf_dir):
    path = scratch_dir(spark, "log")
    log_stream.write_log(_log(spark, sf_dir).repartition(4), path)
    return path


def q_read_log(spark, sf_dir):
    return log_stream.read_log(spark, _written_log(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def _stream(spark, sf_dir):
    return log_stream.stream_log(spark, _written_log(spark, sf_dir), files_per_trigger=2)


def q_stream_fold_applications(spark, sf_dir):
    return _apps(log_stream.stream_fold_applications(_stream(spark, sf_dir)))


def q_stream_open_checkpoints(spark, sf_dir):
    return log_stream.stream_open_checkpoints(_stream(spark, sf_dir)).select("checkpoint_id", "checkpoint_type", "application_id", "blocking", "raised_seq", "created_at")


def q_stream_operation_states(spark, sf_dir):
    return log_stream.stream_operation_states(_stream(spark, sf_dir)).select("operation_id", "kind", "application_id", "status", "started_at", "completed_at")


def _shuffled(spark, sf_dir):
    """The log in files that hold events of all times, one file per micro-batch."""
    path = scratch_dir(spark, "log")
    log_stream.write_log(_log(spark, sf_dir).repartition(4, F.xxhash64("seq")), path)
    return log_stream.stream_log(spark, path, files_per_trigger=1)


def q_raise_stream(spark, sf_dir):
    return log_stream.stream_accepted_raises(_shuffled(spark, sf_dir))


def q_stream_resolved(spark, sf_dir):
    r = log_stream.stream_resolved(_shuffled(spark, sf_dir))
    return r.select("checkpoint_id", "seq", "checkpoint_type", "resolution", "resolved_by", "created_at")


def q_accepted_raises(spark, sf_dir):
    return log_stream.accepted_raises(_log(spark, sf_dir))


QUERIES = {
    "fold_applications": q_fold_applications,
    "application_artifacts": q_application_artifacts,
    "open_checkpoints": q_open_checkpoints,
    "resolved_checkpoints": q_resolved_checkpoints,
    "operation_states": q_operation_states,
    "disposition": q_disposition,
    "operation_id": q_operation_id,
    "seal_log": q_seal_log,
    "verify_chain": q_verify_chain,
    "latest_frozen": q_latest_frozen,
    "scrub_secrets": q_scrub_secrets,
    "raise_checkpoints": q_raise_checkpoints,
    "resolve_checkpoints": q_resolve_checkpoints,
    "open_queue": q_open_queue,
    "deadline_digest": q_deadline_digest,
    "log_outcomes": q_log_outcomes,
    "adjudicate": q_adjudicate,
    "read_log": q_read_log,
    "stream_fold_applications": q_stream_fold_applications,
    "stream_open_checkpoints": q_stream_open_checkpoints,
    "stream_operation_states": q_stream_operation_states,
    "raise_stream": q_raise_stream,
    "stream_resolved": q_stream_resolved,
    "accepted_raises": q_accepted_raises,
}

# ---------------------------------------------------------------- DuckDB equivalents


def _last(value: str, cond: str, order: str = "seq") -> str:
    return f"arg_max_null({value}, CASE WHEN {cond} THEN {order} END)"


_CANON = "CASE st WHEN 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' WHEN 'submitted' THEN 'SUBMITTED' WHEN 'nonsense' THEN 'DISCOVERED' ELSE 'LOST' END"
_FOLD = f"""{CTE},
ap AS (SELECT app AS application_id,
  coalesce(max(CASE WHEN type = 'discovered' THEN 'n' || user_id END), '') AS name,
  max(CASE WHEN type = 'discovered' THEN 'src' || (user_id % 5) END) AS source,
  max(CASE WHEN type = 'discovered' THEN CASE user_id % 2 WHEN 0 THEN 'low' ELSE 'high' END END) AS effort,
  max_by(floor(value), seq) FILTER (type = 'discovered') AS amount,
  max_by(due::DATE, seq) FILTER (type = 'discovered') AS deadline_iso,
  max_by(ts, seq) FILTER (type = 'discovered') AS discovered_at,
  coalesce(max_by(CASE type WHEN 'discovered' THEN 'unscreened' ELSE CASE event_id % 2 WHEN 0 THEN 'pass' ELSE 'disqualified' END END, seq) FILTER (type IN ('discovered', 'eligibility_screened')), 'unscreened') AS decision,
  nullif(max_by(CASE type WHEN 'discovered' THEN '-' ELSE 'wrong-state' END, seq) FILTER (type = 'discovered' OR (type = 'eligibility_screened' AND event_id % 2 = 1)), '-') AS hard_dq_rule,
  coalesce(max_by(CASE type WHEN 'discovered' THEN 'DISCOVERED' ELSE {_CANON} END, seq) FILTER (type IN ('discovered', 'state_changed')), 'DISCOVERED') AS workflow_state,
  nullif(max_by(CASE type WHEN 'discovered' THEN '-' ELSE '["p' || event_id || '"]' END, seq) FILTER (type = 'discovered' OR (type = 'form_mapped' AND event_id % 4 <> 0)), '-') AS essay_prompts,
  nullif(max_by(CASE type WHEN 'discovered' THEN '-' ELSE 'direct' END, seq) FILTER (type = 'discovered' OR (type = 'form_mapped' AND event_id % 3 = 0)), '-') AS platform,
  max_by(ts, seq) FILTER (type = 'form_mapped') AS last_mapped_at, max_by(ts, seq) FILTER (type IN ('form_filled', 'submitted')) AS last_run_at,
  max_by(ts, seq) FILTER (type = 'submitted') AS submitted_at, max(seq) AS last_seq FROM lg GROUP BY 1)"""
_OPEN = f"""{CTE}, op AS (SELECT cp AS checkpoint_id, max(seq) FILTER (type = 'checkpoint_raised') AS raised_seq, max(seq) FILTER (type = 'checkpoint_resolved') AS resolved_seq,
  any_value(cpt) AS checkpoint_type, any_value(app) AS application_id, any_value(user_id) AS uid, max_by(ts, seq) FILTER (type = 'checkpoint_raised') AS created_at FROM lg WHERE type IN ('checkpoint_raised', 'checkpoint_resolved') GROUP BY 1),
oc AS (SELECT *, uid % 3 <> 2 AS blocking FROM op WHERE raised_seq > coalesce(resolved_seq, -1))"""
_RESOLVED = f"""{CTE}, ev AS (SELECT *, lag(type) OVER w AS pt, lag(ts) OVER w AS pts FROM lg WHERE type IN ('checkpoint_raised', 'checkpoint_resolved') WINDOW w AS (PARTITION BY cp ORDER BY seq)),
rv AS (SELECT * FROM ev WHERE type = 'checkpoint_resolved' AND pt = 'checkpoint_raised')"""
_OPS = f"""{CTE}, os AS (SELECT op AS operation_id, max(seq) FILTER (type = 'operation_started') AS s, max(seq) FILTER (type = 'operation_completed') AS e, max_by(ts, seq) FILTER (type = 'operation_started') AS started_at,
  max_by(ts, seq) FILTER (type = 'operation_completed') AS ended, max_by(event_id % 2 = 0, seq) FILTER (type = 'operation_completed') AS ok, any_value(app) AS application_id FROM lg WHERE type IN ('operation_started', 'operation_completed') GROUP BY 1),
ot AS (SELECT operation_id, 'submit_application' AS kind, application_id, CASE WHEN coalesce(e, -1) < s THEN 'started' WHEN ok THEN 'completed' ELSE 'failed' END AS status, started_at, CASE WHEN coalesce(e, -1) > s THEN ended END AS completed_at FROM os WHERE s IS NOT NULL)"""
_APP_COLS = "application_id, name, source, effort, amount, deadline_iso, discovered_at, decision, hard_dq_rule, workflow_state, essay_prompts, platform, last_mapped_at, last_run_at, submitted_at, last_seq"
_CONTENT = "'{\"seq\":' || seq || ',\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"type\":\"' || type || '\",\"application_id\":\"' || app || '\",\"actor\":\"' || actor || '\",\"data\":\"' || replace(data, '\"', '\\\"') || '\"}'"
_SEAL = f"""sl AS (SELECT event_id + 1 AS seq, ts, {TYPE} AS type, {APP} AS app, CASE event_id % 3 WHEN 0 THEN 'human' ELSE 'agent' END AS actor, {DATA} AS data FROM events),
sc AS (SELECT seq, floor((seq - 1) / 500)::BIGINT AS b, {_CONTENT} AS c FROM sl),
bd AS (SELECT b, sha256(string_agg(sha256(c), '|' ORDER BY seq)) AS d, list(c ORDER BY seq) AS cs FROM sc GROUP BY b),
rt(b, root) AS (SELECT 0::BIGINT, 'null' UNION ALL SELECT rt.b + 1, sha256(d || '|' || root) FROM rt JOIN bd ON bd.b = rt.b),
ln AS (SELECT b, len(cs) AS n, string_split(list_reduce(list_prepend(root, cs), lambda a, x: a || ',' || sha256(x || '|' || right(a, 64))), ',') AS links FROM bd JOIN rt USING (b))"""
_RAISE = f"""pr AS (SELECT event_id AS ord, CASE event_id % 4 WHEN 0 THEN 'ELIGIBILITY_AMBIGUOUS' WHEN 1 THEN 'CAPTCHA_REQUIRED' WHEN 2 THEN 'MADE_UP' ELSE 'SUBMIT_APPROVAL' END AS t, {APP} AS app, (event_id % 2)::VARCHAR AS d, user_id % 2 = 0 AS ev FROM events),
pk AS (SELECT *, 'cp_' || substr(sha256(t || '|' || app || '|' || d), 1, 12) AS id FROM pr),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM pk) WHERE k = 1), po AS (SELECT DISTINCT id FROM pk WHERE t = 'CAPTCHA_REQUIRED' AND ord % 8 = 1)"""
_SAID = f"""rs AS (SELECT event_id, user_id, event_id % 10 <> 9 AS known, CASE event_id % 5 WHEN 0 THEN 'verified_win' WHEN 1 THEN 'eligible' WHEN 2 THEN 'authenticated' WHEN 3 THEN 'signed' ELSE 'scam_suspected' END AS resolution FROM events),
rt AS (SELECT *, CASE WHEN known THEN CASE user_id % 4 WHEN 0 THEN 'AWARD_NOTICE_REVIEW' WHEN 1 THEN 'ELIGIBILITY_AMBIGUOUS' WHEN 2 THEN 'ACCOUNT_REQUIRED' ELSE 'SIGNATURE_REQUIRED' END END AS checkpoint_type FROM rs),
ro AS (SELECT *, CASE WHEN NOT known THEN 'not-open'
 WHEN NOT ((checkpoint_type = 'AWARD_NOTICE_REVIEW' AND resolution IN ('verified_win', 'scam_suspected')) OR (checkpoint_type = 'ELIGIBILITY_AMBIGUOUS' AND resolution = 'eligible') OR (checkpoint_type = 'ACCOUNT_REQUIRED' AND resolution = 'authenticated') OR (checkpoint_type = 'SIGNATURE_REQUIRED' AND resolution = 'signed')) THEN 'resolution-not-allowed'
 WHEN event_id % 11 = 0 THEN 'role-not-allowed' WHEN event_id % 7 = 0 THEN 'no-resolver'
 WHEN event_id % 2 = 1 AND checkpoint_type = 'AWARD_NOTICE_REVIEW' THEN 'missing-evidence: notice_ref' WHEN event_id % 2 = 1 AND checkpoint_type = 'ELIGIBILITY_AMBIGUOUS' THEN 'missing-evidence: rules_url' ELSE 'accepted' END AS outcome FROM rt)"""

ORACLES = {
    "fold_applications": f"WITH {_FOLD} SELECT {_APP_COLS} FROM ap",
    "stream_fold_applications": f"WITH {_FOLD} SELECT {_APP_COLS} FROM ap",
    "application_artifacts": f"WITH {CTE}, rs AS (SELECT app, max(seq) AS r FROM lg WHERE type = 'discovered' GROUP BY 1) SELECT lg.app AS application_id, count(*) AS artifacts, count(*) FILTER (event_id % 2 = 0) AS verified FROM lg LEFT JOIN rs USING (app) WHERE type = 'artifact_added' AND seq > coalesce(r, 0) GROUP BY 1",
    "open_checkpoints": f"WITH {_OPEN} SELECT checkpoint_id, checkpoint_type, application_id, blocking, raised_seq, created_at FROM oc",
    "stream_open_checkpoints": f"WITH {_OPEN} SELECT checkpoint_id, checkpoint_type, application_id, blocking, raised_seq, created_at FROM oc",
    "resolved_checkpoints": f"WITH {_RESOLVED} SELECT cp AS checkpoint_id, seq, cpt AS checkpoint_type, res AS resolution, 'u' || user_id AS resolved_by, pts AS created_at FROM rv",
    "stream_resolved": f"WITH {_RESOLVED} SELECT cp AS checkpoint_id, seq, cpt AS checkpoint_type, res AS resolution, 'u' || user_id AS resolved_by, pts AS created_at FROM rv",
    "operation_states": f"WITH {_OPS} SELECT operation_id, kind, application_id, status, started_at, completed_at FROM ot",
    "stream_operation_states": f"WITH {_OPS} SELECT operation_id, kind, application_id, status, started_at, completed_at FROM ot",
    "disposition": f"WITH {_OPS}, wq AS (SELECT 'op' || user_id || '-' || i AS operation_id FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(range(0, 5)) AS i)) SELECT operation_id, CASE WHEN status IS NULL OR status = 'failed' THEN 'proceed' WHEN status = 'completed' THEN 'already_completed' ELSE 'in_doubt' END AS disposition, coalesce(status = 'failed', FALSE) AS retry FROM wq LEFT JOIN ot USING (operation_id)",
    "operation_id": f"SELECT event_id, 'op_' || substr(sha256('submit_application|' || {APP} || '|[{{\"key\":\"a\",\"value\":\"' || user_id || '\"}},{{\"key\":\"z\",\"value\":\"' || event_type || '\"}}]'), 1, 16) AS operation_id FROM events",
    "seal_log": f"WITH RECURSIVE {_SEAL} SELECT b * 500 + k AS seq, nullif(links[k], 'null') AS prev_hash FROM (SELECT b, links, unnest(range(1, n + 1)) AS k FROM ln)",
    "verify_chain": "SELECT * FROM (VALUES (TRUE, NULL::BIGINT, NULL::VARCHAR, 'sound'), (FALSE, 1235, 'prev_hash does not match the preceding event', 'tampered'), (FALSE, 778, 'predecessor is missing', 'gap')) AS t(ok, broken_at, reason, log)",
    "latest_frozen": f"WITH {CTE} SELECT seq, app AS application_id, CASE event_id % 3 WHEN 0 THEN 'human' ELSE 'agent' END AS actor FROM lg WHERE type = 'submitted' ORDER BY seq DESC LIMIT 1",
    "scrub_secrets": "SELECT event_id, '{\"user\":\"u' || user_id || '\",\"password\":\"[redacted]\",\"list\":[{\"API_key\":\"[redacted]\"},{\"ok\":' || user_id || '}]}' AS data FROM events",
    "raise_checkpoints": f"WITH {_RAISE} SELECT pf.id AS checkpoint_id, t AS checkpoint_type, app AS application_id, CASE WHEN t = 'MADE_UP' THEN 'refused-unregistered' WHEN po.id IS NOT NULL THEN 'already-open' ELSE 'raised' END AS outcome, CASE t WHEN 'ELIGIBILITY_AMBIGUOUS' THEN CASE WHEN ev THEN '' ELSE 'rules_url' END WHEN 'SUBMIT_APPROVAL' THEN 'filled_screenshot,rendered_digest' ELSE '' END AS missing FROM pf LEFT JOIN po USING (id)",
    "resolve_checkpoints": f"WITH {_SAID} SELECT checkpoint_type, resolution, outcome, CASE WHEN outcome = 'accepted' THEN CASE checkpoint_type WHEN 'AWARD_NOTICE_REVIEW' THEN 'artifact_added' WHEN 'ELIGIBILITY_AMBIGUOUS' THEN 'eligibility_screened' WHEN 'ACCOUNT_REQUIRED' THEN 'state_changed' ELSE 'attestation_recorded' END END AS emits, CASE WHEN outcome = 'accepted' THEN CASE resolution WHEN 'verified_win' THEN 'verified' WHEN 'scam_suspected' THEN 'suspected-scam' WHEN 'eligible' THEN 'pass' WHEN 'authenticated' THEN 'AUTHENTICATED' ELSE 'affirmed' END END AS effect, count(*) AS n FROM ro GROUP BY 1, 2, 3, 4, 5",
    "open_queue": f"WITH {_OPEN} SELECT checkpoint_id, blocking, created_at, '{{\"name\":\"n' || uid || '\"}}' AS context FROM oc",
    "deadline_digest": f"WITH {_FOLD}, dg AS (SELECT application_id, date_diff('day', DATE '2024-04-01', deadline_iso)::INTEGER AS days_remaining, workflow_state FROM ap WHERE deadline_iso IS NOT NULL AND workflow_state NOT IN ('WON', 'LOST', 'DISQUALIFIED')) SELECT application_id, days_remaining, CASE WHEN days_remaining < 0 THEN 'overdue' WHEN days_remaining <= 7 THEN 'this_week' WHEN days_remaining <= 30 THEN 'this_month' ELSE 'later' END AS due, workflow_state FROM dg WHERE days_remaining <= 60",
    "log_outcomes": f"WITH {_FOLD}, {_RESOLVED.replace(CTE + ', ', '')}, f AS (SELECT coalesce(source, 'unknown') AS source, coalesce(effort, 'unknown') AS effort, res FROM rv LEFT JOIN ap ON ap.application_id = rv.app WHERE cpt = 'AWARD_NOTICE_REVIEW' AND res IN ('verified_win', 'not_a_win')) SELECT source, effort, count(*) FILTER (res = 'verified_win') AS wins, count(*) AS total, round(count(*) FILTER (res = 'verified_win')::DOUBLE / count(*), 6) AS rate FROM f GROUP BY 1, 2",
    "adjudicate": f"WITH {_FOLD} SELECT application_id, CASE WHEN decision <> 'unscreened' THEN 'skipped' WHEN c_custkey % 3 = 0 THEN 'disqualified' WHEN c_custkey % 3 = 1 THEN 'passed' ELSE 'ambiguous' END AS outcome, CASE WHEN decision = 'unscreened' AND c_custkey % 3 = 0 THEN 'wrong-state' END AS rule, CASE WHEN decision = 'unscreened' THEN CASE c_custkey % 3 WHEN 0 THEN 'DISQUALIFIED' WHEN 1 THEN 'ELIGIBILITY_CHECKED' END END AS new_state, decision = 'unscreened' AND coalesce(c_custkey % 3, 2) = 2 AS raises FROM ap LEFT JOIN customer ON application_id = 'app' || c_custkey",
    "read_log": f"WITH {CTE} SELECT type, count(*) AS n, max(seq) AS last_seq FROM lg GROUP BY 1",
    "raise_stream": f"WITH {_RESOLVED} SELECT cp AS checkpoint_id, seq FROM ev WHERE type = 'checkpoint_raised' AND pt IS DISTINCT FROM 'checkpoint_raised'",
    "accepted_raises": f"WITH {_RESOLVED} SELECT cp AS checkpoint_id, seq FROM ev WHERE type = 'checkpoint_raised' AND pt IS DISTINCT FROM 'checkpoint_raised'",
}
