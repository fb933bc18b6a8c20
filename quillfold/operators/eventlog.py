"""The event log: sealing, verification, and the state folded from it.

Log rows: ``seq, at, type, application_id, actor, data (JSON text)``. Folds are aggregates whose
parts can be merged in any order (last value by sequence number), so the same expressions serve a
batch, a backfill and a streaming aggregation.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machine import canonical_state
from .ranking import previous_in_group

SEAL_BLOCK = 10_000
LOG_FIELDS = ("seq", "at", "type", "application_id", "actor", "data")


def field(name: str, data: str = "data") -> Column:
    return F.get_json_object(data, f"$.{name}")


def content_json(data: str = "data") -> Column:
    """Canonical JSON of an event without its link: fixed field order, NULLs kept."""
    return F.to_json(
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
            "type",
            F.col("application_id").cast("string").alias("application_id"),
            "actor",
            F.col(data).alias("data"),
        ),
        {"ignoreNullFields": "false"},
    )


def _link(content: Column, prev_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", content, F.coalesce(prev_hash, F.lit("null"))), 256)


def _digests(rows: DataFrame, place: str, digest: str, block: int) -> DataFrame:
    """(n, d): one digest per ``block`` consecutive places."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct(place, digest))), lambda x: x[digest])
    return rows.groupBy(F.floor(F.col(place) / block).alias("n")).agg(F.sha2(F.array_join(inside, "|"), 256).alias("d"))


def _roots_before(log: DataFrame, block: int) -> DataFrame:
    """(_block, root): what all blocks before a block amount to; NULL before the first.

    A root covers its block and the root before it, so a change anywhere changes every later root. The roots are linked in
    two levels of ``block`` members, and only the upper one, with one row per ``block`` blocks, is linked by one task.
    """

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        prev, out = rows["start"].iloc[0], []
        for d in rows["d"]:
            out.append(prev)
            prev = hashlib.sha256(f"{d}|{'null' if prev is None else prev}".encode()).hexdigest()
        return pd.DataFrame({"n": rows["n"], "root": out})

    events = log.select((F.col("seq") - 1).alias("at"), F.sha2(content_json(), 256).alias("c"))
    lower = _digests(events, "at", "c", block)
    upper = _digests(lower, "n", "d", block).withColumns({"start": F.lit(None).cast("string"), "_top": F.floor(F.col("n") * 0)})
    starts = upper.groupBy("_top").applyInPandas(chained, "n long, root string").select(F.col("n").alias("_upper"), F.col("root").alias("start"))
    members = lower.withColumn("_upper", F.floor(F.col("n") / block)).join(starts, "_upper")
    return members.groupBy("_upper").applyInPandas(chained, "n long, root string").withColumnRenamed("n", "_block")


def seal_log(log: DataFrame, block: int = SEAL_BLOCK) -> DataFrame:
    """Add ``prev_hash``.

    A strictly sequential chain cannot be written in parallel, so the chain is cut in blocks of
    ``block`` events. Inside a block each event links to its predecessor's content and link; the
    first event of a block links to the root of all blocks before, so no part of the past can be
    changed and sealed again without changing the last link.
    """
    roots = _roots_before(log, block)
    rows = log.withColumn("_block", F.floor((F.col("seq") - 1) / block)).withColumn("_content", content_json())
    start = rows.select("seq", "_block", "_content").join(roots, "_block", "left")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        prev, out = pdf["root"].iloc[0], []
        for content in pdf["_content"]:
            out.append(prev)
            prev = hashlib.sha256(f"{content}|{'null' if prev is None else prev}".encode()).hexdigest()
        return pd.DataFrame({"seq": pdf["seq"], "prev_hash": out})

    links = start.groupBy("_block").applyInPandas(chain, "seq long, prev_hash string")
    return rows.drop("_block", "_content").join(links, "seq")


def verify_chain(log: DataFrame, block: int = SEAL_BLOCK) -> DataFrame:
    """One row ``ok, broken_at, reason``: the first event that does not follow from its predecessor.

    Each event is checked against the one numbered before it by an equi-join, so the check is
    parallel even though the chain was written in order.
    """
    rows = log.withColumn("_content", content_json())
    before = rows.select(
        (F.col("seq") + 1).alias("seq"), _link(F.col("_content"), F.col("prev_hash")).alias("_expected"), F.lit(True).alias("_has")
    )
    roots = _roots_before(log, block).select((F.col("_block") * block + 1).cast("long").alias("seq"), "root")
    joined = rows.join(before, "seq", "left").join(roots, "seq", "left")
    expected = F.when(F.pmod(F.col("seq") - 1, F.lit(block)) == 0, F.col("root")).otherwise(F.col("_expected"))
    copies = log.groupBy("seq").count().filter("count > 1").select("seq", F.lit("sequence number repeats").alias("reason"))
    bad = joined.select(
        "seq",
        F.when((F.col("seq") != 1) & F.col("_has").isNull(), "predecessor is missing")
        .when(~F.col("prev_hash").eqNullSafe(expected), "prev_hash does not match the preceding event")
        .alias("reason"),
    ).filter("reason IS NOT NULL")
    first = bad.unionByName(copies).agg(F.min(F.struct("seq", "reason")).alias("b"))
    return first.select(F.col("b").isNull().alias("ok"), F.col("b.seq").alias("broken_at"), F.col("b.reason").alias("reason"))


# ---------------------------------------------------------------- folds


def _latest(value: Column, when: Column) -> Column:
    """Value at the highest sequence number among rows where ``when`` holds."""
    return F.max_by(value, F.when(when, F.col("seq")))


def application_fold() -> list[Column]:
    """Aggregates giving the current state of an application from its events."""
    t = F.col("type")
    found, screened, moved = t == "discovered", t == "eligibility_screened", t == "state_changed"
    mapped, filled, sent = t == "form_mapped", t == "form_filled", t == "submitted"
    has = lambda c: c.isNotNull()
    prompts, platform = field("essayPrompts"), field("platform")
    # a discovery rewrites every canonical field, also with its default
    on_found = lambda name, default=None: _latest(
        field(name) if default is None else F.coalesce(field(name), F.lit(default)), found
    )
    return [
        on_found("name", "").alias("name"),
        on_found("url", "").alias("url"),
        on_found("source").alias("source"),
        on_found("effort").alias("effort"),
        on_found("amount").cast("double").alias("amount"),
        on_found("deadlineISO").cast("date").alias("deadline_iso"),
        _latest(F.coalesce(field("discoveredAt").cast("timestamp_ntz"), F.col("at")), found).alias("discovered_at"),
        _latest(
            F.when(found, F.coalesce(field("eligibility.decision"), F.lit("unscreened"))).otherwise(field("decision")),
            found | (screened & has(field("decision"))),
        ).alias("decision"),
        _latest(
            F.when(found, field("eligibility.hardDqRule")).otherwise(field("hardDqRule")), found | (screened & has(field("hardDqRule")))
        ).alias("hard_dq_rule"),
        _latest(
            F.when(found, F.coalesce(field("workflowState"), F.lit("DISCOVERED"))).otherwise(canonical_state(field("to"))), found | moved
        ).alias("workflow_state"),
        _latest(
            F.when(found, field("requirements.essayPrompts")).otherwise(prompts), found | (mapped & has(prompts) & (prompts != "[]"))
        ).alias("essay_prompts"),
        _latest(platform, found | (mapped & has(platform))).alias("platform"),
        _latest(F.col("at"), mapped).alias("last_mapped_at"),
        _latest(F.col("at"), filled | sent).alias("last_run_at"),
        _latest(F.col("at"), sent).alias("submitted_at"),
        F.max("seq").alias("last_seq"),
    ]


def application_defaults(folded: DataFrame) -> DataFrame:
    return folded.na.fill({"name": "", "url": "", "decision": "unscreened", "workflow_state": "DISCOVERED"})


def fold_applications(log: DataFrame) -> DataFrame:
    """Current state per application; any event that names one creates it."""
    named = log.filter(F.col("application_id").isNotNull())
    return application_defaults(named.groupBy("application_id").agg(*application_fold()))


ARTIFACT_TYPES = ("artifact_added", "attestation_recorded", "recommendation_requested")


def application_artifacts(log: DataFrame) -> DataFrame:
    """Artifact rows in force per application, one per row so no list grows without bound.

    A later discovery resets the list, so only artifacts after the last one count.
    """
    named = log.filter(F.col("application_id").isNotNull())
    reset = named.filter("type = 'discovered'").groupBy("application_id").agg(F.max("seq").alias("_reset"))
    rows = named.filter(F.col("type").isin(*ARTIFACT_TYPES)).join(reset, "application_id", "left")
    kind = F.when(F.col("type") == "artifact_added", field("kind")).otherwise(F.coalesce(field("kind"), F.col("type")))
    return rows.filter(F.col("seq") > F.coalesce("_reset", F.lit(0))).select(
        "application_id", "seq", kind.alias("kind"), F.coalesce(field("verified").cast("boolean"), F.lit(False)).alias("verified"), "data"
    )


def checkpoint_fold() -> list[Column]:
    """Aggregates per checkpoint: last raise (with its facts) and last resolution."""
    raised, resolved = F.col("type") == "checkpoint_raised", F.col("type") == "checkpoint_resolved"
    return [
        F.max(F.when(raised, F.col("seq"))).alias("raised_seq"),
        F.max(F.when(resolved, F.col("seq"))).alias("resolved_seq"),
        _latest(F.col("application_id"), raised).alias("application_id"),
        _latest(field("type"), raised).alias("checkpoint_type"),
        _latest(F.coalesce(field("blocking").cast("boolean"), F.lit(False)), raised).alias("blocking"),
        _latest(field("context"), raised).alias("context"),
        _latest(field("evidenceRefs"), raised).alias("evidence_refs"),
        _latest(F.col("at"), raised).alias("created_at"),
    ]


def still_open(folded: DataFrame) -> DataFrame:
    """Raised, and not resolved since: a later raise opens the same checkpoint again."""
    return folded.filter(F.col("raised_seq") > F.coalesce("resolved_seq", F.lit(-1)))


def checkpoint_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("type").isin("checkpoint_raised", "checkpoint_resolved")).withColumn("checkpoint_id", field("id"))


def open_checkpoints(log: DataFrame) -> DataFrame:
    return still_open(checkpoint_events(log).groupBy("checkpoint_id").agg(*checkpoint_fold()))


def resolved_checkpoints(log: DataFrame) -> DataFrame:
    """Every resolution that found its checkpoint open, with the facts of that raise."""
    ev = checkpoint_events(log)
    facts = F.struct("type", field("type").alias("checkpoint_type"), "application_id", F.col("at").alias("created_at"))
    linked = previous_in_group(ev, "checkpoint_id", "seq", facts)
    return linked.filter((F.col("type") == "checkpoint_resolved") & (F.col("prev.type") == "checkpoint_raised")).select(
        "checkpoint_id",
        "seq",
        F.col("prev.checkpoint_type").alias("checkpoint_type"),
        F.col("prev.application_id").alias("application_id"),
        F.col("prev.created_at").alias("created_at"),
        F.col("at").alias("resolved_at"),
        field("resolution").alias("resolution"),
        field("resolvedBy").alias("resolved_by"),
    )


def operation_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("type").isin("operation_started", "operation_completed")).withColumn("operation_id", field("id"))


def operation_fold() -> list[Column]:
    started, ended = F.col("type") == "operation_started", F.col("type") == "operation_completed"
    return [
        F.max(F.when(started, F.col("seq"))).alias("started_seq"),
        F.max(F.when(ended, F.col("seq"))).alias("ended_seq"),
        _latest(field("kind"), started).alias("kind"),
        _latest(F.col("application_id"), started).alias("application_id"),
        _latest(F.col("at"), started).alias("started_at"),
        _latest(F.col("at"), ended).alias("_ended_at"),
        _latest(F.coalesce(field("ok"), F.lit("true")), ended).alias("_ok"),
    ]


def operation_status(folded: DataFrame) -> DataFrame:
    """A completion counts only after the latest start; one without a start is ignored."""
    ended = F.coalesce(F.col("ended_seq"), F.lit(-1)) > F.col("started_seq")
    return folded.filter(F.col("started_seq").isNotNull()).select(
        "operation_id",
        "kind",
        "application_id",
        F.when(~ended, "started").when(F.col("_ok") == "false", "failed").otherwise("completed").alias("status"),
        "started_at",
        F.when(ended, F.col("_ended_at")).alias("completed_at"),
    )


def operation_states(log: DataFrame) -> DataFrame:
    return operation_status(operation_events(log).groupBy("operation_id").agg(*operation_fold()))


def operation_id(kind: Column, application_id: Column, salient: Column) -> Column:
    """Stable id of an operation from its sorted salient inputs (a map column)."""
    entries = F.array_sort(F.map_entries(salient))
    return F.concat(
        F.lit("op_"), F.substring(F.sha2(F.concat_ws("|", kind, F.coalesce(application_id, F.lit("")), F.to_json(entries)), 256), 1, 16)
    )


def disposition(requests: DataFrame, states: DataFrame) -> DataFrame:
    """proceed / already_completed / in_doubt per requested operation. In doubt never retries."""
    joined = requests.join(states.select("operation_id", "status"), "operation_id", "left")
    verdict = (
        F.when(F.col("status").isNull() | (F.col("status") == "failed"), "proceed")
        .when(F.col("status") == "completed", "already_completed")
        .otherwise("in_doubt")
    )
    return joined.withColumn("disposition", verdict).withColumn("retry", F.coalesce(F.col("status") == "failed", F.lit(False)))


def latest_frozen(log: DataFrame, event_type: str) -> DataFrame:
    """The last event of a type."""
    return log.filter(F.col("type") == event_type).agg(F.max_by(F.struct(*log.columns), "seq").alias("e")).select("e.*")


def frozen_gate(log: DataFrame, current: DataFrame, event_type: str) -> DataFrame:
    """(ok, reason): the digest committed last must equal the digest now."""
    committed = latest_frozen(log, event_type).select(F.col("digest").alias("committed"), F.lit(1).alias("_one"))
    now = current.select("digest", F.lit(1).alias("_one"))
    ok = F.col("committed").eqNullSafe(F.col("digest"))
    reason = (
        F.when(F.col("committed").isNull(), "nothing was committed").when(~ok, "differs from the committed digest").otherwise("matches the committed digest")
    )
    return now.join(committed, "_one", "left").select(ok.alias("ok"), reason.alias("reason"))


# ---------------------------------------------------------------- payload hygiene

# Fixed value: keys whose values never reach the log.
SECRET_KEYS = r"^(password|passwd|pass|pin|token|api[_-]?key|secret|authorization|cookie|session|ssn|card|cvv|routing|account[_-]?number)$"


def scrub_secrets(data: Column) -> Column:
    """Redact credential-shaped keys at any depth of a JSON text. Text that is not JSON stays."""
    import re

    secret = re.compile(SECRET_KEYS, re.I)

    def scrub(v):
        if isinstance(v, list):
            return [scrub(x) for x in v]
        if isinstance(v, dict):
            return {k: "[redacted]" if secret.match(k) else scrub(x) for k, x in v.items()}
        return v

    def scrub_text(s):
        try:
            return json.dumps(scrub(json.loads(s)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return s

    @F.pandas_udf("string")
    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(scrub_text)

    return scrubbed(data)
