"""Structured Streaming forms of the log folds. Each gives the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import norm_key
from ..operators import eventlog, listings
from ..session import scratch_dir
from . import keyed_state

LOG_SCHEMA = "seq bigint, at timestamp_ntz, type string, application_id string, actor string, data string"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a batch table; blank lines vanish, order is ``seq``."""
    return spark.read.schema(LOG_SCHEMA).option("timestampNTZFormat", TIME_FORMAT).json(path)


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("timestampNTZFormat", TIME_FORMAT).json(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA).option("timestampNTZFormat", TIME_FORMAT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Micro-batches whose changes are merged into one table.
MERGE_EVERY = 16


def run_to_end(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available, one ``write`` per micro-batch, and stop.

    A replayed batch calls ``write`` again with the same number, so writes must overwrite. State is kept in RocksDB.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def _changelog(spark: SparkSession, updates: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Keep the changed keys of each micro-batch in a folder of its own; read the newest row per key.

    Update mode moves only the keys that changed, however large the state grows. Every ``MERGE_EVERY`` batches the folders
    since the last merge and its table become one table, so a reader opens few folders however long the stream ran.
    """
    keys = [key] if isinstance(key, str) else key
    out, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-progress")
    schema = updates.withColumn("_batch", F.lit(0)).schema
    fields = [c for c in updates.columns if c not in keys]
    seen = {"merged": None, "last": -1}

    def newest() -> DataFrame:
        since = -1 if seen["merged"] is None else seen["merged"]
        folders = [f"{out}/changes/batch={n}" for n in range(since + 1, seen["last"] + 1)]
        folders += [f"{out}/merged/upto={since}"] if since >= 0 else []
        rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields, "_batch"), "_batch").alias("r")).select(*keys, "r.*")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        seen["last"] = number
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            newest().write.mode("overwrite").parquet(f"{out}/merged/upto={number}")
            seen["merged"] = number

    run_to_end(updates, "update", write, checkpoint)
    return newest().drop("_batch")


def stream_fold_applications(stream: DataFrame) -> DataFrame:
    named = stream.filter(F.col("application_id").isNotNull())
    folded = named.groupBy("application_id").agg(*eventlog.application_fold())
    return eventlog.application_defaults(_changelog(stream.sparkSession, folded, "application_id", "applications"))


def stream_open_checkpoints(stream: DataFrame) -> DataFrame:
    folded = eventlog.checkpoint_events(stream).groupBy("checkpoint_id").agg(*eventlog.checkpoint_fold())
    return eventlog.still_open(_changelog(stream.sparkSession, folded, "checkpoint_id", "checkpoints"))


def stream_operation_states(stream: DataFrame) -> DataFrame:
    folded = eventlog.operation_events(stream).groupBy("operation_id").agg(*eventlog.operation_fold())
    return eventlog.operation_status(_changelog(stream.sparkSession, folded, "operation_id", "operations"))


def linked_events(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Checkpoint events of a log stream, each with the event before it on the same checkpoint (streaming; see
    :class:`keyed_state.Linked`). Files may come in any order and micro-batches may cut them anywhere."""
    facts = F.to_json(
        F.struct(
            "type",
            eventlog.field("type").alias("checkpoint_type"),
            "application_id",
            F.col("at").cast("string").alias("at"),
            eventlog.field("resolution").alias("resolution"),
            eventlog.field("resolvedBy").alias("resolved_by"),
        )
    )
    events = eventlog.checkpoint_events(stream)
    return keyed_state.linked(events.select(F.col("checkpoint_id").alias("key"), "seq", "at", facts.alias("payload")), lateness)


def _fact(column: str, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")


def raise_stream(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """``checkpoint_id, seq, accepted`` of every raise of a log stream: a raise of an open checkpoint is a retry.

    A plain duplicate filter would also drop the reopening of a resolved checkpoint. A late event can change the verdict on
    its successor, which is then told again. Returns the streaming DataFrame.
    """
    was = F.coalesce(_fact("prev", "type"), F.lit(""))
    kind = _fact("payload", "type")
    return linked_events(stream, lateness).filter(kind == "checkpoint_raised").select(
        F.col("key").alias("checkpoint_id"), "seq", (was != "checkpoint_raised").alias("accepted")
    )


def stream_accepted_raises(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """The raises of a log stream that count, once it has ended; equals :func:`accepted_raises`."""
    told = _changelog(stream.sparkSession, raise_stream(stream, lateness), ["checkpoint_id", "seq"], "raises")
    return told.filter("accepted").select("checkpoint_id", "seq")


def stream_resolved(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Every resolution that found its checkpoint open, once the stream has ended; equals ``eventlog.resolved_checkpoints``."""
    told = _changelog(stream.sparkSession, linked_events(stream, lateness), ["key", "seq"], "resolved")
    found = (_fact("payload", "type") == "checkpoint_resolved") & (_fact("prev", "type") == "checkpoint_raised")
    return told.filter(found).select(
        F.col("key").alias("checkpoint_id"),
        "seq",
        _fact("prev", "checkpoint_type").alias("checkpoint_type"),
        _fact("prev", "application_id").alias("application_id"),
        _fact("prev", "at").cast("timestamp_ntz").alias("created_at"),
        _fact("payload", "at").cast("timestamp_ntz").alias("resolved_at"),
        _fact("payload", "resolution").alias("resolution"),
        _fact("payload", "resolved_by").alias("resolved_by"),
    )


SCORE_SCHEMA = "profile_hash string, name string, match int, effort string, flags array<string>, at timestamp, ord bigint"


def stream_score_cache(scored: DataFrame, profile: str, now: Column, max_days: int = listings.CACHE_DAYS, lateness: str | None = None) -> DataFrame:
    """The score cache of a stream of scores (``SCORE_SCHEMA``), once it has ended: the newest cacheable score per name key
    that is fresh at ``now``. Equals ``listings.update_score_cache`` on the same rows.

    An entry leaves the state when the watermark (``lateness`` behind the newest score; without it, ``max_days``) is
    ``max_days`` past it. Each batch writes the keys it changed, so a replay overwrites and changes nothing.
    """
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    usable = scored.filter((F.col("profile_hash") == profile) & F.col("at").isNotNull() & listings.is_cacheable(F.col("match"), F.col("effort"), flags))
    keyed = usable.withColumn("key", norm_key(F.col("name"))).filter("key <> ''")
    value = F.to_json(F.struct("match", "effort", flags.alias("flags")))
    told = keyed_state.upserted(keyed.select("key", "at", "ord", value.alias("value")), max_days, lateness or f"{max_days} days")
    entries = _changelog(scored.sparkSession, told, "key", "scores").filter("NOT expired")
    parsed = F.from_json("value", "match int, effort string, flags array<string>")
    cache = entries.select(F.lit(profile).alias("profile_hash"), "key", parsed.alias("v"), "at").select("profile_hash", "key", "v.*", "at")
    return listings.fresh_scores(cache, profile, now, max_days)


def accepted_raises(log: DataFrame) -> DataFrame:
    """Batch form of :func:`stream_accepted_raises`: a raise counts unless the event before it was a raise."""
    from ..operators.ranking import previous_in_group

    ev = eventlog.checkpoint_events(log)
    linked = previous_in_group(ev, "checkpoint_id", "seq", F.col("type"))
    return linked.filter((F.col("type") == "checkpoint_raised") & ~F.col("prev").eqNullSafe(F.lit("checkpoint_raised"))).select(
        "checkpoint_id", "seq"
    )
