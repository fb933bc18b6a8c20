"""Stateful processors: events put back in order per key, and upserted entries that expire.

Both need the RocksDB state store (``log_stream.run_to_end`` sets it). They give the same rows however the input is cut in
micro-batches, and in whatever order files arrive: a row is told again when a late event changes it, and readers take the
newest row per key.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LINKED = "key string, seq long, payload string, prev string"
ENTRY = "key string, value string, at timestamp, expired boolean"


class Linked(StatefulProcessor):
    """Each event of a key with the payload of the event before it in sequence order.

    State: the key's events in order, ``[seq, time in ms, payload]``. With a watermark, of the events that lie behind it
    only the last one is kept, as the predecessor of what follows; an event before that one comes too late and is left out.
    """

    def __init__(self, watermark: bool):
        self.watermark = watermark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "floor long, events string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        floor, events = None, []
        if self.held.exists():
            floor, told = self.held.get()
            events = json.loads(told)
        seqs = [e[0] for e in events]
        touched = set()
        for row in rows:
            if floor is not None and row["seq"] < floor:
                continue
            at = bisect_left(seqs, row["seq"])
            if at < len(seqs) and seqs[at] == row["seq"]:
                continue  # a replay
            seqs.insert(at, row["seq"])
            events.insert(at, [row["seq"], row["ms"], row["payload"]])
            touched.add(row["seq"])
        out = []
        for at, (seq, _, payload) in enumerate(events):
            if seq in touched or at and seqs[at - 1] in touched:
                out.append(Row(key=key[0], seq=seq, payload=payload, prev=events[at - 1][2] if at else None))
        if self.watermark:
            behind, settled = timerValues.getCurrentWatermarkInMs(), 0
            while settled + 1 < len(events) and max(events[settled][1], events[settled + 1][1]) < behind:
                settled += 1
            if settled:
                events = events[settled:]
                floor = events[0][0]
        if touched:
            self.held.update((floor, json.dumps(events)))
        return iter(out)


class Upsert(StatefulProcessor):
    """The newest entry of each key by (time, order), told when it changes; gone once the watermark is ``days`` past it."""

    def __init__(self, days: int):
        self.keep = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "ms long, ord long, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        had = tuple(self.entry.get()) if self.entry.exists() else None
        best = max([(r["ms"], r["ord"], r["value"]) for r in rows] + ([had] if had else []))
        if best == had:
            return iter(())
        if had and had[0] != best[0]:
            self.handle.deleteTimer(had[0] + self.keep)
        self.entry.update(best)
        self.handle.registerTimer(best[0] + self.keep)
        return iter([_told(key[0], best, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.entry.exists():
            return iter(())
        had = tuple(self.entry.get())
        if had[0] + self.keep > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        self.entry.clear()
        return iter([_told(key[0], had, True)])


def _told(key: str, entry: tuple, expired: bool) -> Row:
    import datetime

    at = datetime.datetime.fromtimestamp(entry[0] / 1000, datetime.timezone.utc)
    return Row(key=key, value=entry[2], at=at, expired=expired)


def linked(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """``key, seq, payload, prev`` of a stream of ``key, seq, at, payload``. Without ``lateness`` every event is kept in state."""
    timed = events.withColumn("at", F.col("at").cast("timestamp"))
    timed = timed.withWatermark("at", lateness) if lateness else timed
    rows = timed.select("key", "seq", "at", F.unix_millis("at").alias("ms"), "payload")
    return rows.groupBy("key").transformWithState(Linked(bool(lateness)), LINKED, "update", "EventTime" if lateness else "None")


def upserted(entries: DataFrame, days: int, lateness: str = "0 seconds") -> DataFrame:
    """``key, value, at, expired`` of a stream of ``key, at, ord, value``: the newest entry per key, and its end."""
    timed = entries.withWatermark("at", lateness).select("key", "at", F.unix_millis("at").alias("ms"), "ord", "value")
    return timed.groupBy("key").transformWithState(Upsert(days), ENTRY, "update", "EventTime")
