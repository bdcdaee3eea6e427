"""Keyed streams with timers of event time: scratch entries that expire, attempts that are left pending, rejections that count.

State is in Spark's store (RocksDB, of which each batch uploads what changed to the checkpoint folder): a key's state goes
when its timer does, so it holds what is alive and not what ever was. Results are changes, in append mode; rows later
than the watermark are dropped, as the timers behind it have gone off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _moment(c: str):
    return F.timestamp_micros(F.col(c)).cast("timestamp_ntz")


class _Scratch(StatefulProcessor):
    """The newest entry of a key, until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "id long, last long, value string, expires long, made long, updated long")

    def _at(self, expires: int | None) -> int | None:
        return None if expires is None else -(-expires // 1000)  # timers count milliseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        before = held[3] if held else None
        changed = False
        for pdf in rows:
            for r in pdf.sort_values(["updated", "id"]).itertuples():
                expires = None if pd.isna(r.expires) else int(r.expires)
                first = (int(r.updated), int(r.id))
                if held is None or first >= (held[5], held[1]):
                    made = min((held[4], held[0]), first) if held else first
                    held = (made[1], first[1], None if pd.isna(r.value) else r.value, expires, made[0], first[0])
                elif first < (held[4], held[0]):
                    held = (first[1], *held[1:4], first[0], held[5])
                else:
                    continue
                changed = True
        if not changed:
            return
        if before is not None and before != held[3]:
            self.handle.deleteTimer(self._at(before))
        if held[3] is not None and before != held[3]:
            self.handle.registerTimer(self._at(held[3]))
        self.entry.update(held)
        yield self._row(key, held, "put")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held and held[3] is not None and self._at(held[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield self._row(key, held, "expired")

    def _row(self, key, held, event: str) -> pd.DataFrame:
        row = {"of": key[0]} | dict(zip(["id", "last", "value", "expires", "made", "updated"], held, strict=True)) | {"event": event}
        return pd.DataFrame([row]).astype({c: "Int64" for c in ("id", "last", "expires", "made", "updated")})

    def close(self) -> None:
        pass


def scratch_changes(writes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """From a stream of writes as upsert_scratch has them: each entry as it is after a batch that changed it ('put'), and
    once more when the watermark passes its expiry ('expired'), after which the key is as if it had never been."""
    settle(writes.sparkSession)
    rows = writes.withColumn("at", F.col("updated_at").cast("timestamp")).withWatermark("at", delay)
    # state is looked up by one text, as parts of a key that are null aren't told from others
    of = F.to_json(F.struct("project_id", "task_id", "key")).alias("of")
    rows = rows.select("at", of, "id", "value", _micros("expires_at").alias("expires"), _micros("updated_at").alias("updated"))
    kind = "of string, id long, last long, value string, expires long, made long, updated long, event string"
    found = rows.groupBy("of").transformWithStateInPandas(_Scratch(), kind, "Append", "EventTime")
    found = found.withColumn("of", F.from_json("of", "project_id long, task_id long, key string"))
    return found.select("of.*", "id", "value", _moment("expires").alias("expires_at"), _moment("made").alias("created_at"), _moment("updated").alias("updated_at"), "last", "event")


class _Pending(StatefulProcessor):
    """An attempt that is pending, until it is decided or its time is over."""

    def __init__(self, hours: int):
        self.wait = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "made long, task_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.sort_values("said").itertuples():
                if r.outcome == "pending":
                    if not self.since.exists():
                        self.since.update((int(r.made), int(r.task_id)))
                        self.handle.registerTimer(-(-int(r.made) // 1000) + self.wait)
                elif self.since.exists():
                    self.handle.deleteTimer(-(-self.since.get()[0] // 1000) + self.wait)
                    self.since.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.since.exists():
            made, task = self.since.get()
            self.since.clear()
            yield pd.DataFrame([{"attempt_id": key[0], "task_id": task, "outcome": "unknown", "resolved": made + self.wait * 1000}])

    def close(self) -> None:
        pass


def escalations(outcomes: DataFrame, hours: int = 72, delay: str = "0 seconds") -> DataFrame:
    """(attempt_id, task_id, outcome, resolved_at) of attempts that nothing has decided so many hours of event time after
    they were made, once each, from a stream (attempt_id, task_id, outcome, created_at, said_at); null ids are left out."""
    settle(outcomes.sparkSession)
    rows = outcomes.withColumn("at", F.col("said_at").cast("timestamp")).withWatermark("at", delay)
    rows = rows.where("attempt_id IS NOT NULL").select("at", "attempt_id", "task_id", "outcome", _micros("created_at").alias("made"), _micros("said_at").alias("said"))
    found = rows.groupBy("attempt_id").transformWithStateInPandas(_Pending(hours), "attempt_id long, task_id long, outcome string, resolved long", "Append", "EventTime")
    return found.select("attempt_id", "task_id", "outcome", _moment("resolved").alias("resolved_at"))


class _Rejections(StatefulProcessor):
    """How many rejections a task has had; state goes no further than the threshold."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        if n >= self.threshold:
            return
        every = pd.concat(list(rows)).sort_values(["resolved", "made", "approach_summary", "reasoning"])
        if n + len(every) >= self.threshold:
            yield pd.DataFrame([{"task_id": key[0], "resolved": int(every["resolved"].iloc[self.threshold - n - 1]), "rejected": self.threshold}])
        self.count.update((min(self.threshold, n + len(every)),))

    def close(self) -> None:
        pass


def rejection_stream(attempts: DataFrame, threshold: int) -> DataFrame:
    """As ledger.rejection_events, from a stream of attempts in the order in which they were resolved."""
    settle(attempts.sparkSession)
    rows = attempts.where("outcome = 'rejected' AND task_id IS NOT NULL").select("task_id", "approach_summary", "reasoning", _micros("created_at").alias("made"), _micros("resolved_at").alias("resolved"))
    found = rows.groupBy("task_id").transformWithStateInPandas(_Rejections(threshold), "task_id long, resolved long, rejected long", "Append", "None")
    return found.select("task_id", _moment("resolved").alias("resolved_at"), "rejected")
