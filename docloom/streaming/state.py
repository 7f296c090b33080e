"""Keyed stream state: the last events of each key, and writes that wait until a key is quiet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the provider of state that these processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Set the session's state store to one that keeps lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


EVENT = "event_id long, at_us long, status string, value double"


class LastEvents(StatefulProcessor):
    """Keeps a key's last n events by (time, id), each id once, in whatever order and how often they arrive; a key that is silent for `ttl_ms` is forgotten."""

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r) for r in self.events.get()} if self.events.exists() else {}
        for df in rows:
            for r in df[["event_id", "at_us", "status", "value"]].itertuples(index=False):
                held[int(r.event_id)] = (int(r.event_id), int(r.at_us), r.status, None if pd.isna(r.value) else float(r.value))
        kept = sorted(held.values(), key=lambda e: (-e[1], -e[0]))[: self.n]
        self.events.put(kept)  # what falls out is evicted
        if self.ttl is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl)
        yield pd.DataFrame({"key": key[0], "event_id": [e[0] for e in kept], "at_us": [e[1] for e in kept], "status": [e[2] for e in kept], "value": pd.array([e[3] for e in kept], dtype="Float64"), "age": range(1, len(kept) + 1)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        yield pd.DataFrame({"key": [key[0]], "event_id": [None], "at_us": [None], "status": ["forgotten"], "value": [None], "age": [0]}).astype({"event_id": "Int64", "at_us": "Int64", "value": "Float64"})

    def close(self) -> None:
        pass


def last_events(events: DataFrame, n: int, ttl_ms: int | None = None) -> DataFrame:
    """(key long, event_id long, at_us long, status string, value double) stream -> after every batch the last n events of each key that it touched, the latest with age 1. Of a key's rows those of its newest batch count."""
    use_keyed_state(events.sparkSession)
    made = events.select("key", "event_id", "at_us", "status", "value").groupBy("key")
    return made.transformWithStateInPandas(LastEvents(n, ttl_ms), f"key long, {EVENT}, age int", "Update", "ProcessingTime" if ttl_ms is not None else "None")


STATE = "status string, at_us long, changes long"


class Debounced(StatefulProcessor):
    """Holds a key's newest state back until nothing came for `quiet_ms`; then it is written once."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, at, changes = self.state.get() if self.state.exists() else (None, None, 0)
        for df in rows:
            for r in df.itertuples():
                changes += 1
                if at is None or r.at_us >= at:
                    status, at = r.status, int(r.at_us)
        self.state.update((status, at, changes))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, at, changes = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "status": [status], "at_us": [at], "changes": [changes]})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """(key long, at_us long, status string, …) stream -> one row (key, status, at_us, changes) for each time that a key falls quiet.

    Its timers make a batch again and again, so it runs under a processing-time trigger; with availableNow it would not end.
    """
    use_keyed_state(events.sparkSession)
    return events.select("key", "at_us", "status").groupBy("key").transformWithStateInPandas(Debounced(quiet_ms), f"key long, {STATE}", "Append", "ProcessingTime")


def replay_then_tail(events: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], tail: bool = True, every: str = "500 milliseconds", mode: str = "append"):
    """All past rows of a stream first, in bounded batches, then those that arrive; both read from one checkpoint, so none is taken twice or left out, after a restart too.

    take gets each batch and its number. The stream must not have processing-time timers, as the replay would not end. Without `tail` it returns when the past has been replayed; else the running query.
    """

    def query(trigger: dict):
        return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**trigger).start()

    past = query({"availableNow": True})
    past.awaitTermination()
    return query({"processingTime": every}) if tail else None
