"""Streams with timers by the clock, typed state, and state that expires: what a watcher of files and running sessions needs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark.sources.store import Store, Transaction

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """These operators keep their state in RocksDB. The driver's own worker need not have this library."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ms(rows: pd.Series) -> tuple[int, int]:
    """The first and the last time, in milliseconds."""
    return rows.min().value // 1_000_000, rows.max().value // 1_000_000


class Release(StatefulProcessor):
    """Bursts of changes that nothing has followed for ``quiet`` milliseconds by the clock."""

    def __init__(self, key: str, ts: str, quiet: int):
        self.key, self.ts, self.quiet = key, ts, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first long, last long, changes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.burst.get() if self.burst.exists() else (None, None, 0)
        for batch in rows:
            low, high = _ms(batch[self.ts])
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(batch)
        self.burst.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({self.key: [key[0]], "first_change": pd.to_datetime([first], unit="ms"), "last_change": pd.to_datetime([last], unit="ms"), "changes": [n]})

    def close(self) -> None:
        pass


def released(changes: DataFrame, key: str, ts: str = "ts", quiet: float = 5.0) -> DataFrame:
    """Files that changed and then were quiet for ``quiet`` seconds by the clock, without a further event: key, first_change, last_change, changes.

    A change restarts the wait. Use with append mode and a trigger that runs again.
    """
    _ready(changes.sparkSession)
    kind = f"{key} {changes.schema[key].dataType.simpleString()}, first_change timestamp, last_change timestamp, changes long"
    return changes.select(key, ts).groupBy(key).transformWithStateInPandas(Release(key, ts, int(quiet * 1000)), kind, "Append", "ProcessingTime")


class Running(StatefulProcessor):
    """Counts and times of a session; a session without messages for ``idle`` milliseconds leaves no state."""

    def __init__(self, key: str, ts: str, role: str, idle: int):
        self.key, self.ts, self.role, self.idle = key, ts, role, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "messages long, asked long, first long, last long", ttlDurationMs=self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, asked, first, last = self.session.get() if self.session.exists() else (0, 0, None, None)
        for batch in rows:
            low, high = _ms(batch[self.ts])
            n, asked = n + len(batch), asked + int((batch[self.role] == "user").sum())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        self.session.update((n, asked, first, last))
        yield pd.DataFrame({self.key: [key[0]], "messages": [n], "user_messages": [asked], "started_at": pd.to_datetime([first], unit="ms"), "last_at": pd.to_datetime([last], unit="ms")})

    def close(self) -> None:
        pass


def running_sessions(messages: DataFrame, key: str = "session_id", ts: str = "ts", role: str = "role", idle: float = 86_400.0) -> DataFrame:
    """Sessions that got messages, as they are now: key, messages, user_messages, started_at, last_at. For update mode.

    A session that had none for ``idle`` seconds by the clock is forgotten, and begins anew with its next message.
    """
    _ready(messages.sparkSession)
    kind = f"{key} {messages.schema[key].dataType.simpleString()}, messages long, user_messages long, started_at timestamp, last_at timestamp"
    return messages.select(key, ts, role).groupBy(key).transformWithStateInPandas(Running(key, ts, role, int(idle * 1000)), kind, "Update", "ProcessingTime")


class Once(StatefulProcessor):
    """The first row of a key, until its entry expires."""

    def __init__(self, key: str, ttl: int):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield pd.DataFrame({self.key: [key[0]]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, ttl: float = 3600.0) -> DataFrame:
    """Keys that were not seen within the last ``ttl`` seconds by the clock: key. An entry that expires leaves no state."""
    _ready(rows.sparkSession)
    return rows.select(key).groupBy(key).transformWithStateInPandas(Once(key, int(ttl * 1000)), f"{key} {rows.schema[key].dataType.simpleString()}", "Append", "ProcessingTime")


def keep_sessions(messages: DataFrame, checkpoint: str, store: Store, name: str = "sessions", key: str = "session_id", **how):
    """Rewrite the rows of running sessions in a store's table while they run, a version a batch; gives the query, not started.

    State that expires by the clock lets Spark run batches without data for ever: a run that is to end takes ``trigger(once=True)``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        def change(t: Transaction) -> None:
            if not t.seen(name, number):
                t.merge(name, rows, lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new), [key])

        rows = rows.persist()
        store.update(change)
        rows.unpersist()

    return running_sessions(messages, key, **how).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
